"""Secret scans with a trigram inverted index.

Every rule is a regex. From its parse tree follows a Boolean query over trigrams that any
match must contain: literal runs give trigrams, alternatives give OR, runs that follow
each other give AND. The index holds postings (trigram, document) for the trigrams that
some query asks for, over whole lower-cased texts. A document whose postings satisfy a
rule's query is a candidate and is verified with the regex itself; rules without
mandatory trigrams (long hexadecimal runs) scan every text.

Only DataFrame functions run here; the regexes are parsed once, when the plan is made.
Spans of a text are found by splitting it at the matches: pieces and matches together are
the text, so their running lengths are the positions.

Spans are code points, end exclusive, leftmost and non-overlapping per kind. Defined
results: a null text is empty and has no spans; repeated rows give repeated results; null
ids are kept; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import itertools
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.llm.common import table, text_of
from rivermark.registry import query

with warnings.catch_warnings():
    warnings.simplefilter("ignore", DeprecationWarning)
    import sre_parse

#: Alternatives that a literal run may have before it is cut.
MAX_STRINGS = 64
#: Characters of a class that still count as alternatives.
MAX_CLASS = 4


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules and public formats of keys. ``{16,}`` and ``{14,}`` keep
# runs of 16 and 18 characters: a run of one character class has only one longest match.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

#: A conjunction of alternatives, each a set of trigrams that must all be there.
Query = list[list[frozenset[str]]]


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _alternatives(strings: set[str]) -> Query:
    """The query of a literal run; nothing is mandatory if one alternative is too short."""
    sets = {_grams(s) for s in strings}
    if frozenset() in sets:
        return []
    # An alternative that asks for more than another adds nothing to an OR.
    return [sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)]


def _walk(items) -> tuple[set[str] | None, Query]:
    """The exact strings of a sequence if they are few, and the query of what lies around them."""
    run: set[str] = {""}
    found: Query = []
    exact = True

    def gap() -> None:
        nonlocal run, exact
        found.extend(_alternatives(run))
        run, exact = {""}, False

    def take(strings: set[str] | None) -> None:
        nonlocal run
        if strings is None:
            gap()
            return
        if len(run) * len(strings) > MAX_STRINGS:
            gap()
        run = {a + b for a, b in itertools.product(run, strings)}

    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            take({chr(arg).lower()})
        elif name == "IN":
            take(_class(arg))
        elif name == "SUBPATTERN":
            strings, inner = _walk(arg[-1])
            take(strings)
            found.extend(inner)
        elif name == "BRANCH":
            parts = [_walk(part) for part in arg[1]]
            if all(strings is not None for strings, _ in parts):
                take(set().union(*[strings for strings, _ in parts]))
            else:
                gap()
                # One conjunct of each alternative is enough for a sound OR.
                whole = [(_alternatives(s) if s is not None else []) + q for s, q in parts]
                if all(whole):
                    found.append([g for q in whole for g in q[0]])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            strings, around = _walk(inner)
            if (low, high) == (0, 1) and strings is not None:
                take(strings | {""})
            elif low:
                for _ in range(min(int(low), 4)):
                    take(strings)
                found.extend(around)
                if low != high or low > 4:
                    gap()
            else:
                gap()
        elif name != "AT":
            gap()
    if exact:
        return run, found
    found.extend(_alternatives(run))
    return None, found


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out.add(chr(arg).lower())
        elif name == "RANGE" and arg[1] - arg[0] < MAX_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MAX_CLASS + 2 else None


def trigram_query(pattern: str) -> Query:
    """What must be in a lower-cased text that the pattern matches; empty if nothing must."""
    strings, found = _walk(sre_parse.parse(pattern))
    return found + (_alternatives(strings) if strings is not None else [])


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, doc_id, mark: the index of whole texts, for the trigrams that queries ask for."""
    low = docs.select("doc_id", F.xxhash64(text_of()).alias("mark"), F.lower(text_of()).alias("low"))
    there = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return low.select("doc_id", "mark", F.explode(there).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """doc_id, mark, kinds: documents whose postings satisfy some rule's query.

    Postings meet by document, at most one of each trigram, so no list grows with the
    corpus.
    """
    have = index.groupBy("doc_id", "mark").agg(F.collect_set("trigram").alias("have"))

    def holds(q: Query) -> Column:
        every = F.lit(True)
        for alternatives in q:
            some = F.lit(False)
            for grams in alternatives:
                some = some | (F.size(F.array_except(F.array(*map(F.lit, sorted(grams))), F.col("have"))) == 0)
            every = every & some
        return every

    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in queries.items()]))
    return have.select("doc_id", "mark", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _spans(rule: Rule, rank: int) -> Column:
    """Spans of one rule in the column ``text``, as (start, rank, kind, end)."""
    pattern = F.lit(rule.pattern)
    hit = F.regexp_extract_all("text", pattern, F.lit(0))
    value = F.regexp_extract_all("text", pattern, F.lit(rule.group))
    gaps = F.split("text", rule.pattern, -1)
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(hit)).alias("gap"), hit.alias("hit"), value.alias("value"))
    nothing = F.expr("cast(array() as array<struct<start: int, rank: int, kind: string, end: int>>)")

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        more = F.when(F.length(part["value"]) >= rule.least, F.array_append(state["out"], one)).otherwise(state["out"])
        return F.struct(end.alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
    return F.when(F.col("text").rlike(rule.pattern), F.aggregate(parts, start, add, lambda s: s["out"])).otherwise(nothing)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and found (spans in order of start and rule), one row per input row."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("mark", F.xxhash64("text"))
    if queries:
        trigrams = sorted({g for q in queries.values() for part in q for grams in part for g in grams})
        picked = candidates(postings(docs, trigrams), queries).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "kinds")
        rows = rows.join(picked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    nothing = F.expr("cast(array() as array<struct<start: int, rank: int, kind: string, end: int>>)")
    each = [
        F.when(F.array_contains("kinds", r.kind), _spans(r, k)).otherwise(nothing) if r.kind in queries else _spans(r, k)
        for k, r in enumerate(rules)
    ]
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def report(found: DataFrame) -> DataFrame:
    """Counts, the checksum of the base spans and all spans as text."""
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _sql(rules: tuple[Rule, ...]) -> str:
    parts = []
    for k, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT row, {k} AS rank, '{r.kind}' AS kind, hits, vals, i, length(hits[i]) AS width,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start,
         {r.least} AS least
  FROM (SELECT row, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits,
               regexp_extract_all(t, '{p}', {r.group}) AS vals FROM d) q, unnest(range(1, len(hits) + 1)) AS u(i)""")
    counts = ", ".join(f"count(s.kind) FILTER (s.kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    text = "s.kind || ':' || s.start::BIGINT || ':' || (s.start + s.width)::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(parts)}),
s AS (SELECT * FROM a WHERE length(vals[i]) >= least)
SELECT doc_id, {counts},
  sha256(coalesce(string_agg({text}, ',' ORDER BY s.start, s.rank) FILTER (s.rank < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({text}, ',' ORDER BY s.start, s.rank), '') AS spans
FROM d LEFT JOIN s ON s.row = d.row GROUP BY d.row, doc_id
"""


@query("op1_secret_scan", _sql(BASE + MORE))
def op1_secret_scan(spark, sf_dir):
    return report(scan(table(spark, sf_dir, "documents")))

