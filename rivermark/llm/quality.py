"""Quality by weak supervision: rules vote or abstain, EM weighs them.

Each rule looks at counts of the whole text and votes good, votes bad or abstains. How
far each rule can be trusted is not set by hand: expectation-maximisation fits, per rule
and class, how often it votes good, bad or not at all, and the share of good documents.
A document is kept when its posterior probability of being good reaches ``KEEP`` and the
base limits hold.

A document enters the fit only through its votes, so documents fold to vote patterns
first: with nine rules at most 3 ** 9 rows whatever the corpus holds. Each EM round is one
aggregate over that small table and every document counts in it.

Only DataFrame functions run here. Windows of eight words are compared by hash: a text
without two equal 64-bit hashes has no repeated window; in the others windows count as
equal when 96 bits agree.

Defined results: null and empty texts have no words and fail the base limits; repeated
rows count as often as they occur; a null id is kept as it is; an empty table gives no
rows. Only ``doc_id`` and ``text`` are read by ``verdicts``; ``good_documents`` returns
the input's columns, whatever their names.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.llm.common import SPACES, staged, table, text_of, words_of
from rivermark.registry import query

KEEP, WINDOW = 0.5, 8
#: Most EM rounds, and the largest change of a rate at which they end.
ROUNDS, STILL = 60, 1e-4
MIN_WORDS, MAX_REPEATED = 20, 30
#: Common function words of the four languages of the corpus; a parameter of ``verdicts``.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "with",
    "le", "la", "les", "des", "et", "de", "que", "un", "une", "est",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "nicht",
    "el", "los", "las", "del", "y", "en", "por", "con", "no", "para",
)


def counts(docs: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """doc_id with the counts that rules look at, over whole texts."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    base = docs.select("doc_id", text_of().alias("text")).withColumn("words", words_of(F.col("text"))).withColumn(
        "lines", lines
    ).select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, stop_words)))).cast("long").alias("n_stop"),
    )
    at = [f"words[i + {k}]" if k else "words[i]" for k in range(WINDOW)]
    starts = f"sequence(0, size(words) - {WINDOW})"
    hashed = base.withColumn("seen", F.expr(
        f"if(size(words) < {WINDOW}, cast(array() as array<bigint>), transform({starts}, i -> xxhash64({', '.join(at)})))"
    )).withColumn("again", F.expr("size(array_distinct(seen)) < size(seen)"))
    # Only texts with a repeated window sort their windows.
    ordered = hashed.withColumn("sorted", F.expr(
        f"if(again, array_sort(transform({starts}, i -> struct(seen[i] as h, hash({', '.join(at)}) as g, i as at))),"
        " cast(array() as array<struct<h: bigint, g: int, at: int>>))"
    )).drop("words", "seen")
    same = "sorted[{0}].h = sorted[{1}].h and sorted[{0}].g = sorted[{1}].g"
    marked = ordered.withColumn("repeats", F.expr(
        "if(not again, cast(array() as array<int>), array_sort(filter(transform(sequence(0, size(sorted) - 1), k ->"
        f" case when k > 0 and {same.format('k', 'k - 1')} then sorted[k].at"
        f" when k < size(sorted) - 1 and {same.format('k', 'k + 1')} then sorted[k].at end), p -> p is not null)))"
    )).drop("sorted")
    # Windows overlap: each start adds the words since the last one, eight at most.
    return marked.withColumn("n_repeat_words", F.expr(
        f"aggregate(repeats, struct(-{WINDOW} as last, 0L as n),"
        f" (a, p) -> struct(p as last, a.n + least({WINDOW}, p - a.last) as n), a -> a.n)"
    )).drop("repeats", "again")


#: Per rule what it votes bad and what it votes good on; else it abstains.
RULES = {
    "length": ("n_words < 20", "n_words >= 30"),
    "word_length": ("word_chars < 2.5 * n_words or word_chars > 11 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "dup_lines": ("n_lines > 3 and 10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0"),
    "repeats": ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 2 * n_words"),
    "stop_words": ("n_words >= 30 and n_stop < 2", "n_stop >= 2"),
    "upper": ("2 * n_upper > word_chars", "5 * n_upper < word_chars"),
    "variety": ("n_words >= 30 and 10 * n_distinct < n_words", "4 * n_distinct >= n_words"),
    "lines": ("n_lines > 5 and n_words < 2 * n_lines", "n_words >= 5 * n_lines"),
}


def _votes() -> list[Column]:
    """v0, v1, ...: 1 bad, 2 good, 0 abstains."""
    return [F.expr(f"case when {bad} then 1 when {good} then 2 else 0 end").alias(f"v{j}") for j, (bad, good) in enumerate(RULES.values())]


def _start() -> tuple[float, list[list[list[float]]]]:
    """Share of good documents, and per rule for bad and good ones how often it abstains, votes bad, votes good."""
    return 0.8, [[[0.2, 0.3, 0.5], [0.2, 0.002, 0.798]] for _ in RULES]


def _posterior(prior: float, rates: list[list[list[float]]]) -> Column:
    """Probability of good given the votes v0, v1, ...

    All numbers stand in array literals, so the rounds of a fit share compiled code.
    """
    def side(y: int, share: float) -> Column:
        logs = [[math.log(max(p, 1e-12)) for p in r[y]] for r in rates]
        logs[0] = [x + math.log(max(share, 1e-12)) for x in logs[0]]
        return sum((F.element_at(F.lit(x), F.col(f"v{j}") + 1) for j, x in enumerate(logs[1:], 1)), F.element_at(F.lit(logs[0]), F.col("v0") + 1))

    return 1 / (1 + F.exp(side(0, 1 - prior) - side(1, prior)))


def fit(votes: DataFrame, rounds: int = ROUNDS, still: float = STILL) -> tuple[float, list[list[list[float]]]]:
    """EM over all documents' votes; one pseudo document per entry holds the start values."""
    names = [f"v{j}" for j in range(len(RULES))]
    patterns = staged(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))).coalesce(1)  # at most 3 ** rules rows
    start_prior, start = prior, rates = _start()
    for _ in range(rounds):
        weighed = patterns.withColumn("good", F.col("n") * _posterior(prior, rates)).withColumn("bad", F.col("n") - F.col("good"))
        sums = [F.sum("n").alias("n"), F.sum("good").alias("good")] + [
            F.sum(F.when(F.col(v) == k, F.col(y)).otherwise(0)).alias(f"{v}_{y}_{k}") for v in names for y in ("bad", "good") for k in range(3)
        ]
        row = weighed.agg(*sums).first()
        if not row["n"]:
            break
        totals, before = [row["n"] - row["good"], row["good"]], [prior, *itertools.chain(*itertools.chain(*rates))]
        prior = (row["good"] + start_prior) / (row["n"] + 1)
        rates = [
            [[(row[f"v{j}_{y}_{k}"] + start[j][i][k]) / (totals[i] + 1) for k in range(3)] for i, y in enumerate(("bad", "good"))]
            for j in range(len(RULES))
        ]
        if max(abs(x - y) for x, y in zip(before, [prior, *itertools.chain(*itertools.chain(*rates))])) < still:
            break
    return prior, rates


def verdicts(docs: DataFrame, keep: float = KEEP, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """doc_id, the base counts, base_failed, quality (the posterior) and kept."""
    found = counts(docs, stop_words).withColumn(
        "base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words")
    ).select("*", *_votes())
    voted = staged(found.drop("n_lines", "n_upper", "n_distinct", "n_stop"))
    quality = _posterior(*fit(voted))
    return voted.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def good_documents(docs: DataFrame, keep: float = KEEP, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The rows that are kept, with all their columns.

    The rules are weighed on all documents first; then every row is judged by its own
    votes, so nothing is joined.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    carried = docs.select(row.alias("doc_id"), "text")
    voted = counts(docs, stop_words).select(*_votes())
    quality = _posterior(*fit(voted))
    # A filter that asks for the row's number stays above the projection; pushed below, it
    # would compute the counts anew at every mention.
    judged = counts(carried, stop_words).select(
        "*", *_votes(), F.monotonically_increasing_id().alias("at")
    )
    fine = F.expr(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEATED} * n_words")
    return judged.filter(fine & (quality >= keep) & (F.col("at") >= 0)).select("doc_id.*")


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    return verdicts(table(spark, sf_dir, "documents"))
