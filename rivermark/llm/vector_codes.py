"""Vector code compression: a codebook per part, fitted with norm-of-sum bounds.

A vector becomes integers ``floor(4096 * x)`` and is cut into equal parts; each part is
coded by the nearest entry of the codebook of its position. Every round assigns all parts
and moves each entry to the floor of the mean of its parts.

Most parts keep their entry from round to round. Each part therefore carries an upper
bound of the distance to its entry and a lower bound of the distance to every other one,
each with the round it was measured in. All codebooks so far are kept, so a bound of round
``s`` is brought to round ``t`` by the distance between the entry then and now: the norm of
the sum of all moves, which is never more than the sum of their norms that running
bounds add up. Only where the bounds touch is the distance to the own entry measured
again, and only where that does not settle it are all entries.

Each round is one pass over the table, written to the shared folder with the vectors and
their bounds; a task adds one row with its sums, so failed and repeated attempts count
once. The copy before the last is removed. The driver holds the codebooks alone
(``entries`` vectors a round).

Defined results: rows whose vector is null or has null or non-finite components are left
out. Where lengths differ, the most frequent length is the table's (the larger one of
equally frequent ones); vectors of other lengths, and all if that length cannot be cut into
the parts, get a null code and error. With fewer rows than entries the codebooks are that
much smaller. Repeated rows count each time; equal ids go by their vectors, null ids come last. An empty table gives no
rows. Whole numbers are exact up to an absolute component of 16384 at 64 dimensions; a
larger one raises an error instead of a wrong code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivermark.llm.common import Copies, table
from rivermark.registry import query
from rivermark.scale import dim_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bounds are widened by this share, far more than the rounding of their square roots.
SLACK = 1e-6


@dataclass
class Coded:
    """``rows`` has ``id``, the columns kept, ``code`` and ``error``; ``codebooks`` is (parts, entries, width)."""

    rows: DataFrame
    codebooks: np.ndarray


def moves(history: np.ndarray) -> np.ndarray:
    """Distance from each entry of each earlier codebook to the same entry of the last."""
    return np.sqrt(((history - history[-1]).astype(np.float64) ** 2).sum(-1))


def _two_least(part: np.ndarray, book: np.ndarray):
    """Nearest entry (the lower one of equals), its squared distance and that of the next."""
    d = ((part[:, None, :] - book[None]) ** 2).sum(-1)
    own = d.argmin(1)
    at = np.arange(len(d))
    least = d[at, own]
    if len(book) == 1:
        return own, least, np.full(len(d), np.inf)
    d[at, own] = np.iinfo(np.int64).max
    return own, least, d.min(1).astype(np.float64)


def _low(squared: np.ndarray) -> np.ndarray:
    return (np.sqrt(squared) * (1 - SLACK)).astype(np.float32)


def _high(squared: np.ndarray) -> np.ndarray:
    return (np.sqrt(squared.astype(np.float64)) * (1 + SLACK)).astype(np.float32)


class Bounds:
    """Entry, bounds and their rounds of one part position over a batch of vectors."""

    def __init__(self, n: int):
        self.own = np.zeros(n, np.uint8)
        self.high, self.low = np.full(n, np.inf, np.float32), np.zeros(n, np.float32)
        self.high_at, self.low_at = np.zeros(n, np.uint8), np.zeros(n, np.uint8)

    def assign(self, part: np.ndarray, books: np.ndarray, gone: np.ndarray) -> int:
        """Bring all entries to the last of ``books``; the number of full scans."""
        now, rows = len(books) - 1, np.arange(len(part))
        if now == 0:
            scan = rows
        else:
            others = gone.copy()
            if gone.shape[1] > 1:
                ranked = np.sort(gone, axis=1)
                most = gone.argmax(1)
                others = np.repeat(ranked[:, -1:], gone.shape[1], 1)
                others[np.arange(len(gone)), most] = ranked[:, -2]
            low = self.low.astype(np.float64) - others[self.low_at, self.own] * (1 + SLACK)
            high = self.high.astype(np.float64) + gone[self.high_at, self.own] * (1 + SLACK)
            doubt = np.flatnonzero(high >= low)
            mine = ((part[doubt] - books[now][self.own[doubt]]) ** 2).sum(-1)
            self.high[doubt], self.high_at[doubt] = _high(mine), now
            scan = doubt[self.high[doubt] >= low[doubt]]
        if len(scan):
            own, least, second = _two_least(part[scan], books[now])
            self.own[scan], self.high[scan], self.low[scan] = own, _high(least), _low(second)
            self.high_at[scan] = self.low_at[scan] = now
        return len(scan)

    def pack(self) -> np.ndarray:
        return np.concatenate(
            [self.own[:, None], self.high_at[:, None], self.low_at[:, None],
             self.high[:, None].view(np.uint8), self.low[:, None].view(np.uint8)], axis=1)

    @classmethod
    def unpack(cls, raw: np.ndarray) -> Bounds:
        out = cls(0)
        out.own, out.high_at, out.low_at = (raw[:, k].copy() for k in range(3))
        out.high, out.low = (np.ascontiguousarray(raw[:, k : k + 4]).view(np.float32)[:, 0] for k in (3, 7))
        return out


def _fixed(column: pa.Array, kind: type, n: int) -> np.ndarray:
    """A binary column whose values have equal length, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1).copy()


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())


def _whole(vectors: pa.Array, width: int) -> np.ndarray:
    """Components as whole numbers, refused where squared distances could leave 64 bits."""
    scaled = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if scaled.size and np.abs(scaled).max() * 2 * np.sqrt(width) >= 2**31:
        raise ValueError(f"a component of {np.abs(scaled).max() / SCALE:g} is too large for 64-bit squared distances")
    return scaled.astype(np.int32).reshape(len(vectors), width)


def _parted(whole: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(whole.astype(np.int64), parts, axis=1)


def _round(books: np.ndarray, last: bool, state: bool, schema: pa.Schema):
    """One pass: assign every part and hand on state and sums, or code and error in the last."""
    parts, entries, width = books.shape[1], books.shape[2], books.shape[3] * books.shape[1]
    gone = [moves(books[:, p]) for p in range(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width // parts), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            whole = _fixed(batch.column("v"), np.int32, n) if state else _whole(batch.column("v"), width)
            whole = whole.reshape(n, width)
            raw = _fixed(batch.column("bounds"), np.uint8, n).reshape(n, parts, -1) if state else None
            held, error = [], np.zeros(n, np.int64)
            for p, part in enumerate(_parted(whole, parts)):
                bounds = Bounds.unpack(raw[:, p]) if state else Bounds(n)
                bounds.assign(part, books[:, p], gone[p])
                held.append(bounds)
                if last:
                    error += ((part - books[-1, p][bounds.own]) ** 2).sum(-1)
                else:
                    np.add.at(sums[p], bounds.own, part)
                    counts[p] += np.bincount(bounds.own, minlength=entries)
            columns = {name: batch.column(name) for name in batch.schema.names if name not in ("v", "bounds")}
            if last:
                columns["code"] = pa.array(["".join(f"{b.own[i]:02x}" for b in held) for i in range(n)], pa.string())
                columns["error"] = pa.array(error)
            else:
                columns["v"] = _binary(whole)
                columns["bounds"] = _binary(np.stack([b.pack() for b in held], 1).reshape(n, -1))
            yield _batch(columns, n, schema)
        if not last:
            yield _batch({"sums": pa.array([sums.ravel().tolist()]), "counts": pa.array([counts.ravel().tolist()])}, 1, schema)

    return run


def _batch(columns: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _totals(written: DataFrame, name: str, size: int) -> list[int]:
    """Exact column totals of the tasks' rows; ``size`` numbers reach the driver."""
    each = written.filter(F.col(name).isNotNull()).select(F.posexplode(name).alias("at", "x"))
    found = {r.at: int(r.x) for r in each.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}
    return [found.get(k, 0) for k in range(size)]


def moved(book: np.ndarray, sums: list[int], counts: list[int]) -> np.ndarray:
    """Entries at the floor of their mean; those without parts stay."""
    out, width = book.copy().reshape(-1, book.shape[-1]), book.shape[-1]
    for k, count in enumerate(counts):
        if count:
            out[k] = [s // count for s in sums[k * width : (k + 1) * width]]
    return out.reshape(book.shape)


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (),
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> Coded:
    """Codes and errors of all vectors; ``keep`` names further columns to carry along."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = vectors.sparkSession
    x = F.col("v")
    rows = vectors.select(F.col(id_column).alias("id"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], F.col(vector).alias("v"))
    rows = rows.filter(x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    kept = [f for f in rows.schema if f.name != "v"]
    done = T.StructType([*kept, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    named = [F.col("id").alias(id_column), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "code", "error"]
    sizes = rows.groupBy(F.size(x).alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    width = sizes.n if sizes else 0
    if not width or width % parts:
        return Coded(rows.select(*[f.name for f in kept], F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")).select(named), np.zeros((parts, 0, 0), np.int64))
    regular, odd = rows.filter(F.size(x) == width), rows.filter(F.size(x) != width)
    first = regular.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.stack([np.floor(SCALE * np.array(r.v, np.float64)) for r in first])
    books = start.astype(np.int64).reshape(1, len(first), parts, width // parts).transpose(0, 2, 1, 3)

    more = [("v", T.BinaryType()), ("bounds", T.BinaryType()), ("sums", T.ArrayType(T.LongType())), ("counts", T.ArrayType(T.LongType()))]
    between = T.StructType([*kept, *[T.StructField(n, t) for n, t in more]])
    copies, state = Copies(spark), regular
    for k in range(rounds):
        run = _round(books, False, k > 0, to_arrow_schema(between))
        written = copies.write("state", state.mapInArrow(run, between))
        copies.drop("state", keep=1)
        sums = _totals(written, "sums", books[-1].size)
        books = np.concatenate([books, moved(books[-1], sums, _totals(written, "counts", books[-1][..., 0].size))[None]])
        state = written.filter(F.col("v").isNotNull()).drop("sums", "counts")
    coded = state.mapInArrow(_round(books, True, rounds > 0, to_arrow_schema(done)), done)
    coded = copies.write("codes", coded)
    copies.drop("state")
    unfit = odd.select(*[f.name for f in kept], F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return Coded(coded.unionByName(unfit).select(named), books[-1])


def report(coded: Coded, id_column: str = "vec_id", label: str = "label") -> DataFrame:
    """Codes with the error of their label and a digest of the codebooks."""
    totals = coded.rows.groupBy(label).agg(F.sum("error").alias("label_error"))
    # The join key has no null: its first part says whether there is a label.
    mark = F.struct(F.col(label).isNull().alias("none"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"))
    sums = totals.select(mark.alias("_of"), "label_error")
    sha = hashlib.sha256(",".join(str(n) for n in coded.codebooks.ravel().tolist()).encode()).hexdigest()
    return dim_join(coded.rows.withColumn("_of", mark), sums, ["_of"], "left", [id_column, "code"]).select(
        id_column, "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rounds as joins of parts with codebooks."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT rn, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM (
    SELECT p.rn, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d
    FROM parts p JOIN book{k} b USING (part, pos) GROUP BY ALL)
  GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""
book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT n.part, n.entry, p.pos, ((sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM near{k} n JOIN parts p USING (rn, part) GROUP BY ALL) m USING (part, entry, pos))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS rn FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
parts AS MATERIALIZED (
  SELECT rn, (i * {parts}) // len(embedding) AS part, i % (len(embedding) // {parts}) AS pos,
    floor(4096 * embedding[i + 1]::DOUBLE)::BIGINT AS x
  FROM kept, unnest(range(len(embedding))) u(i)),
book0 AS MATERIALIZED (SELECT part, rn AS entry, pos, x FROM parts WHERE rn < {entries}),
{",".join(steps)},
coded AS (
  SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY rn),
sha AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{rounds})
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, s.codebooks_sha256
FROM coded c JOIN kept k USING (rn), sha s"""


@query("op11_vector_codes", _sql())
def op11_vector_codes(spark, sf_dir):
    return report(compress(table(spark, sf_dir, "embeddings"), keep=("label",)))
