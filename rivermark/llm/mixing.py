"""Sources mixed to target weights by Poisson replication.

A source whose share of the corpus should be ``w`` gets the mean repetition rate
``w * epochs * total / size``. Each document draws its number of copies from the Poisson
distribution with that mean, by inverting the distribution at a number in [0, 1) that is
a hash of seed and document: no state, and the same draw on every run. Copies are
exploded and dealt out globally by a second hash.

Sizes are code points plus one end mark per document. Rates above ``PIECE`` are drawn as
a sum of Poisson numbers with equal smaller means, so nothing underflows.

Defined results: a null source is a source of its own; without ``weights`` a source
weighs the square root of its size; a source missing in ``weights`` weighs nothing and
its documents get no copies; a null id is replaced by a hash of the text in the draw;
rows that repeat a document draw the same number; an empty table gives no rows. Columns
of the input keep their names, but one called like an added column (``mix_rate``,
``mix_copies``, ``mix_copy``, ``mix_order``) gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.llm.common import staged, table, text_of
from rivermark.registry import query
from rivermark.scale import dim_join

SEED, PIECE = 20, 16.0
ADDED = ("mix_rate", "mix_copies", "mix_copy", "mix_order")


def _uniform(text: Column) -> Column:
    """52 bits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """mix_key, mix_rate, the number of Poisson pieces and the pieces' cumulative distribution."""
    sizes = docs.groupBy(_source_key().alias("mix_key")).agg(F.sum(F.length(text_of()) + 1).cast("double").alias("size"))
    weight = F.pow("size", F.lit(0.5))
    if weights is not None:
        pairs = [F.lit(x) for s, w in weights.items() for x in ("n" if s is None else f"s{s}", float(w))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("mix_key")), F.lit(0.0)) if pairs else F.lit(0.0)
    weighed = sizes.withColumn("weight", weight)
    total = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_size") * epochs / F.col("size"))
    out = weighed.join(F.broadcast(total)).withColumn("mix_rate", F.coalesce(rate, F.lit(0.0)))  # total is one row
    out = out.withColumn("mix_pieces", F.greatest(F.ceil(F.col("mix_rate") / PIECE), F.lit(1)).cast("int"))
    # Up to a mean of 16, P(X > 80) is below 2 ** -52, the step of the uniform number.
    steps = F.expr("""
        aggregate(sequence(1, 80), named_struct('p', exp(-mix_rate / mix_pieces), 'c', array(exp(-mix_rate / mix_pieces))),
          (a, k) -> named_struct('p', a.p * (mix_rate / mix_pieces) / k,
                                 'c', concat(a.c, array(element_at(a.c, -1) + a.p * (mix_rate / mix_pieces) / k))), a -> a.c)
    """)
    return out.select("mix_key", "mix_rate", "mix_pieces", steps.alias("mix_cdf"))


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def replicated(
    docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: int = SEED
) -> DataFrame:
    """The input's columns with mix_rate, mix_copies, mix_copy and mix_order, one row per copy."""
    doc = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(text_of().cast("binary"))))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), _source_key().alias("mix_key"), doc.alias("mix_doc")
    )
    joined = dim_join(rows, staged(rates(docs, weights, epochs)), ["mix_key"], "inner", ["mix_doc"])
    drawn = joined.withColumn("mix_draws", F.transform(
        F.sequence(F.lit(1), F.col("mix_pieces")), lambda j: _uniform(F.concat(F.col("mix_doc"), F.lit(":"), j.cast("string")))
    )).withColumn("mix_copies", F.expr(
        "aggregate(mix_draws, 0, (n, u) -> n + size(filter(mix_cdf, c -> c <= u)))"
    ))
    copies = drawn.filter("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    order = F.md5(F.concat(F.col("mix_doc"), F.lit(":copy:"), F.col("mix_copy").cast("string")))
    own = [F.col(f"mix_row.`{c}`") for c in docs.columns if c not in ADDED]
    return copies.withColumn("mix_order", order).select(*own, *ADDED)


def mixed(
    docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: int = SEED
) -> DataFrame:
    """``replicated`` in a random global order: dealt by one hash, sorted by it inside."""
    copies = replicated(docs, weights, epochs, seed)
    return copies.repartition("mix_order").sortWithinPartitions("mix_order")


SQL = """
WITH d AS (
  SELECT *, coalesce('s' || source, 'n') AS k, '20:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS m FROM documents),
s AS (SELECT k, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM d GROUP BY k),
r AS (SELECT k, sqrt(size) / (SELECT sum(sqrt(size)) FROM s) * (SELECT sum(size) FROM s) / size AS rate FROM s),
p AS (SELECT k, rate, greatest(ceil(rate / 16.0), 1)::INT AS pieces FROM r),
n AS (SELECT k, j, sum(exp(-rate / pieces + i * ln(rate / pieces) - lgamma(i + 1)))
        OVER (PARTITION BY k, j ORDER BY i) AS c
      FROM p, unnest(range(1, pieces + 1)) AS t(j), unnest(range(0, 81)) AS u(i)),
b AS (SELECT k, j, list(c ORDER BY c) AS cdf FROM n GROUP BY k, j),
x AS (SELECT d.*, p.rate, (SELECT sum(len(list_filter(cdf, lambda c: c <=
          ('0x' || substr(md5(m || ':' || j::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0)))
        FROM b WHERE b.k = d.k)::INT AS copies FROM d JOIN p ON d.k = p.k)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS mix_rate, copies AS mix_copies, i::INT AS mix_copy,
       md5(m || ':copy:' || i::VARCHAR) AS mix_order
FROM x, unnest(range(1, copies + 1)) AS t(i)
"""


@query("op7_source_mixing", SQL)
def op7_source_mixing(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents")).withColumn("mix_rate", F.round("mix_rate", 6))
