"""Isolation forest grown from seeded digests.

Sampling, feature choice and split point come from SHA-256 of seed, tree and
node, so the forest does not depend on how rows are partitioned. Samples are at
most 256 rows per tree; everything after sampling has that fixed size, whatever
the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivermark.scale import cut, position_in

SAMPLE = 256
DEPTH = 8
OUTLIER = -0.5


def _unit(*parts: Column) -> Column:
    """Digest of the parts as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def sample(rows: DataFrame, key: str, trees: int, seed: int, size: int = SAMPLE) -> DataFrame:
    """Up to ``size`` rows per tree with the smallest digests."""
    each = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = each.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), "tree", key), 256))
    # The bound is small, so every task keeps only its own first rows before the shuffle.
    w = Window.partitionBy("tree").orderBy("_h")
    return drawn.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= size).drop("_rn", "_h")


def grow(sampled: DataFrame, features: list[str], seed: int, depth: int = DEPTH) -> DataFrame:
    """Splits as ``tree, node, feature, split, size``; children of a node are 2n and 2n+1."""
    now = cut(sampled.select("tree", F.lit(1).cast("long").alias("node"), *features))
    levels = []
    for _ in range(depth):
        ends = [f(c).alias(f"{n}_{c}") for c in features for f, n in ((F.min, "lo"), (F.max, "hi"))]
        boxes = now.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size"), *ends)
        options = F.filter(
            F.array(*[F.struct(_hash(seed, c).alias("h"), F.lit(c).alias("f"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in features]),
            lambda o: o["hi"] > o["lo"],
        )
        pick = F.array_min(options)
        u = _unit(F.lit(seed), F.col("tree"), F.col("node"), F.lit("split"))
        chosen = boxes.select("tree", "node", "size", pick.alias("p")).filter("p IS NOT NULL")
        level = cut(chosen.select("tree", "node", "size", F.col("p.f").alias("feature"), (F.col("p.lo") + u * (F.col("p.hi") - F.col("p.lo"))).alias("split")))
        levels.append(level)
        x = F.coalesce(*[F.when(F.col("feature") == c, F.col(c)) for c in features])
        now = cut(
            now.join(level.drop("size"), ["tree", "node"])
            .withColumn("node", F.col("node") * 2 + (x >= F.col("split")).cast("long"))
            .drop("feature", "split")
        )
    return reduce(DataFrame.unionByName, levels)


def _hash(seed: int, name: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col("tree"), F.col("node"), F.lit(name)), 256)


def _average(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    out[big] = 2 * (np.log(n[big] - 1) + np.euler_gamma) - 2 * (n[big] - 1) / n[big]
    return out


def score(rows: DataFrame, splits: DataFrame, sampled: DataFrame, features: list[str], depth: int = DEPTH) -> DataFrame:
    """Add ``score``: lower is more isolated.

    The model has at most trees * 255 nodes; that table is what travels to the
    tasks. Rows are scored where they are, batch by batch.
    """
    at = {f: i for i, f in enumerate(features)}
    counts = {r["tree"]: r["n"] for r in sampled.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()}
    width = 2 ** (depth + 1)
    trees = sorted(counts)
    feature, split = np.full((len(trees), width), -1), np.zeros((len(trees), width))
    held = np.zeros((len(trees), width))
    place = {t: i for i, t in enumerate(trees)}
    for r in splits.collect():
        feature[place[r["tree"]], r["node"]], split[place[r["tree"]], r["node"]] = at[r["feature"]], r["split"]
    walk = cut(sampled)
    for r in _leaf_sizes(walk, splits, features, depth).collect():
        held[place[r["tree"]], r["node"]] = r["n"]
    norm = float(_average(np.array([np.mean(list(counts.values()))]))[0]) or 1.0
    model = rows.sparkSession.sparkContext.broadcast((feature, split, held))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feats, cuts, sizes = model.value
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            total = np.zeros(len(pdf))
            for t in range(feats.shape[0]):
                node, steps = np.ones(len(pdf), dtype=int), np.zeros(len(pdf))
                for _ in range(depth):
                    f = feats[t, node]
                    inner = f >= 0
                    right = x[np.arange(len(pdf)), np.where(inner, f, 0)] >= cuts[t, node]
                    node = np.where(inner, node * 2 + right, node)
                    steps += inner
                total += steps + _average(sizes[t, node])
            yield pdf.assign(score=-np.power(2.0, -(total / feats.shape[0]) / norm))

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def _leaf_sizes(sampled: DataFrame, splits: DataFrame, features: list[str], depth: int) -> DataFrame:
    """Sampled rows that end in each node."""
    now = sampled.select("tree", *features).withColumn("node", F.lit(1).cast("long"))
    model = F.broadcast(splits.drop("size"))
    x = F.coalesce(*[F.when(F.col("feature") == c, F.col(c)) for c in features])
    for _ in range(depth):
        moved = F.when(F.col("split").isNull(), F.col("node")).otherwise(F.col("node") * 2 + (x >= F.col("split")).cast("long"))
        now = now.join(model, ["tree", "node"], "left").withColumn("node", moved).drop("feature", "split")
    return now.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"))


def rank(scored: DataFrame, key: str) -> DataFrame:
    """Position by score, ties by key, without ordering the table in one place.

    Scores lie between -1 and 0: 65536 coarse cells are counted globally, and the
    exact order is settled inside each cell by score and key prefix.
    """
    s = scored.withColumn("_c", F.floor(F.col("score") * 65536)).withColumn("_p", F.substring(key, 1, 3))
    inner = position_in(s, ["_c"], [F.col("score"), F.col(key)], ["score", "_p"], "_in")
    sizes = s.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return inner.join(offsets, "_c").withColumn("rank", (F.col("_in") + F.col("_o")).cast("long")).withColumn(
        "is_outlier", F.col("score") < OUTLIER
    ).drop("_c", "_p", "_in", "_o")


def precision_at_k(ranked: DataFrame, k: int, worthy: tuple[str, ...], confounders: tuple[str, ...], negatives: tuple[str, ...]) -> DataFrame:
    """Share of review-worthy wallets among the first k, against the base rate.

    Wallets without a category, or with one outside the rubric, enter no ratio; a
    class that is absent gives NULL, not zero.
    """
    c, top = F.col("control_category"), F.col("rank") <= k
    known = F.coalesce(c.isin(*worthy, *confounders, *negatives), F.lit(False))
    n = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    t = ranked.agg(
        n(known).alias("labeled"), n(c.isNull()).alias("unlabeled"), n(c.isNotNull() & ~known).alias("outside"),
        n(known & c.isin(*worthy)).alias("worthy"), n(known & c.isin(*confounders)).alias("confounders"),
        n(top & known).alias("labeled_top"), n(top & known & c.isin(*worthy)).alias("worthy_top"), n(top & known & c.isin(*confounders)).alias("confounders_top"),
    )
    some = F.col("worthy") > 0
    return t.select(
        "*", F.when(some, F.try_divide("worthy_top", "labeled_top")).alias("precision"), F.when(some, F.try_divide("worthy", "labeled")).alias("baseline"),
        F.try_divide("confounders_top", "labeled_top").alias("confounder_fraction"),
    )
