"""Splitting hot keys must not change results."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rivermark import scale
from rivermark.operators import behaviour, casework, patterns


def skewed(spark, n=1500):
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.6 else f"k{r.randrange(40)}", r.randrange(4000), r.choice("io"), f"e{i}") for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, side string, ref string")


def test_previous_row_and_nearest_before(spark):
    df = skewed(spark)
    cells = scale.with_cells(df, ["k"], F.col("t"), 100, hot_rows=50)
    assert cells.filter("_hot").select("_cell").distinct().count() > 20
    got = scale.previous_row(cells, ["k"], ["t", "ref"], ["ref"])
    plain = df.withColumn("want", F.lag("ref").over(Window.partitionBy("k").orderBy("t", "ref")))
    joined = got.join(plain.select("ref", "want"), "ref")
    assert joined.filter("NOT (prev.ref <=> want)").count() == 0

    near = scale.nearest_before(cells, ["k"], "t", F.col("side") == "i", F.struct("t", "ref"))
    w = Window.partitionBy("k").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("want", F.max(F.when(F.col("side") == "i", F.struct("t", "ref"))).over(w))
    assert near.join(want.select("ref", "want"), "ref").filter("NOT (before <=> want)").count() == 0


def test_positions_and_totals(spark):
    df = skewed(spark).withColumn("c", F.floor(F.col("t") / 50))
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("t", "ref")).cast("long"))
    got = scale.position_in(df, ["k"], [F.col("t"), F.col("ref")], ["c"])
    assert got.join(want.select("ref", "want"), "ref").filter("position <> want").count() == 0
    everywhere = scale.position_in(df, [], [F.col("t"), F.col("ref")], ["c"])
    assert sorted(r[0] for r in everywhere.select("position").collect()) == list(range(1, 1501))


def test_running_before(spark):
    cells = scale.with_cells(skewed(spark), ["k"], F.col("t"), 100, hot_rows=50)
    got = scale.running_before(cells, ["k"], ["t", "ref"], {"s": (F.sum, F.col("t")), "m": (F.min, F.col("ref"))})
    w = Window.partitionBy("k").orderBy("t", "ref").rowsBetween(Window.unboundedPreceding, -1)
    want = skewed(spark).select("ref", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("ws"), F.min("ref").over(w).alias("wm"))
    assert got.join(want, "ref").filter("s <> ws OR NOT (m <=> wm)").count() == 0


def test_rules_do_not_depend_on_hot_threshold(spark):
    from rivermark.sources import tables

    from rivermark.functions.predicates import spendable

    d = "/root/testdata/sf0.001"
    events = tables.hub(tables.ledger(spark, d).filter(spendable()))
    a = patterns.rapid_pairs(events, ["network_key"]).select("in_reference", "out_reference")
    b = patterns.rapid_pairs(events, ["network_key"], cell_seconds=600, hot_rows=10).select("in_reference", "out_reference")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 < a.count()
    rows, acc = tables.observations(spark, d), tables.accounts(spark, d)
    c = behaviour.receipt_to_outflow(rows, acc)
    e = behaviour.receipt_to_outflow(rows, acc, cell_us=3_600_000_000, hot_rows=5)
    assert c.exceptAll(e).count() == e.exceptAll(c).count() == 0 < c.count()
    f = behaviour.gap_summary(c)
    g = behaviour.gap_summary(c, hot_cell_us=60_000_000, hot_rows=2)
    assert f.exceptAll(g).count() == g.exceptAll(f).count() == 0
    v = rows.selectExpr("user_id % 3 AS g", "event_id % 97 AS x")
    h, i = casework.latency_percentiles(v, ["g"], "x", 10), casework.latency_percentiles(v, ["g"], "x", 10, hot_rows=5)
    assert h.exceptAll(i).count() == 0


def test_dim_join_salted_equals_broadcast(spark, monkeypatch):
    df = skewed(spark)
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3)], "k string, v int")
    a = scale.dim_join(df, dim, ["k"], "inner", ["ref"])
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 1)
    b = scale.dim_join(df, dim, ["k"], "inner", ["ref"])
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()


def test_shuffle_files_go_and_a_frame_can_be_read_again(spark):
    rows = spark.range(2000).select((F.col("id") % 50).alias("k"), "id")
    totals = rows.groupBy("k").agg(F.sum("id").alias("s"))
    both = totals.join(rows.groupBy("k").agg(F.max("id").alias("m")), "k").repartition(3, "m")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    first = sorted(both.collect())
    assert len(first) == 50 and sorted(both.collect()) == first and both.count() == 50


@pytest.mark.parametrize("small", [True, False])
def test_laid_join_leaves_other_rows_behind(spark, small):
    table = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, None), ("c", 4, True)], "k string, v int, ok boolean")
    laid = scale.Laid(table, ["k"], ["v"], "v")
    other = spark.createDataFrame([("a",), ("b",)], "k string")
    assert sorted(r.v for r in laid.join(other, small).collect()) == [1, 2, 3]
    assert [r.v for r in laid.join(other, small, "ok").collect()] == [1]
    laid.drop()
