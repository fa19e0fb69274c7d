import hashlib

from pyspark.sql import functions as F

from rivermark.operators import dataset as ds
from rivermark.plans import dataset as plans


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def weeks(spark, wallets=80):
    """Windows that are alike but for one train wallet, unusual only in the count of missing block numbers."""
    ids = [digest(f"n0:u{k}")[:16] for k in range(wallets)]
    odd = max(range(wallets), key=lambda k: digest(f"7:{ids[k]}"))
    assert ids[odd] != min(ids)
    blocks = F.when(F.col("id") == odd, 900).otherwise(F.col("id") % 5).cast("double")
    wide = spark.range(wallets).select(
        F.lit("n0").alias("network"), F.concat(F.lit("u"), "id").alias("address"), F.lit(0).alias("window_start"), F.lit(1).alias("window_end"),
        F.lit("LIVE").alias("data_mode"), F.concat(F.lit("cat"), F.col("id") % 3).alias("control_category"), F.lit("r1").alias("run_id"),
        *[(blocks if n == "block_number_missing_count" else F.lit(1.0)).alias(n) for n in plans.FEATURES],
    )
    return ds.wallet_windows(wide, {n: n for n in plans.FEATURES}), ids[odd]


def test_rank_sees_every_feature(spark, monkeypatch):
    rows, odd = weeks(spark)
    monkeypatch.setattr(plans, "windows", lambda spark, sf: rows)
    ranked = plans._ranked(spark, "").orderBy("rank").collect()
    assert len(ranked) == 80 and ranked[0]["id"] == f"{odd}:0"


def test_forest_is_drawn_from_train_wallets(spark, monkeypatch):
    rows, _ = weeks(spark)
    monkeypatch.setattr(plans, "windows", lambda spark, sf: rows)
    points = plans.fo.cut(plans._model_points(spark, ""))
    assert set(ds.FEATURES) <= set(points.columns) and points.filter(" OR ".join(f"`{n}` IS NULL" for n in ds.FEATURES)).count() == 0
    drawn = plans._drawn(points, plans.FOREST)
    assert {r.side for r in drawn.select("side").distinct().collect()} == {"train"}
    assert drawn.select("tree").distinct().count() == 128 and plans.fo.SAMPLE == 256
