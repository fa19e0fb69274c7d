"""Alerts on watched wallets as a stream of polls.

Each micro-batch joins its observations to the watches, takes the alerts it touches from
the state table and works out every change with the same window expressions that replay a
whole history (``monitor.alert_history``). The state table is a log: a batch writes the alerts
it touched, and every ``COMPACT`` batches all of them, so reading the state means reading
at most that many folders. Nothing is kept in Python.

Polls are meant to arrive in order. Observations of a poll that is older than the newest
one by more than the overlap are not applied, because the alert may have moved on; they
are counted per watch beside the changes.

A batch writes ``changes``, ``state``, ``late`` and ``mark`` (the newest poll) into folders of its
own number, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivermark import scale
from rivermark.operators.monitor import OVERLAP_SECONDS, RETRACTING, alert_history, watched

COMPACT = 16
KEY = ["watch_id", "event_reference"]
STATE = "watch_id string, event_reference string, state string, execution_status string, confirmation_state string, last_poll timestamp"
CHANGE = (
    "watch_id string, event_reference string, poll_time timestamp, change string, state string,"
    " execution_status string, confirmation_state string"
)


def _folders(path: str, name: str, first: int, upto: int) -> list[str]:
    return [f"{path}/{name}/batch={k}" for k in range(first, upto)]


def _state(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Alerts before a batch: the newest row of each since the last full copy."""
    first = (batch_id - 1) // COMPACT * COMPACT
    if batch_id == 0:
        return spark.createDataFrame([], STATE)
    logs = [
        spark.read.schema(STATE).parquet(folder).withColumn("_batch", F.lit(first + k))
        for k, folder in enumerate(_folders(path, "state", first, batch_id))
    ]
    rows = logs[0]
    for more in logs[1:]:
        rows = rows.unionByName(more)
    held = F.struct("state", "execution_status", "confirmation_state", "last_poll")
    return rows.groupBy(*KEY).agg(F.max_by(held, "_batch").alias("s")).select(*KEY, "s.*")


def advance(watches: DataFrame, path: str, overlap_seconds: int = OVERLAP_SECONDS):
    """``foreachBatch`` step that applies one micro-batch of observations with ``poll_time``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def write(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

        newest = None
        if batch_id:
            newest = spark.read.schema("newest long").parquet(*_folders(path, "mark", batch_id - 1, batch_id)).first().newest
        # Read for the late rows, the kept ones and their alerts: joined and written once.
        seen = scale.staged(watched(batch, watches))
        late = F.lit(False) if newest is None else F.coalesce(F.unix_micros("poll_time") < newest - overlap_seconds * 1_000_000, F.lit(False))
        write(seen.filter(late).groupBy("watch_id").agg(F.count(F.lit(1)).alias("late")), "late")
        kept = seen.filter(~late).filter(F.col("reason").isNull() | F.col("reason").isin(*RETRACTING))
        before = _state(spark, path, batch_id)
        told = scale.cut(alert_history(kept, before.join(kept.select(*KEY).distinct(), KEY, "left_semi")))
        write(told.filter("change IS NOT NULL").select(*KEY, "poll_time", "change", "state", "execution_status", "confirmation_state"), "changes")
        last = F.max_by(F.struct("state", "execution_status", "confirmation_state", F.col("poll_time").alias("last_poll")), "poll_time")
        touched = told.groupBy(*KEY).agg(last.alias("s")).select(*KEY, "s.*")
        if batch_id % COMPACT == 0:
            touched = touched.unionByName(before.join(told.select(*KEY).distinct(), KEY, "left_anti"))
        write(touched, "state")
        mark = batch.agg(F.max(F.unix_micros("poll_time")).alias("newest"))
        write(mark.select(F.greatest("newest", F.lit(newest).cast("long")).alias("newest")), "mark")

    return step


def run_once(
    observations: DataFrame, watches: DataFrame, path: str | None = None, overlap_seconds: int = OVERLAP_SECONDS,
    options: dict[str, str] | None = None,
) -> str:
    """Process every poll that is available, then stop. Returns the folder of the results.

    The stream's checkpoint and output live in the session's shared folder.
    """
    spark = observations.sparkSession
    scale._checkpoint_ready(spark)
    path = path or f"{spark.sparkContext.getCheckpointDir()}/watch-{uuid.uuid4().hex}"
    writer = observations.writeStream.foreachBatch(advance(watches, path, overlap_seconds)).option("checkpointLocation", f"{path}/offsets")
    writer.options(**(options or {})).trigger(availableNow=True).start().awaitTermination()
    return path


def changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGE).parquet(f"{path}/changes")


def late(spark: SparkSession, path: str) -> DataFrame:
    """Per watch how many observations came too late to be applied."""
    rows = spark.read.schema("watch_id string, late long").parquet(f"{path}/late")
    return rows.groupBy("watch_id").agg(F.sum("late").alias("late"))
