"""Watched wallets: exclusion rules, alerts over repeated observations, poll bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivermark.functions.predicates import _is, first_reason, positive
from rivermark.scale import dim_join

RULE = "new_transfer"
OVERLAP_SECONDS = 600
RETRACTING = ("failed_execution", "reverted_execution", "removed")


def exclusion_reason() -> Column:
    """Why an observation does not qualify for the watch it was joined to."""
    involved = F.coalesce((F.col("from_address") == F.col("watch_address")) | (F.col("to_address") == F.col("watch_address")), F.lit(False))
    asset = (F.col("network_key") == F.col("watch_network")) & (F.col("token_contract") == F.col("watch_contract"))
    return first_reason(
        (~F.coalesce(asset, F.lit(False)), "unsupported_asset_contract"),
        (_is("event_kind", "approval"), "approval"),
        (~_is("event_kind", "transfer"), "not_a_transfer"),
        (_is("execution_status", "failed"), "failed_execution"),
        (_is("execution_status", "reverted"), "reverted_execution"),
        (_is("confirmation_state", "removed"), "removed"),
        (~positive(), "zero_value"),
        (~involved, "does_not_involve_watched_address"),
        (F.coalesce(F.col("block_time") < F.col("baseline"), F.lit(False)), "before_watch_scope"),
    )


def watched(observations: DataFrame, watches: DataFrame) -> DataFrame:
    """Observations of the wallets that a watch names, with the reason if they do not qualify."""
    ends = F.explode(F.array_distinct(F.array_compact(F.array("from_address", "to_address")))).alias("watch_address")
    dim = watches.select("watch_id", "watch_address", "watch_network", "watch_contract", "baseline")
    joined = dim_join(observations.select("*", ends), dim, ["watch_address"], "inner", ["event_reference"])
    return joined.withColumn("reason", exclusion_reason())


def watch_exclusions(seen: DataFrame) -> DataFrame:
    return seen.filter("reason IS NOT NULL").groupBy("watch_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def watch_alerts(seen: DataFrame) -> DataFrame:
    """Final alert per watch and event after all polls have been replayed.

    The first qualifying observation opens the alert. Later ones refresh its
    status, and the first failed, reverted or removed one retracts it. Each of
    these is a minimum or maximum over poll times, so nothing is replayed in order.
    """
    key = ["watch_id", "event_reference"]
    ok = F.col("reason").isNull()
    opened = seen.filter(ok).groupBy(*key).agg(
        F.min("poll_time").alias("first_observed_at"),
        F.min_by(F.struct("execution_status", "confirmation_state", "block_time", "from_address", "to_address", "watch_address"), "poll_time").alias("o"),
    )
    j = seen.join(opened, key)
    later = F.col("poll_time") > F.col("first_observed_at")
    back = later & F.col("reason").isin(*RETRACTING)
    known = ok & (F.col("confirmation_state") != "unknown")
    folded = j.groupBy(*key).agg(
        F.first("first_observed_at").alias("first_observed_at"), F.first("o").alias("o"),
        F.min(F.when(back, F.col("poll_time"))).alias("retracted_at"),
        F.min_by(F.struct("execution_status", "confirmation_state"), F.when(back, F.col("poll_time"))).alias("r"),
        F.max_by("confirmation_state", F.when(known, F.col("poll_time"))).alias("last_conf"),
        F.max(F.when(known, F.col("poll_time"))).alias("last_conf_at"),
        F.max(F.when(ok & (F.col("execution_status") == "success"), F.lit(1))).alias("proved"),
        F.sum((ok | back).cast("long")).alias("observations"),
    )
    gone = F.col("r.confirmation_state") == "removed"
    conf = F.when(gone & (F.coalesce(F.col("retracted_at") > F.col("last_conf_at"), F.lit(True))), "removed").otherwise(
        F.coalesce("last_conf", "o.confirmation_state")
    )
    execution = F.when(F.col("r.execution_status").isin("failed", "reverted"), F.col("r.execution_status")).when(
        (F.col("o.execution_status") == "unknown") & (F.col("proved") == 1), "success"
    ).otherwise(F.col("o.execution_status"))
    return folded.select(
        *key, "first_observed_at", F.when(F.col("retracted_at").isNull(), "active").otherwise("retracted").alias("state"),
        execution.alias("execution_status"), conf.alias("confirmation_state"), "observations",
        F.col("o.block_time").alias("block_time"), F.concat_ws(":", F.lit(RULE), "event_reference").alias("dedupe_key"),
        F.when(F.col("o.from_address") == F.col("o.to_address"), "self").when(F.col("o.from_address") == F.col("o.watch_address"), "outgoing")
        .otherwise("incoming").alias("direction"),
    )


def alert_history(seen: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Every observation that an alert takes in, with its ``change`` and the alert after it.

    ``before`` holds ``state``, ``execution_status`` and ``confirmation_state`` of alerts that
    were opened earlier. Rows of one watch and event are as many as polls saw it, which
    the overlap bounds.
    """
    key = ["watch_id", "event_reference"]
    w = Window.partitionBy(*key).orderBy("poll_time")
    earlier, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    s = seen.filter(F.col("reason").isNull() | F.col("reason").isin(*RETRACTING)).select(
        *key, "poll_time", "reason", F.col("execution_status").alias("ex"), F.col("confirmation_state").alias("conf")
    )
    held = ["state", "execution_status", "confirmation_state"]
    if before is None:
        s = s.select("*", *[F.lit(None).cast("string").alias(f"_{c}") for c in held])
    else:
        s = s.join(before.select(*key, *[F.col(c).alias(f"_{c}") for c in held]), key, "left")
    back, conf, ex = F.col("reason").isNotNull(), F.col("conf"), F.col("ex")
    first = F.min(F.when(~back, F.col("poll_time"))).over(Window.partitionBy(*key))
    known = F.col("_state").isNotNull()
    s = s.withColumn("_open", F.when(~known, first)).filter(known | (F.col("poll_time") >= F.col("_open")))
    s = s.withColumn("_gone", (F.coalesce(F.max(F.when(back, F.lit(1))).over(earlier), F.lit(0)) == 1) | F.coalesce(F.col("_state") == "retracted", F.lit(False)))
    turn = back & ~F.col("_gone")
    new_conf = F.when(~back & (conf != "unknown") | turn & (conf == "removed"), conf)
    new_ex = F.when(~back & (ex == "success") | turn & ex.isin("failed", "reverted"), ex)

    def at(value: Column, window, held: str) -> Column:
        return F.coalesce(F.last(value, True).over(window), F.col(held), F.lit("unknown"))

    s = s.withColumn("_conf", at(new_conf, earlier, "_confirmation_state")).withColumn("_ex", at(new_ex, earlier, "_execution_status"))
    moved = ((conf != "unknown") & (conf != F.col("_conf"))) | ((F.col("_ex") == "unknown") & (ex == "success"))
    kind = first_reason((F.col("poll_time") == F.col("_open"), "opened"), (turn, "retracted"), (~back & moved, "status_changed"))
    return s.select(
        *key, "poll_time", kind.alias("change"), F.when(F.col("_gone") | back, "retracted").otherwise("active").alias("state"),
        at(new_ex, upto, "_execution_status").alias("execution_status"), at(new_conf, upto, "_confirmation_state").alias("confirmation_state"),
    )


def alert_states(seen: DataFrame) -> DataFrame:
    """State history: one row per poll that opened, changed or retracted an alert."""
    return alert_history(seen).filter("change IS NOT NULL").select("watch_id", "event_reference", "poll_time", "change")


def poll_windows(watches: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Window of the next poll: from the checkpoint less the overlap, never before the scope."""
    done = runs.filter("status = 'succeeded'").groupBy("watch_id").agg(F.max("window_end").alias("checkpoint"))
    j = watches.join(done, "watch_id", "left")
    back = F.timestamp_seconds(F.unix_seconds("checkpoint") - F.col("overlap_seconds"))
    return j.select("watch_id", F.greatest("baseline", back).alias("window_start"), now.alias("window_end"), "checkpoint")


def classify_polls(polls: DataFrame) -> DataFrame:
    """Poll status; a failed read is never zero events and never moves the checkpoint."""
    status = (
        F.when(F.col("error").isNotNull() & (F.col("pages") == 0), "provider_failure").when(F.col("error").isNotNull(), "partial")
        .when(F.col("truncated"), "truncated").otherwise("succeeded")
    )
    coverage = F.when(status == "succeeded", "complete_within_scope").when(status == "provider_failure", "failed").otherwise("partial")
    return polls.withColumn("status", status).withColumn("coverage_status", coverage).withColumn(
        "checkpoint_after", F.when(status == "succeeded", F.greatest("window_end", "checkpoint_before")).otherwise(F.col("checkpoint_before"))
    )


def watch_status(runs: DataFrame) -> DataFrame:
    """Latest poll and latest successful poll per watch."""
    ok = F.col("status") == "succeeded"
    return runs.groupBy("watch_id").agg(
        F.max_by(F.struct("status", "run_id"), F.struct("started_at", "run_id")).alias("l"), F.max(F.when(ok, F.col("completed_at"))).alias("last_success"),
        F.count(F.lit(1)).alias("polls"),
    ).select("watch_id", F.col("l.status").alias("last_status"), F.col("l.run_id").alias("last_run"), "last_success", "polls")


def alert_lag(alerts: DataFrame) -> DataFrame:
    """Seconds from block time to first observation, where that means something."""
    basis = (
        F.when(F.col("block_time").isNull(), "unavailable").when(F.col("data_mode") == "RECORDED_PUBLIC", "unavailable_recorded_replay")
        .when(F.col("data_mode") == "SYNTHETIC", F.when(F.col("simulated"), "simulated_clock").otherwise("synthetic_fixture_times")).otherwise("live_wall_clock")
    )
    lag = F.when(~basis.startswith("unavailable"), F.unix_seconds("first_observed_at") - F.unix_seconds("block_time"))
    return alerts.withColumn("basis", basis).withColumn("lag_seconds", lag)


def alert_outbox(alerts: DataFrame, context: DataFrame) -> DataFrame:
    """One notification per alert with its case and watch; an incomplete context is refused."""
    j = alerts.join(context, "watch_id", "left")
    need = ("case_id", "watch_network", "watch_address", "watch_contract")
    complete = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(False)) for c in need], F.lit(True))
    body = F.to_json(F.struct(
        F.struct(F.col("case_id").alias("id")).alias("case"), F.struct(F.col("watch_id").alias("id"), F.col("watch_address").alias("address")).alias("watch"),
        F.struct("event_reference", "state").alias("alert"),
    ))
    return j.select(
        "watch_id", "event_reference", F.when(complete, body).alias("body"),
        F.when(complete, F.sha2(body, 256)).alias("sha256"), F.when(~complete, "context_missing").alias("refusal"),
    )


def canonical_inclusion(history: DataFrame) -> DataFrame:
    """Current block per transaction; losing inclusions stay counted."""
    good = F.col("is_canonical")
    return history.groupBy("tx_hash").agg(
        F.max_by("block_hash", F.when(good, F.struct("observed_at", "block_hash"))).alias("canonical_block"),
        F.count(F.lit(1)).alias("inclusions"), F.sum((~good).cast("long")).alias("orphaned"),
    )


