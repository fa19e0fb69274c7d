"""Verified event sets, totals and graph counts over a transfer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.functions import amounts
from rivermark.functions.predicates import _is, first_reason, positive

#: The columns two copies of one event must agree on.
CONTENT = ("from_address", "to_address", "amount_base_units", "block_time", "token_contract", "tx_hash")


def _row_reason(network: str | None = None) -> Column:
    """Reasons that one row alone decides, in the order they are tested."""
    blank = lambda n: F.coalesce(F.col(n) == "", F.lit(True))
    verified = _is("execution_status", "success") & _is("confirmation_state", "confirmed")
    return first_reason(
        (blank("event_reference"), "missing_event_identity"),
        (~verified, "execution_or_finality_unverified"),
        (~positive(), "non_positive_or_inexact_amount"),
        (blank("from_address") | blank("to_address"), "missing_participant"),
        # A set of one network leaves rows of others out; without one each network is its own.
        *([(F.coalesce(F.col("network_key") != network, F.lit(False)), "different_network")] if network else []),
    )


def _grouped(events: DataFrame, scope: list[str], network: str | None = None) -> DataFrame:
    """Per event identity: copies and how many different contents they have."""
    usable = events.withColumn("_reason", _row_reason(network)).filter("_reason IS NULL").drop("_reason")
    content = F.struct(*CONTENT)
    return usable.groupBy(*scope, "event_reference").agg(
        F.count(F.lit(1)).alias("copies"),
        # Two different contents exist exactly when the extremes differ.
        (F.min(content).eqNullSafe(F.max(content))).alias("agrees"),
        F.min(F.struct(*[c for c in events.columns if c not in [*scope, "event_reference"]])).alias("row"),
    )


def verified_events(events: DataFrame, scope: list[str], network: str | None = None) -> DataFrame:
    """One row per event identity; identities with conflicting copies are dropped."""
    return _grouped(events, scope, network).filter("agrees").select(*scope, "event_reference", "row.*")


def excluded_event_counts(events: DataFrame, scope: list[str], network: str | None = None) -> DataFrame:
    """Number of rows left out, by reason. Conflicts count identities.

    Within a conflicting identity, copies equal to the smallest content count as
    duplicates of it, the rest as conflicts of one identity.
    """
    single = (
        events.select(*scope, _row_reason(network).alias("reason"))
        .filter("reason IS NOT NULL")
        .groupBy(*scope, "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    usable = events.withColumn("_reason", _row_reason(network)).filter("_reason IS NULL")
    same = usable.groupBy(*scope, "event_reference", F.struct(*CONTENT).alias("content")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    ids = same.groupBy(*scope, "event_reference").agg(
        F.count(F.lit(1)).alias("contents"), F.min_by("copies", "content").alias("first_copies")
    )
    repeated = ids.groupBy(*scope).agg(
        F.sum(F.col("first_copies") - 1).alias("duplicate_event"),
        F.sum((F.col("contents") > 1).cast("long")).alias("conflicting_event_identity"),
    )
    shared = repeated.unpivot(
        scope, ["duplicate_event", "conflicting_event_identity"], "reason", "n"
    ).filter("n > 0")
    return single.unionByName(shared)


def repeat_report(events: DataFrame, keys: list[str]) -> DataFrame:
    """Identical repeats are one event; one reference with two contents is a conflict."""
    same = events.groupBy(*keys, F.struct(*CONTENT).alias("content")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    return same.groupBy(*keys).agg(
        F.sum("copies").alias("copies"),
        F.count(F.lit(1)).alias("contents"),
        (F.count(F.lit(1)) > 1).alias("conflict"),
    )


def observed_volume(events: DataFrame, scope: list[str]) -> DataFrame:
    """Count and exact gross sum per asset. Gross: the same funds count once per hop."""
    return events.groupBy(*scope, "token_contract").agg(
        F.count(F.lit(1)).alias("observed_transfer_count"),
        amounts.sum_units(F.col("amount_base_units")).alias("gross_base_units"),
    )


def pairs(events: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct directed wallet pairs with their transfer count."""
    return events.groupBy(*scope, "from_address", "to_address").agg(F.count(F.lit(1)).alias("n"))


def degrees(pair_counts: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct in and out neighbours per wallet."""
    out = pair_counts.select(*scope, F.col("from_address").alias("address"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = pair_counts.select(*scope, F.col("to_address").alias("address"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return (
        out.unionByName(into)
        .groupBy(*scope, "address")
        .agg(F.sum("o").cast("long").alias("out_degree"), F.sum("i").cast("long").alias("in_degree"))
    )


def graph_metrics(events: DataFrame, scope: list[str]) -> DataFrame:
    """Wallets, transfers, distinct pairs and junctions (degree three or more) per graph."""
    p = pairs(events, scope)
    d = degrees(p, scope).groupBy(*scope).agg(
        F.count(F.lit(1)).alias("wallet_count"),
        F.sum(((F.col("in_degree") >= 3) | (F.col("out_degree") >= 3)).cast("long")).alias("junctions"),
    )
    t = p.groupBy(*scope).agg(
        F.sum("n").alias("transfer_count"), F.count(F.lit(1)).alias("unique_directed_pairs")
    )
    return d.join(t, scope)


def graph_features(events: DataFrame, scope: list[str]) -> DataFrame:
    """Six numbers per graph: log counts, largest degrees, repeat and self shares."""
    p = pairs(events, scope)
    d = degrees(p, scope).groupBy(*scope).agg(
        F.log1p(F.count(F.lit(1))).alias("log_distinct_addresses"),
        F.log1p(F.max("in_degree")).alias("log_max_in_degree"),
        F.log1p(F.max("out_degree")).alias("log_max_out_degree"),
    )
    n = F.sum("n")
    own = F.sum(F.when(F.col("from_address") == F.col("to_address"), F.col("n")).otherwise(0))
    t = p.groupBy(*scope).agg(
        F.log1p(n).alias("log_verified_transfers"),
        ((n - F.count(F.lit(1))) / n).alias("repeated_pair_fraction"),
        (own / n).alias("self_transfer_fraction"),
    )
    return d.join(t, scope)
