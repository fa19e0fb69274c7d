"""Projections of the given tables onto the engine's inputs.

The given tables hold no transfers, so order lines play that role: each line
moves an amount from its customer's wallet to a wallet chosen by part and
supplier. The same rules are stated as SQL in ``plans/base.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NETWORK = "n0"
#: 2026-01-01T00:00:00Z; order dates are compressed onto the days after it.
EPOCH = 1767225600
#: 1995-01-01T00:00:00Z, the first order date.
FIRST_DATE = 788918400
CUTOFF = EPOCH + 500_000
#: Customers that one desk looks after.
DESK = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(column: str) -> str:
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))"


def ledger(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """One transfer event per order line; ``lines`` may be a stream of order lines."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"
    )
    lines = (table(spark, sf_dir, "lineitem") if lines is None else lines).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    wallets = table(spark, sf_dir, "customer").agg(F.count(F.lit(1))).scalar()
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.withColumn("_to", (F.col("l_partkey") * 31 + F.col("l_suppkey")) % wallets)
    return j.selectExpr(
        f"'{NETWORK}' AS network_key",
        "'a0' AS token_contract",
        "concat_ws(':','tx',l_orderkey,l_linenumber,l_partkey,l_suppkey,cast(l_quantity as bigint))"
        " AS event_reference",
        "concat('h',l_orderkey) AS tx_hash",
        "CASE WHEN l_linenumber = 7 THEN 'approval' ELSE 'transfer' END AS event_kind",
        "concat('w',o_custkey) AS from_address",
        "concat('w',_to) AS to_address",
        "cast(cast(l_quantity as bigint) * 1000000 as string) AS amount_base_units",
        "CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'success' END AS execution_status",
        "CASE WHEN l_returnflag = 'R' THEN 'removed' ELSE 'confirmed' END AS confirmation_state",
        f"timestamp_seconds({EPOCH} + ({epoch_seconds('o_orderdate')} - {FIRST_DATE}"
        " + l_orderkey % 86400) div 500) AS block_time",
        "CASE WHEN l_linenumber = 6 THEN NULL ELSE concat(lpad(cast(l_orderkey as string),12,'0'),"
        "':',lpad(cast(l_linenumber as string),6,'0')) END AS chain_sequence",
        "l_linenumber = 6 AS ordering_ambiguous",
        "cast(l_linenumber as bigint) AS line",
        "l_orderkey AS order_key",
        "o_custkey AS sender_key",
        "_to AS recipient_key",
        "l_partkey AS part_key",
        "l_suppkey AS supplier_key",
    )


def hub(df: DataFrame) -> DataFrame:
    """Few, busy wallets: both ends modulo 50."""
    return df.withColumn("from_address", F.expr("concat('w', sender_key % 50)")).withColumn(
        "to_address", F.expr("concat('w', recipient_key % 50)")
    )


def sparse(df: DataFrame) -> DataFrame:
    """Many thin books: twenty assets."""
    return df.withColumn("token_contract", F.expr("concat('a', part_key % 20)"))


def hourly(df: DataFrame) -> DataFrame:
    """Add ``trace_id``: one small graph per hour and asset."""
    hour = F.expr(f"(unix_seconds(block_time) - {EPOCH}) div 3600")
    return df.withColumn("trace_id", F.concat_ws(":", F.lit("t"), hour, "token_contract"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service label claims: kind by account balance band, interval by key arithmetic."""
    customers = table(spark, sf_dir, "customer").filter("c_acctbal >= 7500")
    claims = customers.withColumn(
        "copy",
        F.explode(F.expr("CASE WHEN c_acctbal >= 9000 AND c_acctbal < 9300 THEN array(1,2) ELSE array(1) END")),
    )
    return claims.selectExpr(
        f"'{NETWORK}' AS network_key",
        "concat('w', c_custkey) AS address",
        "concat(CASE WHEN copy = 2 THEN 'Rival ' ELSE 'Service ' END, c_nationkey) AS entity_name",
        "CASE c_custkey % 3 WHEN 0 THEN 'exchange' WHEN 1 THEN 'custodial_service' ELSE 'bridge' END"
        " AS entity_type",
        "CASE WHEN c_acctbal >= 8500 AND c_acctbal < 9000 THEN 'deposit_candidate'"
        " ELSE 'service_control' END AS assertion_type",
        "CASE c_custkey % 4 WHEN 0 THEN 'deposit' WHEN 1 THEN 'hot_wallet' WHEN 2 THEN 'settlement'"
        " ELSE 'unknown' END AS address_role",
        "CASE WHEN c_acctbal >= 9000 THEN 'accepted' WHEN c_acctbal >= 8500 THEN 'unreviewed'"
        " WHEN c_acctbal >= 8000 THEN 'unreviewed' WHEN c_acctbal >= 7750 THEN 'accepted'"
        " WHEN c_acctbal >= 7600 THEN 'rejected' ELSE 'quarantined' END AS review_state",
        "concat('src:', c_custkey, ':', copy) AS source_reference",
        f"CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE timestamp_seconds({EPOCH} + (c_custkey * 37) % 200000)"
        " END AS valid_from",
        f"CASE WHEN c_acctbal < 8000 THEN timestamp_seconds({EPOCH} + 1000)"
        f" WHEN c_custkey % 5 = 0 THEN NULL ELSE timestamp_seconds({EPOCH} + 150000 + (c_custkey * 91) % 260000)"
        " END AS valid_to",
        "c_custkey * 2 + copy AS row_no",
    )


def _carries(events: DataFrame) -> Column:
    """Whether an event is spendable, as the walk wrote it where it did."""
    from rivermark.functions.predicates import spendable

    return F.col("spendable") if "spendable" in events.columns else spendable()


def seeds(events: DataFrame) -> DataFrame:
    """One reported transfer per desk: the earliest spendable one.

    A desk has ``DESK`` customers, so seeds grow with the ledger; every event takes
    part in the choice.
    """
    first = F.min_by(
        F.struct("event_reference", "network_key", "token_contract", "from_address"),
        F.struct("block_time", "event_reference"),
    )
    return (
        events.filter(_carries(events))
        .groupBy(F.expr(f"sender_key div {DESK}").alias("desk"))
        .agg(first.alias("s"))
        .select(F.concat(F.lit("t"), "desk").alias("trace_id"), "s.*")
        .withColumnRenamed("event_reference", "seed_event_reference")
        .withColumnRenamed("from_address", "seed_address")
    )


def doubtful_seeds(events: DataFrame) -> DataFrame:
    """Two seeds per desk: its earliest transfer that is not verified, and a sender's address alone."""
    carries = _carries(events)
    at = F.struct("block_time", "event_reference")
    desk = F.expr(f"sender_key div {DESK}").alias("desk")
    reported = events.filter((F.col("event_kind") == "transfer") & ~carries).groupBy(desk).agg(
        F.min_by(F.struct("event_reference", "network_key", "token_contract", "from_address"), at).alias("s")
    ).select(F.concat(F.lit("r"), "desk").alias("trace_id"), "s.*")
    address = events.filter(carries).groupBy(desk).agg(
        F.min_by(F.struct("network_key", "token_contract", "from_address"), at).alias("s")
    ).select(F.concat(F.lit("d"), "desk").alias("trace_id"), F.lit(None).cast("string").alias("event_reference"), "s.*")
    return reported.unionByName(address).withColumnRenamed("event_reference", "seed_event_reference").withColumnRenamed(
        "from_address", "seed_address"
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as per-wallet evidence rows (incoming or outgoing)."""
    e = table(spark, sf_dir, "events")
    secs = epoch_seconds("ts")
    return e.selectExpr(
        f"'{NETWORK}' AS network",
        "concat('u', user_id) AS candidate_address",
        "CASE WHEN event_type IN ('click','view') THEN 'incoming' ELSE 'outgoing' END AS direction",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('p', event_id % 23) END AS counterparty_address",
        "concat('e', event_id) AS event_reference",
        "concat('h', event_id div 2) AS tx_hash",
        "cast(cast(floor(value * 100) as bigint) as string) AS amount_base_units",
        f"CASE WHEN event_id % 29 = 0 THEN NULL ELSE timestamp_seconds({secs}) END AS block_time",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 11 END AS event_index",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id div 10 END AS block_number",
        "CASE WHEN event_type = 'error' THEN 'unknown' ELSE 'success' END AS execution_status",
        "CASE WHEN event_id % 31 = 0 THEN 'removed' ELSE 'confirmed' END AS confirmation_state",
        "event_id % 5 = 0 AS ordering_ambiguous",
        "event_type",
        "event_id",
        "user_id",
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate wallet: anchor and whether each side is truncated."""
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr(
            f"'{NETWORK}' AS network",
            "concat('u', user_id) AS candidate_address",
            "CASE WHEN user_id % 6 = 0 THEN NULL ELSE concat('p', user_id % 23) END AS anchor_address",
            "user_id % 5 = 1 AS incoming_truncated",
            "user_id % 7 = 2 AS outgoing_truncated",
            "user_id",
        )
    )


def resource_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as resource evidence: payments, delegations and native funding."""
    return observations(spark, sf_dir).selectExpr(
        "network", "candidate_address", "coalesce(counterparty_address, 'unknown') AS counterparty_address",
        "CASE event_type WHEN 'purchase' THEN 'token_transfer' WHEN 'click' THEN 'trx_funding'"
        " ELSE 'resource_delegation' END AS relationship_type",
        "CASE event_type WHEN 'view' THEN 'current_state_only' ELSE 'historical' END AS temporal_status",
        "CASE event_type WHEN 'signup' THEN 'delegate' WHEN 'error' THEN 'undelegate'"
        " WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'current_index' ELSE 'current_detail' END END AS operation_type",
        "event_reference AS tx_or_operation_id", "amount_base_units", "block_time", "event_id", "user_id",
    )
