"""Resource delegation, native funding and sponsor leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivermark.functions import amounts
from rivermark.functions.predicates import first_reason

WALLET = "candidate_address"
# Evidence kinds independent of a delegation; rental-service size.
INDEPENDENT = ("sourced_disclosure", "signed_ownership", "authorized_observation")
SHARED_FANOUT = 20
DELEGATION_CONTRACTS = {"DelegateResourceContract": "delegate", "UnDelegateResourceContract": "undelegate"}


def resource_counts(rows: DataFrame) -> DataFrame:
    """Rows per relationship and temporal status, with the reconciling total."""
    return rows.rollup("relationship_type", "temporal_status").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.col("operation_type") == "delegate").cast("long")).alias("delegate"),
        F.sum((F.col("operation_type") == "undelegate").cast("long")).alias("undelegate"),
    )


def counterparty_types(rows: DataFrame) -> DataFrame:
    """Relationship types seen per counterparty (at most three)."""
    return rows.groupBy("counterparty_address").agg(
        F.array_join(F.sort_array(F.collect_set("relationship_type")), ",").alias("types"), F.count(F.lit(1)).alias("rows")
    )


def _is_kind(relationship: str, temporal: str | None = None) -> Column:
    c = F.col("relationship_type") == relationship
    return c if temporal is None else c & (F.col("temporal_status") == temporal)


def resource_token(rows: DataFrame) -> DataFrame:
    return rows.filter(_is_kind("token_transfer")).groupBy(WALLET).agg(
        F.count(F.lit(1)).alias("token_transfers"), amounts.sum_units(F.col("amount_base_units")).alias("token_units"),
        F.countDistinct("counterparty_address").alias("distinct_anchors"),
    )


def resource_history(rows: DataFrame) -> DataFrame:
    """Dated delegation operations; a lower bound when the scan was cut short."""
    op = lambda o: F.sum((F.col("operation_type") == o).cast("long"))
    return rows.filter(_is_kind("resource_delegation", "historical")).groupBy(WALLET).agg(
        F.count(F.lit(1)).alias("operations"), op("delegate").alias("delegate"), op("undelegate").alias("undelegate"),
        F.countDistinct("counterparty_address").alias("counterparties"),
        F.unix_seconds(F.min("block_time")).alias("first_at"), F.unix_seconds(F.max("block_time")).alias("last_at"),
    )


def resource_gap(rows: DataFrame) -> DataFrame:
    """Seconds from the last delegation operation to the last token transfer, or unknown."""
    last = lambda k: F.max(F.when(k, F.unix_seconds("block_time")))
    return rows.groupBy(WALLET).agg(
        (last(_is_kind("token_transfer")) - last(_is_kind("resource_delegation", "historical"))).alias("gap_seconds")
    ).withColumn("status", F.when(F.col("gap_seconds").isNull(), "unknown").otherwise("complete"))


def resource_current(rows: DataFrame) -> DataFrame:
    """State read at acquisition time only, kept apart from dated operations."""
    return rows.filter(_is_kind("resource_delegation", "current_state_only")).groupBy(WALLET).agg(
        F.countDistinct("counterparty_address").alias("current_counterparties"),
        F.unix_seconds(F.min("block_time")).alias("observed_from"), F.unix_seconds(F.max("block_time")).alias("observed_to"),
    )


def resource_funding(rows: DataFrame, truncated: DataFrame) -> DataFrame:
    """Native funding per wallet; a zero under truncation is not proof of absence."""
    f = rows.filter(_is_kind("trx_funding")).groupBy(WALLET).agg(
        F.count(F.lit(1)).alias("n"), amounts.sum_units(F.col("amount_base_units")).alias("u")
    )
    return truncated.join(f, WALLET, "left").select(
        WALLET, F.coalesce("n", F.lit(0)).alias("fundings"), F.coalesce("u", F.lit("0")).alias("funding_units"),
        F.when(F.col("truncated"), "truncated").otherwise("complete").alias("status"),
    )


def resource_evidence_rows(history: DataFrame, provider_cap: int, funder_cap: int) -> DataFrame:
    """Delegations to and native transfers to a candidate, capped per type with a flag.

    The caps are the collection's declared limits; ``truncated`` reports them.
    """
    to_me = F.col("receiver_address") == F.col(WALLET)
    paid_me = F.col("to_address") == F.col(WALLET)
    ctype = F.col("contract_type")
    kind = first_reason(
        (ctype.isin(*DELEGATION_CONTRACTS) & to_me, "resource_delegation"), ((ctype == "TransferContract") & paid_me, "trx_funding")
    )
    rows = history.withColumn("relationship_type", kind).filter("relationship_type IS NOT NULL")
    cap = F.when(F.col("relationship_type") == "resource_delegation", provider_cap).otherwise(funder_cap)
    totals = rows.groupBy(WALLET, "relationship_type").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(WALLET, "relationship_type").orderBy("block_time", "tx_id")
    # The fixed bound lets every task keep only its first rows before the shuffle.
    first = rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max(provider_cap, funder_cap))
    op = F.coalesce(*[F.when(ctype == k, F.lit(v)) for k, v in DELEGATION_CONTRACTS.items()])
    return (
        first.filter(F.col("_rn") <= cap).join(totals, [WALLET, "relationship_type"])
        .withColumn("truncated", F.col("_n") > cap).withColumn("operation_type", op).drop("_rn", "_n")
    )


def resource_current_rows(delegations: DataFrame, candidates: DataFrame, cap: int) -> DataFrame:
    """Current delegations towards candidates as undated evidence rows.

    The cap counts providers; all details of the providers that are kept stay, and
    ``truncated_by_provider_limit`` says that some were left out.
    """
    mine = delegations.withColumnRenamed("receiver", WALLET).join(candidates.select(WALLET), WALLET, "left_semi")
    # Providers are folded to one row each before they are ranked.
    providers = mine.select(WALLET, "sponsor").distinct()
    order = Window.partitionBy(WALLET).orderBy("sponsor")
    first = providers.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= cap).drop("_rn")
    totals = providers.groupBy(WALLET).agg((F.count(F.lit(1)) > cap).alias("truncated_by_provider_limit"))
    top = mine.join(first, [WALLET, "sponsor"], "left_semi").join(totals, WALLET)
    return top.withColumn(
        "operation_type", F.when(F.col("resource").isNull(), "current_index").otherwise("current_detail")
    ).withColumn("temporal_status", F.lit("current_state_only"))


def backfill_operation_type(rows: DataFrame) -> DataFrame:
    """Name the operation of rows stored before the column existed, from their own fields."""
    text = F.coalesce("interpretation_limitations", F.lit(""))
    named = F.coalesce(
        F.when(F.col("acquisition_mode") == "delegation_index_current_state", "current_index"),
        F.when(F.col("acquisition_mode") == "delegated_resource_detail_current_state", "current_detail"),
        F.when(
            F.col("acquisition_mode") == "historical_operation_scan",
            F.coalesce(*[F.when(text.startswith(k), F.lit(v)) for k, v in DELEGATION_CONTRACTS.items()]),
        ),
    )
    return rows.withColumn(
        "operation_type", F.coalesce("operation_type", F.when(F.col("relationship_type") == "resource_delegation", named))
    )


def sponsor_leads(delegations: DataFrame, shared_fanout: int = SHARED_FANOUT) -> DataFrame:
    """One lead per receiver and sponsor; sponsors of many receivers are marked as shared."""
    pair = delegations.groupBy("sponsor", "receiver").agg(
        F.count(F.lit(1)).alias("observations"), F.max((F.col("basis") == "current_state").cast("int")).alias("undated")
    )
    fan = pair.groupBy("sponsor").agg(F.count(F.lit(1)).alias("sponsor_fanout"))
    return pair.join(fan, "sponsor").withColumn("shared_service", F.col("sponsor_fanout") >= shared_fanout).withColumn(
        "undated", F.col("undated") == 1
    )


def lead_promotion(leads: DataFrame) -> DataFrame:
    """May a lead become an inference? Needs evidence independent of the delegation."""
    independent = F.array_sort(F.array_intersect("corroboration", F.array(*[F.lit(k) for k in INDEPENDENT])))
    reason = first_reason(
        (F.col("shared_service"), "shared_service"), (F.size(independent) == 0, "no_independent_evidence"), (F.lit(True), "independent_evidence")
    )
    return leads.select(
        "sponsor", "receiver", (reason == "independent_evidence").alias("allowed"), reason.alias("reason"),
        F.when(reason == "independent_evidence", "inferred").alias("resulting_status"),
    )


def active_at(delegations: DataFrame, moment: Column) -> DataFrame:
    """Whether a delegation stood at a moment: true, false, or unknown (NULL)."""
    state = F.col("basis") == "current_state"
    dated = F.when(state, F.when(moment >= F.col("observed_at"), F.lit(True))).otherwise(moment >= F.col("operation_time"))
    return delegations.withColumn("active", dated).withColumn(
        "established", F.when(state, "unknown").otherwise("dated")
    )


def delegation_coverage(delegations: DataFrame) -> DataFrame:
    """State alone never completes a scope and never proves absence."""
    past = F.max((F.col("basis") == "historical_operation").cast("int")) == 1
    return delegations.groupBy("receiver").agg(
        F.when(past, "complete_within_scope").otherwise("unknown").alias("coverage"), F.count(F.lit(1)).alias("observations")
    )


def scan_coverage(scans: DataFrame, address_limit: int, event_limit: int) -> DataFrame:
    """Which anchors' scans stayed within their limits, and which limits were hit."""
    per_address = scans.groupBy("anchor_address", "address", "direction").agg(F.count(F.lit(1)).alias("n"))
    sides = per_address.groupBy("anchor_address").agg(
        F.countDistinct("address").alias("addresses"), F.sum((F.col("n") > event_limit).cast("long")).alias("cut_histories")
    )
    limits = F.array_compact(F.array(
        F.when(F.col("addresses") > address_limit, "address_limit"), F.when(F.col("cut_histories") > 0, "event_limit")
    ))
    return sides.select(
        "anchor_address", F.least("addresses", F.lit(address_limit)).cast("long").alias("examined"), "cut_histories",
        F.array_join(limits, ",").alias("limits_hit"), (F.size(limits) == 0).alias("complete"),
    )
