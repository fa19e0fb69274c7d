"""Per-claim outcome, strong-inference gate and the four evidence levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermark.functions.predicates import covers, first_reason


def claims(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """One claim per candidate and the anchor it points to, if that anchor is on record."""
    dim = anchors.select(
        F.col("network_key").alias("anchor_network"), F.col("address").alias("anchor_address"), "entity_name", "review_state", "valid_from", "valid_to"
    )
    j = candidates.join(dim, "anchor_address", "left")
    return j.select(
        F.concat_ws("->", "candidate_address", "anchor_address").alias("claim_id"), "candidate_address", "anchor_address",
        F.col("entity_name").alias("service_name"), F.col("review_state").alias("label_review_state"),
        F.when(F.col("entity_name").isNotNull(), covers(F.col("at"), F.col("valid_from"), F.col("valid_to"))).alias("label_in_date"),
        (F.col("network_key") == F.col("anchor_network")).alias("label_network_matches"),
        "verification_quality", "ordering_ambiguous", "has_evidence", "conflict",
    )


def service_outcomes(rows: DataFrame) -> DataFrame:
    """Category and reason of each claim; the first rule that holds decides."""
    c = F.col
    named = F.coalesce(c("service_name") != "", F.lit(False))
    accepted = F.coalesce(c("label_review_state") == "accepted", F.lit(False))
    proven = (c("verification_quality") == "receipt_verified") & ~c("ordering_ambiguous")
    wrong = lambda f: F.coalesce(~c(f), F.lit(False))
    reason = first_reason(
        (c("conflict"), "unresolved_conflict"), (~named, "no_accepted_label"), (~accepted, "unreviewed_label"),
        (wrong("label_in_date"), "expired_label"), (wrong("label_network_matches"), "wrong_network"), (~proven, "insufficient_verification"),
    )
    category = (
        F.when(reason.isNull(), "supported_destination")
        .when(reason.isin("unreviewed_label", "insufficient_verification") & c("has_evidence"), "candidate_lead")
        .otherwise("unknown_or_blocked")
    )
    return rows.withColumn("reason", reason).withColumn("category", category).withColumn(
        "shown_service", F.when(category != "unknown_or_blocked", c("service_name"))
    )


def independent_evidence(items: DataFrame) -> DataFrame:
    """Reviewed, address-specific linkage from at least two upstream sources."""
    counts = (F.col("family") == "reviewed_linkage") & F.col("reviewed") & F.col("address_specific")
    n = F.sum(counts.cast("long"))
    sources = F.countDistinct(F.when(counts, F.col("upstream_source_id")))
    return items.groupBy("claim_id").agg(n.alias("qualifying"), sources.alias("sources"), ((n >= 1) & (sources >= 2)).alias("promoted"))


def strong_inference(outcomes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Raise candidate leads that have independent evidence inside the label's scope."""
    j = outcomes.join(evidence.select("claim_id", "promoted"), "claim_id", "left")
    lead = F.col("category") == "candidate_lead"
    backdated = F.col("current_state_only") & F.col("claimed_as_historical")
    scope = F.coalesce(F.col("label_in_date") & F.col("label_network_matches"), F.lit(False))
    block = first_reason(
        (backdated, "backdated_state"), (~scope, "label_scope"), (~F.coalesce("promoted", F.lit(False)), "missing_evidence")
    )
    return j.select(
        "claim_id", F.when(lead & block.isNull(), "strong_inference").otherwise(F.col("category")).alias("category"),
        F.when(lead, block).alias("blocked_by"),
    )


def evidence_levels(candidates: DataFrame, anchors: DataFrame, payments: DataFrame, behaviour: DataFrame, resources: DataFrame) -> DataFrame:
    """Four rows per candidate, each with its own status; no level fills in for another.

    ``payments``, ``behaviour`` and ``resources`` are per candidate with ``n`` rows,
    their first and last time, and ``truncated`` for the last two.
    """
    known = anchors.select(F.col("address").alias("anchor_address"), F.col("valid_from").alias("a_from"), F.col("valid_to").alias("a_to")).withColumn("has_anchor", F.lit(True))
    part = lambda d, p: d.select("candidate_address", *[F.col(c).alias(f"{p}_{c}") for c in d.columns if c != "candidate_address"])
    j = (
        candidates.select("candidate_address", "anchor_address").join(known, "anchor_address", "left")
        .join(part(payments, "p"), "candidate_address", "left").join(part(behaviour, "b"), "candidate_address", "left")
        .join(part(resources, "r"), "candidate_address", "left")
    )
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    cut = lambda p: F.when(F.col(f"{p}_truncated"), "truncated").otherwise("complete")
    level = lambda name, status, start, end, n: F.struct(
        F.lit(name).alias("level"), status.alias("status"), start.alias("scope_start"), end.alias("scope_end"),
        F.coalesce(n, F.lit(0)).cast("long").alias("evidence_rows"),
    )
    na = F.lit("not_applicable")
    rows = F.array(
        level("anchor_only", F.when(F.col("has_anchor"), "complete").otherwise(na), F.col("a_from"), F.col("a_to"), F.col("has_anchor").cast("long")),
        level("chronological_tracing", F.when(some("p_n"), "complete").otherwise(na), F.col("p_first_at"), F.col("p_last_at"), F.col("p_n")),
        level("tracing_plus_behavioral_rules", F.when(some("b_n"), cut("b")).otherwise(na), F.col("b_first_at"), F.col("b_last_at"), F.col("b_n")),
        level("tracing_plus_behavioral_rules_plus_resource_evidence", F.when(some("r_n"), cut("r")).otherwise(na), F.col("r_first_at"), F.col("r_last_at"), F.col("r_n")),
    )
    return j.select("candidate_address", F.explode(rows).alias("l")).select("candidate_address", "l.*")


def trace_unverified(observed: DataFrame, receipts: DataFrame) -> DataFrame:
    """Trace steps whose receipt is missing or does not state success."""
    from rivermark.sources.events import verify_execution

    checked = verify_execution(observed, receipts)
    return checked.filter("unverified IS NOT NULL").select("trace_id", "event_reference", "tx_hash", F.col("unverified").alias("reason"))

