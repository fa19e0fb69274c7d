"""Service labels: loading, interval join and conflict-aware choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.functions.predicates import _is, covers, reasons
from rivermark.scale import dim_join

KEYS = ["network_key", "address"]
REQUIRED = ("network_key", "address", "entity_name", "entity_type", "assertion_type",
            "address_role", "review_state", "source_reference")
# The label vocabularies.
ASSERTION_TYPES = ("service_control", "deposit_candidate", "complaint_allegation",
                   "public_abuse_report", "sanctions_tag")
ADDRESS_ROLES = ("deposit", "hot_wallet", "cold_reserve", "withdrawal", "settlement", "unknown")
REVIEW_STATES = ("unreviewed", "accepted", "rejected", "quarantined", "conflicted")
WITHDRAWN = ("rejected", "quarantined")


def conclusion() -> Column:
    """What a claim says about an address, independent of who says it."""
    return F.struct(F.lower(F.trim("entity_name")).alias("entity"), "entity_type", "address_role")


def is_control() -> Column:
    return _is("assertion_type", "service_control") & _is("review_state", "accepted")


def label_problems(claims: DataFrame) -> DataFrame:
    """Add ``problems``: blank required fields and unknown assertion types."""
    blanks = [
        (F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)), f"missing_{c}") for c in REQUIRED
    ]
    unknown = [
        (~_is("assertion_type", *ASSERTION_TYPES), "unknown_assertion_type"),
        (~_is("address_role", *ADDRESS_ROLES), "unknown_address_role"),
        (~_is("review_state", *REVIEW_STATES), "unknown_review_state"),
    ]
    return claims.withColumn("problems", reasons(*blanks, *unknown))


def load_labels(claims: DataFrame) -> DataFrame:
    """Usable claims: well formed and not withdrawn."""
    return (
        label_problems(claims)
        .filter((F.size("problems") == 0) & ~_is("review_state", *WITHDRAWN))
        .drop("problems")
    )


def label_snapshot(claims: DataFrame) -> DataFrame:
    """Counts per state plus how many claims were withdrawn."""
    return claims.groupBy("assertion_type", "review_state").agg(
        F.count(F.lit(1)).alias("claims"),
        F.countDistinct("network_key", "address").alias("addresses"),
        F.sum(_is("review_state", *WITHDRAWN).cast("long")).alias("withdrawn"),
    )


def claims_by_address(claims: DataFrame) -> DataFrame:
    """All live claims of an address in one row, so a lookup adds no rows.

    Claims per address are reviewed by hand and few; the array holds claims, not
    events.
    """
    usable = load_labels(claims)
    item = F.struct(
        "row_no", "entity_name", "entity_type", "assertion_type", "address_role", "review_state",
        "source_reference", "valid_from", "valid_to", conclusion().alias("conclusion"),
        is_control().alias("control"),
    )
    return usable.groupBy(*KEYS).agg(F.sort_array(F.collect_list(item)).alias("claims"))


def resolve(
    rows: DataFrame, folded: DataFrame, address: str, at: Column, spread: list[str], small: bool | None = None
) -> DataFrame:
    """Add ``service`` (agreed control claim), ``conflict`` and ``candidate`` at ``at``.

    ``folded`` comes from ``claims_by_address``; ``small`` says whether it was found to fit
    a broadcast. Where active accepted claims
    disagree on entity, type or role none is chosen.
    """
    dim = folded.withColumnRenamed("address", address)
    joined = dim_join(rows, dim, ["network_key", address], "left", spread, small)
    live = F.filter(
        F.coalesce("claims", F.array()), lambda c: covers(at, c["valid_from"], c["valid_to"])
    )
    control = F.filter("_live", lambda c: c["control"])
    kinds = F.array_distinct(F.transform("_control", lambda c: c["conclusion"]))
    hint = F.filter("_live", lambda c: c["assertion_type"] == "deposit_candidate")
    return (
        joined.withColumn("_live", live)
        .withColumn("_control", control)
        .withColumn("service", F.when(F.size(kinds) == 1, F.col("_control")[0]))
        .withColumn("conflict", F.size(kinds) > 1)
        .withColumn("candidate", F.get(hint, F.lit(0)))
        .drop("claims", "_live", "_control")
    )


def label_interval_join(rows: DataFrame, claims: DataFrame, address: str, at: str, spread: list[str]) -> DataFrame:
    """One row per event and claim that covers the event's time."""
    dim = claims_by_address(claims).withColumnRenamed("address", address)
    joined = dim_join(rows, dim, ["network_key", address], "inner", spread)
    return (
        joined.withColumn("claim", F.explode("claims"))
        .drop("claims")
        .filter(covers(F.col(at), F.col("claim.valid_from"), F.col("claim.valid_to")))
    )


def label_conflicts(claims: DataFrame, at: Column) -> DataFrame:
    """Addresses with their picked claim at ``at``, or the fact that claims disagree."""
    active = load_labels(claims).filter(
        is_control() & covers(at, F.col("valid_from"), F.col("valid_to"))
    )
    kinds = F.countDistinct(conclusion())
    return active.groupBy(*KEYS).agg(
        kinds.alias("conclusions"),
        (kinds > 1).alias("conflict"),
        F.when(kinds == 1, F.min_by("source_reference", "row_no")).alias("picked_source"),
    )
