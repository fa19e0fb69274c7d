"""Per-wallet behaviour from evidence rows.

Missing evidence stays NULL with a status. ``rows`` holds one row per observed
transfer of a candidate with its direction; ``accounts`` holds one row per
candidate with its anchor and whether either side is truncated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.functions import amounts
from rivermark.scale import nearest_before, running_total, with_cells

WALLET = "candidate_address"
DAY = 86_400_000_000


def _when_side(side: str, value: Column) -> Column:
    return F.when(F.col("direction") == side, value)


def behaviour_counts(rows: DataFrame) -> DataFrame:
    """Transfers, distinct counterparties and exact amounts per side."""
    # One pass to counterparty level, one to wallet level.
    linked = rows.groupBy(WALLET, "direction", "counterparty_address").agg(
        F.count(F.lit(1)).alias("n"), amounts.sum_units(F.col("amount_base_units")).alias("units")
    )
    return linked.groupBy(WALLET).agg(
        *(
            f
            for side in ("incoming", "outgoing")
            for f in (
                F.coalesce(F.sum(_when_side(side, F.col("n"))), F.lit(0)).alias(f"{side}_count"),
                F.count(_when_side(side, F.col("counterparty_address"))).alias(f"{side}_counterparties"),
                F.coalesce(amounts.sum_units(_when_side(side, F.col("units"))), F.lit("0")).alias(f"{side}_units"),
            )
        )
    )


def _outgoing(rows: DataFrame) -> DataFrame:
    """Spending per wallet and counterparty; blank counterparties stay as one row."""
    return (
        rows.filter("direction = 'outgoing'")
        .groupBy(WALLET, "counterparty_address")
        .agg(
            F.count(F.lit(1)).alias("n"),
            amounts.sum_limbs(F.col("amount_base_units")).alias("units"),
        )
    )


def _sum_limbs(v: Column) -> Column:
    return amounts._carry(F.sum(v["hi"]), F.sum(v["mid"]), F.sum(v["lo"]))


def _ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(amounts.approx(part), F.nullif(amounts.approx(whole), F.lit(0.0)))


def anchor_concentration(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Share of spending that goes to the accepted anchor, or why it is not known."""
    spent = _outgoing(rows).join(accounts.select(WALLET, "anchor_address"), WALLET)
    mine = F.when(F.col("counterparty_address") == F.col("anchor_address"), F.col("units"))
    agg = spent.groupBy(WALLET).agg(
        _sum_limbs(F.col("units")).alias("total"),
        F.coalesce(amounts.render(_sum_limbs(mine)), F.lit("0")).alias("to_anchor"),
    )
    out = accounts.join(agg, WALLET, "left")
    known = F.col("anchor_address").isNotNull() & F.col("total").isNotNull()
    ratio = _ratio(amounts.limbs(F.col("to_anchor")), F.col("total"))
    status = (
        F.when(F.col("anchor_address").isNull(), "unknown")
        .when(F.col("total").isNull(), F.when(F.col("outgoing_truncated"), "truncated").otherwise("unknown"))
        .otherwise(F.when(F.col("outgoing_truncated"), "truncated").otherwise("complete"))
    )
    return out.select(WALLET, F.when(known, ratio).alias("concentration"), status.alias("status"))


def max_concentration(rows: DataFrame) -> DataFrame:
    """Largest single counterparty by count and by amount; ties go to the smaller address."""
    spent = _outgoing(rows)
    # The largest value, then the smallest address holding it: both are plain aggregates.
    tops = spent.groupBy(WALLET).agg(
        F.sum("n").alias("all_n"),
        _sum_limbs(F.col("units")).alias("all_units"),
        F.max(F.when(F.col("counterparty_address").isNotNull(), F.col("n"))).alias("top_n"),
        F.max(F.when(F.col("counterparty_address").isNotNull(), F.col("units"))).alias("top_units"),
    )
    held = spent.filter("counterparty_address IS NOT NULL").join(tops, WALLET)
    names = held.groupBy(WALLET).agg(
        F.min(F.when(F.col("n") == F.col("top_n"), F.col("counterparty_address"))).alias("by_count"),
        F.min(F.when(F.col("units") == F.col("top_units"), F.col("counterparty_address"))).alias("by_amount"),
    )
    return tops.join(names, WALLET, "left").select(
        WALLET, "by_count", "by_amount",
        (F.col("top_n") / F.col("all_n")).alias("max_by_count"),
        _ratio(F.col("top_units"), F.col("all_units")).alias("max_by_amount"),
    )


def repeat_counterparties(rows: DataFrame) -> DataFrame:
    """Busiest counterparty's count and how many received more than once."""
    named = _outgoing(rows).filter("counterparty_address IS NOT NULL")
    return named.groupBy(WALLET).agg(
        F.max("n").alias("repeated_forwarding_count"),
        F.sum((F.col("n") > 1).cast("long")).alias("with_repeat"),
    )


def receipt_to_outflow(
    rows: DataFrame, accounts: DataFrame, cell_us: int = DAY, hot_rows: int | None = None
) -> DataFrame:
    """Each timed outflow with its nearest strictly earlier receipt, or a status."""
    timed = rows.filter("block_time IS NOT NULL").withColumn("at", F.unix_micros("block_time"))
    timed = with_cells(timed, [WALLET], F.col("at"), cell_us, hot_rows)
    near = nearest_before(
        timed, [WALLET], "at", F.col("direction") == "incoming",
        F.struct("at", F.col("event_reference").alias("ref")),
    ).filter("direction = 'outgoing'")
    sides = rows.groupBy(WALLET).agg(
        F.max((F.col("direction") == "incoming").cast("int")).alias("has_in")
    )
    out = near.join(sides, WALLET).join(accounts, WALLET)
    cutoff = F.col("incoming_truncated") | F.col("outgoing_truncated")
    status = (
        F.when(F.col("before").isNotNull(), F.when(cutoff, "truncated").otherwise("complete"))
        .when(F.col("has_in") == 0, "unknown")
        .when(F.col("incoming_truncated"), "truncated")
        .otherwise("unknown")
    )
    return out.select(
        WALLET, F.col("event_reference").alias("out_reference"),
        F.col("before.ref").alias("in_reference"),
        (F.col("at") - F.col("before.at")).alias("gap_us"),
        status.alias("status"),
    )


def gap_summary(matches: DataFrame, hot_cell_us: int = DAY, hot_rows: int | None = None) -> DataFrame:
    """Pair and ambiguous counts, smallest gap, and the middle gap when it is one pair's own."""
    counts = matches.groupBy(WALLET).agg(
        F.count("gap_us").alias("pairs"),
        F.sum(F.col("gap_us").isNull().cast("long")).alias("ambiguous"),
        F.min("gap_us").alias("min_gap_us"),
        F.min_by("out_reference", F.when(F.col("gap_us").isNotNull(), F.struct("gap_us", "out_reference"))).alias(
            "min_gap_reference"
        ),
    )
    # Equal gaps are folded before anything is ordered.
    folded = (
        matches.filter("gap_us IS NOT NULL").groupBy(WALLET, "gap_us").agg(F.count(F.lit(1)).alias("n"))
    )
    cells = with_cells(folded, [WALLET], F.col("gap_us"), hot_cell_us, hot_rows)
    upto = running_total(cells, [WALLET], "gap_us", "n")
    half = counts.filter("pairs % 2 = 1").select(WALLET, ((F.col("pairs") + 1) / 2).cast("long").alias("middle"))
    median = (
        upto.join(half, WALLET)
        .filter("upto >= middle AND upto - n < middle")
        .select(WALLET, F.col("gap_us").alias("median_gap_us"))
    )
    return counts.join(median, WALLET, "left").withColumn(
        "median_status",
        F.when(F.col("pairs") == 0, "unknown").when(F.col("pairs") % 2 == 0, "not_applicable").otherwise("reported"),
    )


def residue(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Income minus spending; NULL unless both sides are present and complete."""
    side = lambda s: amounts.sum_limbs(_when_side(s, F.col("amount_base_units")))
    agg = rows.groupBy(WALLET).agg(side("incoming").alias("got"), side("outgoing").alias("spent"),
                                   F.count(_when_side("incoming", F.lit(1))).alias("n_in"),
                                   F.count(_when_side("outgoing", F.lit(1))).alias("n_out"))
    out = accounts.join(agg, WALLET, "left")
    known = (
        (F.coalesce("n_in", F.lit(0)) > 0) & (F.coalesce("n_out", F.lit(0)) > 0)
        & ~F.col("incoming_truncated") & ~F.col("outgoing_truncated")
    )
    return out.select(
        WALLET,
        F.when(known, amounts.subtract(F.col("got"), F.col("spent"))).alias("residue_base_units"),
        F.when(known, "complete").otherwise("unknown").alias("status"),
    )


def quality_axes(rows: DataFrame) -> DataFrame:
    """Three independent axes: verification, identity and ordering of a wallet's rows."""
    every = lambda c: F.min(c.cast("int")) == 1
    some = lambda c: F.max(c.cast("int")) == 1
    status = F.coalesce("execution_status", F.lit(""))
    index = F.col("event_index").isNotNull()
    vague = F.col("ordering_ambiguous")
    return rows.groupBy(WALLET).agg(
        F.when(every(status == "success"), "receipt_verified")
        .when(every(status == "unknown"), "history_only").otherwise("mixed").alias("verification_quality"),
        F.when(every(index), "receipt_event_index")
        .when(~some(index), "observation_reference_only").otherwise("mixed").alias("event_identity_quality"),
        F.when(~some(vague), "precise").when(every(vague), "ambiguous")
        .otherwise("timestamp_only").alias("ordering_quality"),
    )


def uncertainty_counts(rows: DataFrame) -> DataFrame:
    unverified = (F.coalesce("execution_status", F.lit("")) != "success").cast("long")
    return rows.groupBy(WALLET).agg(
        F.sum(unverified).alias("unverified"),
        F.sum(F.col("ordering_ambiguous").cast("long")).alias("ambiguous_order"),
        F.sum(F.col("event_index").isNull().cast("long")).alias("missing_index"),
        F.sum(F.col("block_number").isNull().cast("long")).alias("missing_block"),
        F.when(F.sum(unverified) > 0, "not_verified").otherwise("verified_by_collection").alias("execution_status"),
    )


def receipt_crossref(rows: DataFrame, receipts: DataFrame) -> DataFrame:
    """How many of a wallet's rows have a separately verified receipt."""
    proven = receipts.filter("execution_status = 'success'").select("tx_hash").distinct()
    marked = rows.join(proven.withColumn("_proven", F.lit(1)), "tx_hash", "left")
    return marked.groupBy(WALLET).agg(F.count("_proven").alias("receipt_verified_rows"))


def run_completeness(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Provenance of a wallet's collection: window and completeness per direction."""
    bounds = rows.groupBy(WALLET).agg(
        F.unix_seconds(F.min("block_time")).alias("window_start"),
        F.unix_seconds(F.max("block_time")).alias("window_end"),
        F.count(F.lit(1)).alias("rows"),
    )
    complete = ~F.col("incoming_truncated") & ~F.col("outgoing_truncated")
    return accounts.join(bounds, WALLET, "left").select(
        WALLET, "window_start", "window_end", "rows",
        (~F.col("incoming_truncated")).alias("incoming_complete"),
        (~F.col("outgoing_truncated")).alias("outgoing_complete"),
        F.when(complete, "complete").otherwise("truncated").alias("acquisition_completeness"),
    )

