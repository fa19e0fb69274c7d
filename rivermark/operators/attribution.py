"""What saved traces say about receiving services, and overlaps between cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.functions.predicates import _is, covers, first_reason, fund_flow, positive
from rivermark.operators.patterns import BOUNDARY_REASONS
from rivermark.operators.transfers import CONTENT, verified_events
from rivermark.scale import running_before, staged, with_cells

CELL_SECONDS = 3600
# Label types that receive deposits, pooled roles.
RECEIVING_TYPES = ("exchange", "custodial_service", "payment_processor")
POOLED_ROLES = ("hot_wallet", "cold_reserve", "settlement")
SHARED_REASONS = ("bridge", "privacy_mechanism", "opaque_contract")


def path_check(endings: DataFrame, observed: DataFrame, headers: DataFrame) -> DataFrame:
    """Add ``path_problem`` to each ending: NULL when the saved path proves the receipt.

    Paths are as long as the hop budget, so their steps are joined as rows and
    folded back per ending.
    """
    # The endings to check are few of those that are read for them, and are needed three times.
    ends = staged(endings.withColumn("path", F.array_join("branch_path", ">")))
    steps = ends.select(
        "trace_id", "endpoint_class", "address", "path", F.posexplode("branch_path").alias("pos", "event_reference")
    )
    # Only verified events prove a step; an unverified or conflicting one leaves a gap. Events of no
    # step are left behind first, and what a step does not ask of an event is not moved.
    told = [c for c in observed.columns if c in {"trace_id", "network_key", "event_reference", *CONTENT, "execution_status", "confirmation_state"}]
    met = observed.select(*told).join(steps.select("trace_id", "event_reference"), ["trace_id", "event_reference"], "left_semi")
    facts = verified_events(met, ["trace_id"]).select("trace_id", "event_reference", "from_address", "to_address", "token_contract")
    walked = steps.join(facts, ["trace_id", "event_reference"], "left")
    key = ["trace_id", "endpoint_class", "address", "path"]
    step = F.struct("pos", "event_reference", "from_address", "to_address", "token_contract")
    # A step row per hop: the array below holds at most the hop budget.
    folded = walked.groupBy(*key).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    known = F.forall("steps", lambda s: s["to_address"].isNotNull())
    joined = F.forall(
        F.arrays_zip(
            F.slice("steps", F.lit(1), F.size("steps") - 1).alias("a"),
            F.slice("steps", F.lit(2), F.size("steps")).alias("b"),
        ),
        lambda p: p["a"]["to_address"].eqNullSafe(p["b"]["from_address"]),
    )
    last = F.element_at("steps", -1)
    out = ends.join(folded, key, "left").join(headers.select("trace_id", "seed_address"), "trace_id", "left")
    problem = first_reason(
        (
            F.col("steps").isNull() | ~known
            | ~last["event_reference"].eqNullSafe(F.col("arrival_event_reference"))
            | ~last["to_address"].eqNullSafe(F.col("address")),
            "missing_or_unverified_deposit_path",
        ),
        (
            (F.col("seed_address").isNotNull() & ~F.col("steps")[0]["from_address"].eqNullSafe(F.col("seed_address")))
            | ~joined,
            "disconnected_path",
        ),
        (
            F.size(F.array_distinct(F.transform("steps", lambda s: s["token_contract"]))) != 1,
            "asset_change_without_link_evidence",
        ),
    )
    return out.withColumn("path_problem", problem).drop("steps")


def _reviewed(endings: DataFrame) -> DataFrame:
    return endings.filter(
        _is("endpoint_class", "known_service") & _is("attribution_status", "supported")
        & _is("review_state", "accepted")
    )


def service_boundaries(endings: DataFrame, observed: DataFrame, headers: DataFrame) -> DataFrame:
    """Reviewed services whose whole path consists of verified events."""
    checked = path_check(_reviewed(endings), observed, headers)
    return checked.filter("path_problem IS NULL OR path_problem <> 'missing_or_unverified_deposit_path'").select(
        "trace_id", "address", "entity_name", "hop_depth", "arrival_event_reference", "address_role",
        "source_reference", (F.col("address_role") == "deposit").alias("deposit_role_verified"),
    )


def protocol_boundary(endings: DataFrame) -> DataFrame:
    return endings.filter(_is("boundary_reason", *BOUNDARY_REASONS)).select(
        "trace_id", "address", "boundary_reason"
    )


def _receiving(endings: DataFrame, observed: DataFrame, headers: DataFrame) -> DataFrame:
    wanted = _reviewed(endings).filter(
        _is("assertion_type", "service_control") & _is("entity_type", *RECEIVING_TYPES)
        & F.col("source_reference").isNotNull()
    )
    return path_check(wanted, observed, headers)


def receiving_services(endings: DataFrame, observed: DataFrame, headers: DataFrame) -> DataFrame:
    """Receiving services with a proven path from the seed, once per address and path."""
    good = _receiving(endings, observed, headers).filter("path_problem IS NULL")
    # Of copies that differ the smallest stays, whatever the partitioning.
    held = F.struct("network_key", "entity_name", "entity_type", "address_role", "arrival_event_reference", F.size("branch_path").cast("long").alias("hops"))
    return good.groupBy("trace_id", "address", "path").agg(F.min(held).alias("s")).select(
        "trace_id", "s.network_key", "address", "s.entity_name", "s.entity_type", "s.address_role",
        "s.arrival_event_reference", "path", "s.hops", (F.col("s.hops") == 1).alias("direct"),
    )


def rejected_paths(endings: DataFrame, observed: DataFrame, headers: DataFrame) -> DataFrame:
    return _receiving(endings, observed, headers).filter("path_problem IS NOT NULL").select(
        "trace_id", "address", "path", F.col("path_problem").alias("reason")
    )


def nearest_services(services: DataFrame) -> DataFrame:
    """All services at the smallest number of hops of their trace."""
    least = services.groupBy("trace_id").agg(F.min("hops").alias("hops"))
    return services.join(least, ["trace_id", "hops"])


def service_groups(services: DataFrame) -> DataFrame:
    """Receiving addresses per reviewed entity, one row each."""
    return services.select("trace_id", "network_key", "entity_name", "address").distinct()


def request_identifiers(observed: DataFrame) -> DataFrame:
    """Distinct transactions of each trace, with their number."""
    tx = observed.select("trace_id", "tx_hash").filter("tx_hash IS NOT NULL").distinct()
    return tx.join(tx.groupBy("trace_id").agg(F.count(F.lit(1)).alias("observed_transactions")), "trace_id")


def request_eligibility(endings: DataFrame) -> DataFrame:
    """Whether a restriction request could name the address, and why not."""
    refused = first_reason(
        (_is("address_role", *POOLED_ROLES), "pooled_address"),
        (F.coalesce(F.col("address_role") == "unknown", F.lit(True)), "role_not_established"),
    )
    return (
        _reviewed(endings)
        .select("trace_id", "address", "address_role", refused.alias("refusal"))
        .distinct()
        .withColumn("eligible", F.col("refusal").isNull())
    )


def scope_limitations(endings: DataFrame) -> DataFrame:
    """Bounds that follow from what the endings rest on, once per address."""
    codes = F.array_compact(
        F.array(
            F.when(F.col("valid_from") == F.col("valid_to"), F.struct(F.lit("snapshot_only_label").alias("code"), F.col("address").alias("about"))),
            F.when(F.col("address_role") == "unknown", F.struct(F.lit("address_role_unknown").alias("code"), F.col("address").alias("about"))),
            F.when(F.col("observed_amount_base_units").isNotNull(), F.struct(F.lit("allocation_unknown").alias("code"), F.lit(None).cast("string").alias("about"))),
        )
    )
    return endings.select("trace_id", F.explode(codes).alias("x")).select("trace_id", "x.*").distinct()


def cross_case_overlap(events: DataFrame, shared: DataFrame) -> DataFrame:
    """Addresses seen in at least two cases of one network and mode.

    ``shared`` lists service and protocol addresses that connect unrelated cases.
    The evidence stays as one row per case, so no address carries a long list.
    """
    scope = ["network_key", "data_mode", "address"]
    both = F.explode(F.array_distinct(F.array("from_address", "to_address"))).alias("address")
    seen = events.select("network_key", "data_mode", "case_id", both)
    per_case = seen.groupBy(*scope, "case_id").agg(F.count(F.lit(1)).alias("events"))
    cases = per_case.groupBy(*scope).agg(F.count(F.lit(1)).alias("case_count")).filter("case_count >= 2")
    kept = cases.join(shared.select(*scope).distinct(), scope, "left_anti")
    return per_case.join(kept, scope)


def shared_endpoints(endings: DataFrame) -> DataFrame:
    return endings.filter(_is("endpoint_class", "known_service") | _is("boundary_reason", *SHARED_REASONS)).select(
        "network_key", "data_mode", "address"
    ).distinct()


def case_representatives(runs: DataFrame) -> DataFrame:
    """Newest run per case whose stored digest matches its content."""
    sound = runs.filter(F.sha2("payload", 256) == F.col("payload_sha256"))
    newest = F.max_by(F.struct("run_id", "created_at"), F.struct("created_at", "run_id"))
    return sound.groupBy("case_id").agg(newest.alias("r")).select("case_id", "r.*")


def index_events(events: DataFrame, indexed: DataFrame, content: list[str]) -> DataFrame:
    """Events of a run that the index lacks, with a digest of their content."""
    fresh = events.join(indexed.select("run_id", "event_reference"), ["run_id", "event_reference"], "left_anti")
    return fresh.withColumn("observed_sha256", F.sha2(F.concat_ws("|", *content), 256))


def ordered_observations(events: DataFrame) -> Column:
    """Why an observation cannot support a neighbourhood, first reason wins."""
    return first_reason(
        (~fund_flow(), "no_value_moved"),
        (F.col("ordering_ambiguous") | F.col("event_index").isNull(), "order_unknown"),
    )


def anchor_senders(events: DataFrame, anchors: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Senders to each anchor while its claim covers the transfer, and the rest with a reason.

    ``cap`` is the reporting limit of the collection: the first ``cap`` senders by
    their first covered transfer, with a flag when more exist.
    """
    from pyspark.sql import Window

    claim = anchors.select(
        "network_key", F.col("address").alias("to_address"), "entity_name", "valid_from", "valid_to"
    )
    joined = events.filter("from_address IS NOT NULL").join(claim, ["network_key", "to_address"])
    covered = F.col("block_time").isNotNull() & covers(F.col("block_time"), F.col("valid_from"), F.col("valid_to"))
    marked = joined.withColumn("covered", covered)
    outside = marked.filter("NOT covered").select(
        F.col("from_address").alias("candidate_address"), F.col("to_address").alias("anchor_address"),
        "event_reference",
        F.when(F.col("block_time").isNull(), "no_block_time").otherwise("claim_does_not_cover_transfer").alias("reason"),
    )
    first = F.min_by(F.struct("event_reference", "tx_hash", "amount_base_units", "block_time"),
                     F.struct("block_time", "event_reference"))
    senders = (
        marked.filter("covered")
        .groupBy(F.col("to_address").alias("anchor_address"), F.col("from_address").alias("candidate_address"))
        .agg(first.alias("f"))
        .select("anchor_address", "candidate_address", "f.*")
    )
    totals = senders.groupBy("anchor_address").agg((F.count(F.lit(1)) > cap).alias("truncated"))
    # row_number with a small bound is cut inside every task before the shuffle.
    order = Window.partitionBy("anchor_address").orderBy("block_time", "event_reference")
    top = senders.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= cap)
    return top.join(totals, "anchor_address"), outside


def excluded_observations(events: DataFrame, network: str, contract: str, start: Column, end: Column) -> DataFrame:
    """How many observations of a collection do not count, by their first reason."""
    reason = first_reason(
        ((F.col("network_key") != network) | (F.col("token_contract") != contract), "different_network_or_asset"),
        (~F.coalesce((F.col("block_time") >= start) & (F.col("block_time") <= end), F.lit(False)), "outside_window"),
        (~positive() | _is("confirmation_state", "removed"), "no_value_or_removed"),
        (_is("execution_status", "failed", "reverted"), "failed_execution"),
        (F.col("ordering_ambiguous") | F.col("event_index").isNull(), "order_unknown"),
    )
    rows = events.withColumn("reason", reason)
    # Copies of a counted event are excluded too; the first of them is not.
    copies = rows.filter("reason IS NULL").groupBy("network_key", "event_reference").agg((F.count(F.lit(1)) - 1).alias("n"))
    repeated = copies.filter("n > 0").select(F.lit("repeated_event").alias("reason"), "n")
    own = rows.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return own.unionByName(repeated).groupBy("reason").agg(F.sum("n").alias("excluded"))


def neighbourhood(
    events: DataFrame, anchors: DataFrame, start: Column, end: Column, complete: Column
) -> tuple[DataFrame, DataFrame]:
    """Wallets that send to an anchor, classified by what was observed around them.

    Only bounded, ordered, value-moving observations inside the window count, once
    each. Transfers outside the claim's interval come back as context rows.
    """
    usable = (
        events.filter(ordered_observations(events).isNull())
        .filter((F.col("block_time") >= start) & (F.col("block_time") <= end))
        .groupBy("network_key", "event_reference")
        .agg(F.min(F.struct("from_address", "to_address", "amount_base_units", "block_time")).alias("e"))
        .select("network_key", "event_reference", "e.*")
    )
    claim = anchors.select(
        "network_key", F.col("address").alias("to_address"), "entity_name", "valid_from", "valid_to"
    )
    to_anchor = usable.join(claim, ["network_key", "to_address"]).withColumn(
        "covered", covers(F.col("block_time"), F.col("valid_from"), F.col("valid_to"))
    )
    context = to_anchor.filter("NOT covered").select(
        F.col("from_address").alias("address"), F.col("to_address").alias("anchor_address"), "event_reference"
    )
    from rivermark.functions.amounts import sum_units

    key = ["network_key", "anchor_address", "address"]
    sent = (
        to_anchor.filter("covered")
        .withColumnRenamed("to_address", "anchor_address")
        .withColumnRenamed("from_address", "address")
        .groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("repeated"),
            F.max("block_time").alias("last_sent"),
            F.countDistinct(F.to_date("block_time")).alias("days"),
            sum_units(F.col("amount_base_units")).alias("units"),
        )
    )
    # First payments of a wallet and the moments its candidates sent last, in one order: the
    # payments before a moment are a running count, and payers are never joined to anchors.
    inflow = usable.groupBy("network_key", F.col("to_address").alias("address"), "from_address").agg(F.min("block_time").alias("at"))
    paid = inflow.select("network_key", "address", "at", F.lit(1).alias("kind"), F.lit(1).cast("long").alias("new"))
    asked = sent.select(*key, F.col("last_sent").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("new"))
    rows = with_cells(paid.unionByName(asked, allowMissingColumns=True), ["network_key", "address"], F.unix_seconds("at"), CELL_SECONDS)
    # A payment at the very moment sorts after it: only strictly earlier ones count.
    feeders = running_before(rows, ["network_key", "address"], ["at", "kind"], {"distinct_senders": (F.sum, F.col("new"))}).filter("kind = 0")
    feeders = feeders.select(*key, "distinct_senders")
    out = sent.join(feeders, key, "left").withColumn("distinct_senders", F.coalesce("distinct_senders", F.lit(0)))
    kind = (
        F.when(~complete, "unresolved_candidate_relationship")
        .when((F.col("repeated") >= 2) & (F.col("distinct_senders") >= 2), "collection_candidate")
        .when(F.col("repeated") >= 2, "service_neighbor_candidate")
        .otherwise("deposit_candidate")
    )
    return out.withColumn("relationship", kind), context
