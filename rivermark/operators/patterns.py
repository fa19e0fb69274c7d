"""Behavioural rules over verified events, for every wallet and asset at once.

``events`` must be verified (see ``transfers.verified_events``). ``services`` is a
table of addresses whose routine aggregation is not reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.functions import amounts
from rivermark.functions.predicates import reasons
from rivermark.operators.chains import peel
from rivermark.scale import previous_row, with_cells

HOUR = 3600
# Points per rule and the bands of the triage score.
RULE_WEIGHTS = {
    "rapid_forwarding": 20,
    "fan_in": 15,
    "fan_out": 15,
    "repeated_forwarding": 15,
    "peeling_like_split": 10,
    "cyclic_topology": 5,
    "protocol_boundary": 10,
}
# Why a branch leaves what can be followed.
BOUNDARY_REASONS = ("bridge", "privacy_mechanism", "opaque_contract", "unsupported_asset_change")


def _without(df: DataFrame, services: DataFrame | None, address: str) -> DataFrame:
    if services is None:
        return df
    return df.join(services.select(F.col("address").alias(address)).distinct(), address, "left_anti")


def fan(events: DataFrame, scope: list[str], side: str, services: DataFrame | None = None) -> DataFrame:
    """Wallets with at least three distinct senders (``in``) or recipients (``out``)."""
    own, other = ("to_address", "from_address") if side == "in" else ("from_address", "to_address")
    # Distinct pairs first: the second step sees one row per counterparty.
    linked = events.groupBy(*scope, own, "token_contract", other).agg(F.count(F.lit(1)).alias("n"))
    found = linked.groupBy(*scope, own, "token_contract").agg(
        F.count(F.lit(1)).alias("counterparties"), F.sum("n").alias("transfers")
    )
    return _without(found.filter("counterparties >= 3"), services, own).withColumnRenamed(own, "address")


def movements(events: DataFrame, scope: list[str]) -> DataFrame:
    """Every event twice: as income of its recipient and as spending of its sender."""
    keep = [*scope, "token_contract", "event_reference", "amount_base_units", "block_time",
            "chain_sequence", "ordering_ambiguous"]
    own_first = F.array(
        F.struct(F.col("to_address").alias("address"), F.lit("in").alias("side")),
        F.struct(F.col("from_address").alias("address"), F.lit("out").alias("side")),
    )
    return events.select(*keep, F.explode(own_first).alias("m")).select(*keep, "m.*")


def rapid_pairs(
    events: DataFrame, scope: list[str], services: DataFrame | None = None,
    cell_seconds: int = HOUR, hot_rows: int | None = None,
) -> DataFrame:
    """Adjacent receive and send of similar size within an hour, per wallet and asset."""
    keys = [*scope, "address", "token_contract"]
    m = _without(movements(events, scope), services, "address")
    m = with_cells(m, keys, F.unix_seconds("block_time"), cell_seconds, hot_rows)
    m = m.withColumn("_seq", F.coalesce("chain_sequence", F.lit("")))
    p = previous_row(
        m, keys, ["block_time", "_seq", "event_reference", "side"],
        ["side", "event_reference", "amount_base_units", "block_time", "ordering_ambiguous"],
    )
    p = p.withColumn("elapsed", F.unix_seconds("block_time") - F.unix_seconds("prev.block_time"))
    both = F.struct(
        amounts.limbs(F.col("prev.amount_base_units")).alias("got"), amounts.limbs(F.col("amount_base_units")).alias("sent")
    )
    similar = amounts.let(
        both,
        lambda v: (amounts.scaled(v["got"], 85) <= amounts.scaled(v["sent"], 100))
        & (amounts.scaled(v["sent"], 100) <= amounts.scaled(v["got"], 105)),
    )
    candidates = p.filter(
        (F.col("prev.side") == "in") & (F.col("side") == "out")
        & ~F.col("prev.ordering_ambiguous") & ~F.col("ordering_ambiguous")
        & (F.col("elapsed") > 0) & (F.col("elapsed") <= HOUR)
    )
    return candidates.filter(similar).select(
        *keys, F.col("prev.event_reference").alias("in_reference"),
        F.col("event_reference").alias("out_reference"), "elapsed",
        F.col("prev.amount_base_units").alias("received"),
        F.col("amount_base_units").alias("sent"),
        F.unix_seconds("block_time").alias("sent_at"),
        "_seq",
    )


def rapid_forwarding(pairs: DataFrame, scope: list[str]) -> DataFrame:
    """First matching pair per wallet and asset."""
    keys = [*scope, "address", "token_contract"]
    first = F.min_by(
        F.struct("in_reference", "out_reference", "elapsed", "received", "sent"),
        F.struct("sent_at", "_seq", "out_reference"),
    )
    return pairs.groupBy(*keys).agg(first.alias("f")).select(*keys, "f.*")


def repeated_forwarding(pairs: DataFrame, scope: list[str]) -> DataFrame:
    return (
        pairs.groupBy(*scope, "address", "token_contract")
        .agg(F.count(F.lit(1)).alias("observed_pairs"))
        .filter("observed_pairs >= 3")
    )


def peeling_split(events: DataFrame, scope: list[str], services: DataFrame | None = None) -> DataFrame:
    """Exactly two sends to two wallets within an hour, the smaller at most a tenth."""
    keys = [*scope, "from_address", "token_contract"]
    # Only counts and extremes are kept per wallet, never its list of sends.
    amount = amounts.limbs(F.col("amount_base_units"))
    two = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.min("to_address") != F.max("to_address")).alias("two_recipients"),
        F.min(amount).alias("small"),
        F.max(amount).alias("large"),
        F.count("block_time").alias("timed"),
        (F.unix_seconds(F.max("block_time")) - F.unix_seconds(F.min("block_time"))).alias("apart"),
        F.min("event_reference").alias("first_reference"),
        F.max("event_reference").alias("last_reference"),
    ).filter("n = 2 AND two_recipients AND timed = 2 AND apart <= 3600")
    total = amounts.add(F.col("small"), F.col("large"))
    hit = two.filter(amounts.scaled(F.col("small"), 100) <= amounts.scaled(total, 10))
    return _without(hit, services, "from_address").select(
        *scope, F.col("from_address").alias("address"), "token_contract",
        amounts.render(F.col("small")).alias("smaller_base_units"),
        amounts.render(F.col("large")).alias("larger_base_units"),
        "first_reference", "last_reference",
    )


def intermediaries(
    events: DataFrame, scope: list[str], pairs: DataFrame, services: DataFrame | None = None
) -> DataFrame:
    """Wallets that both receive and send, with the rules that apply to them."""
    keys = [*scope, "address", "token_contract"]

    def side(own: str, other: str, name: str) -> DataFrame:
        linked = events.select(*scope, F.col(own).alias("address"), "token_contract", other).distinct()
        return linked.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    both = side("to_address", "from_address", "incoming_sources").join(
        side("from_address", "to_address", "outgoing_destinations"), keys
    )
    rapid = pairs.select(*keys).distinct().withColumn("rapid", F.lit(True))
    out = _without(both, services, "address").join(rapid, keys, "left")
    factors = reasons(
        (F.col("rapid"), "observed_rapid_forwarding"),
        (F.col("incoming_sources") >= 3, "observed_fan_in"),
        (F.col("outgoing_destinations") >= 3, "observed_fan_out"),
    )
    return out.select(
        *keys, "incoming_sources", "outgoing_destinations", F.array_join(factors, ",").alias("factors")
    )


def cyclic_topology(events: DataFrame, scope: list[str]) -> DataFrame:
    """Whether each graph has a directed cycle.

    Wallets without incoming edges cannot lie on a cycle, nor can wallets without
    outgoing ones. Both ends are peeled and chains contracted until nothing changes;
    edges that stay are there because a cycle holds them.
    """
    graphs = events.select(*scope).distinct()
    edges, _ = peel(events.select(*scope, F.col("from_address").alias("a"), F.col("to_address").alias("b")).distinct(), scope)
    cyclic = edges.select(*scope).distinct().withColumn("has_directed_cycle", F.lit(True))
    return graphs.join(cyclic, scope, "left").withColumn(
        "has_directed_cycle", F.coalesce("has_directed_cycle", F.lit(False))
    )


def pattern_id(rule: Column, address: Column, *refs: Column) -> Column:
    """Identity of a finding: 16 hex digits over rule, address and sorted references."""
    joined = F.array_join(F.sort_array(F.array_distinct(F.array(*refs))), "|") if refs else F.lit("")
    return F.substring(F.sha2(F.concat_ws("|", rule, address, joined), 256), 1, 16)


def fan_references(events: DataFrame, scope: list[str], side: str, services: DataFrame | None = None) -> DataFrame:
    """Every event of every fan, one row each."""
    own = "to_address" if side == "in" else "from_address"
    keys = [*scope, "address", "token_contract"]
    rows = events.select(*scope, F.col(own).alias("address"), "token_contract", "event_reference")
    return rows.join(fan(events, scope, side, services).select(*keys), keys, "left_semi")


def repeated_references(pairs: DataFrame, scope: list[str]) -> DataFrame:
    """Both events of every pair of every repeated forwarding, one row each."""
    keys = [*scope, "address", "token_contract"]
    rows = pairs.select(*keys, F.explode(F.array("in_reference", "out_reference")).alias("event_reference"))
    return rows.join(repeated_forwarding(pairs, scope).select(*keys), keys, "left_semi")


def digest_of(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One digest of the distinct values of each key, in two steps.

    Values are dealt by the first three hex digits of their own digest; each part is sorted
    and digested, then the at most 4096 part digests in order. A hot key's values are so
    spread over many tasks, and the result does not depend on their order.
    """
    # Equal values share a part, so values move once; a NULL counts and is not in a digest. Part
    # digests travel as bytes, half as long as their digits.
    part = F.substring(F.sha2(value, 256), 1, 3).alias("_p")
    dealt = rows.select(*keys, value, part).repartition(*keys, "_p")
    held = dealt.groupBy(*keys, "_p").agg(F.sort_array(F.collect_set(value)).alias("_v"), F.max(F.col(value).isNull().cast("int")).alias("_null"))
    parts = held.select(
        *keys, "_p", (F.size("_v") + F.col("_null")).cast("long").alias("n"), F.unhex(F.sha2(F.array_join("_v", "|"), 256)).alias("d")
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_p", "d"))), lambda x: F.lower(F.hex(x["d"])))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sha2(F.array_join(ordered, "|"), 256).alias("digest"))


def wide_pattern_ids(references: DataFrame, scope: list[str]) -> DataFrame:
    """Identity of findings that may have any number of references, from their digest."""
    found = digest_of(references, [*scope, "rule", "address", "token_contract"], "event_reference")
    ident = F.substring(F.sha2(F.concat_ws("|", "rule", "address", "digest"), 256), 1, 16)
    return found.select(*scope, "rule", "address", "token_contract", F.col("n").alias("references_seen"), ident.alias("pattern_id"))


def triage_score(findings: DataFrame, scope: list[str]) -> DataFrame:
    """Sum of rule weights, each rule once per graph, with its band."""
    weight = F.coalesce(*[F.when(F.col("rule") == r, F.lit(w)) for r, w in RULE_WEIGHTS.items()])
    once = findings.select(*scope, "rule").distinct()
    score = F.least(F.lit(100), F.sum(weight)).cast("long")
    return (
        once.groupBy(*scope)
        .agg(score.alias("score"), F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("rules"))
        .withColumn(
            "priority",
            F.when(F.col("score") >= 45, "high").when(F.col("score") >= 20, "medium")
            .when(F.col("score") > 0, "low").otherwise("unscored"),
        )
    )


def recommendations(traces: DataFrame) -> DataFrame:
    """Action list per trace from ``boundaries``, ``excluded`` counts and ``coverage_status``."""
    gaps = (F.col("coverage_status") != "complete_within_scope") | (F.col("excluded") > 0)
    actions = reasons(
        (F.lit(True), "preserve_evidence"),
        (F.lit(True), "review_scope"),
        (F.col("boundaries") > 0, "review_vasp_request"),
        (gaps, "resolve_data_gaps"),
    )
    return traces.withColumn("actions", F.array_join(actions, ","))
