"""Claims, control wallets and complaints: import, review and intake rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.functions.predicates import _is, first_reason
from rivermark.operators.labels import ADDRESS_ROLES, ASSERTION_TYPES
from rivermark.operators.resources import INDEPENDENT

# Roles a document kind supports (None: any) and kinds that only give leads.
SUPPORTED_ROLES = {
    "proof_of_reserves": ("cold_reserve", "unknown"),
    "signed_address_verification": None,
    "aggregator_tagpack": None,
    "authorized_observation": ("deposit", "unknown"),
    "chain_observation": ("unknown",),
}
LEAD_ONLY = ("aggregator_tagpack", "authorized_observation", "chain_observation")
# States and categories of reviews and controls.
ACTION_STATES = {"accept": "accepted", "reject": "rejected", "quarantine": "quarantined"}
TERMINAL = ("accepted", "rejected", "quarantined")
CONTROL_CATEGORIES = ("self_custody", "frequent_exchange_customer", "payment_service",
                      "energy_rental_recipient", "other_operational_confounder")
CONTROL_STATES = ("unreviewed", "accepted", "rejected", "quarantined")
# Words that mark a reviewer name as automation.
AUTOMATION_WORDS = ("agent", "assistant", "claude", "ai", "bot", "llm", "gpt", "automation", "automated",
                    "system", "model", "anthropic", "chatgpt", "copilot")
MAX_TASKS = 60


def blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c) == "", F.lit(True))


def invalid_reviewer(c: Column) -> Column:
    words = "|".join(AUTOMATION_WORDS)
    return blank(c) | F.coalesce(F.lower(c).rlike(rf"(?<![a-z0-9])({words})(?![a-z0-9])"), F.lit(False))


def import_checked(rows: DataFrame, network: str) -> DataFrame:
    """Add ``rejection``, ``destination`` and ``downgrade`` to document rows."""
    kind, role = F.col("disclosure_kind"), F.trim("address_role")
    limited = F.coalesce(*[
        F.when(kind == k, ~role.isin(*roles)) for k, roles in SUPPORTED_ROLES.items() if roles is not None
    ], F.lit(False))
    rejection = first_reason(
        (blank("network"), "network_not_stated"),
        (F.trim("network") != network, "network_mismatch"),
        (blank("address"), "missing_address"),
        (~F.coalesce(F.trim("assertion_type").isin(*ASSERTION_TYPES) & role.isin(*ADDRESS_ROLES), F.lit(False)), "unreadable_row"),
        (blank("entity_name"), "missing_entity"),
        (limited, "role_not_supported_by_source"),
    )
    control, lead = F.trim("assertion_type") == "service_control", kind.isin(*LEAD_ONLY)
    destination = (
        F.when(F.trim("assertion_type") == "deposit_candidate", "deposit_candidates")
        .when(control & ~lead, "verified_anchors").otherwise("independent_review")
    )
    downgrade = F.when(control & lead, F.when(kind == "aggregator_tagpack", "aggregator_cannot_verify").otherwise("observation_is_not_an_anchor"))
    ok = rejection.isNull()
    return rows.select("*", rejection.alias("rejection"), F.when(ok, destination).alias("destination"), F.when(ok, downgrade).alias("downgrade"))


def corroboration(claims: DataFrame) -> DataFrame:
    """Per address: how many independent sources against how many documents."""
    return claims.groupBy("network", "address").agg(
        F.countDistinct("upstream_source").alias("independent_sources"), F.countDistinct("source_hash").alias("documents")
    )


def independent_sources(rows: DataFrame, keys: list[str], source: str = "upstream_source_id") -> DataFrame:
    """Named sources count once each; every unnamed record counts on its own."""
    named = F.when(~blank(source), F.trim(source))
    return rows.groupBy(*keys).agg(
        (F.countDistinct(named) + F.sum(blank(source).cast("long"))).alias("independent_sources"), F.count(F.lit(1)).alias("records")
    )


def competing_claims(claims: DataFrame) -> DataFrame:
    """Claims that meet another live claim for the address naming a different entity.

    The smallest and largest live entity name decide it, so no claim is paired
    with every other claim of its address.
    """
    live = ~_is("review_state", "rejected", "conflicted")
    name = F.trim("entity_name")
    ends = claims.groupBy("network_key", "address").agg(
        F.min(F.when(live, name)).alias("_lo"), F.max(F.when(live, name)).alias("_hi")
    )
    other = F.coalesce((F.col("_lo") != name) | (F.col("_hi") != name), F.lit(False))
    return claims.join(ends, ["network_key", "address"]).withColumn("competing", other).drop("_lo", "_hi")


def source_integrity(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Does each claim's source file, and the original it was cut from, still match?"""
    kept = files.select(F.col("file").alias("source_file"), F.col("actual").alias("_s"))
    orig = files.select(F.col("file").alias("original_reference"), F.col("actual").alias("_o"))
    j = claims.join(kept, "source_file", "left").join(orig, "original_reference", "left")
    linked = ["original_reference", "original_hash", "original_member", "original_row_locator"]
    none = blank(linked[0]) & blank(linked[1]) & blank(linked[2]) & blank(linked[3])
    some = blank(linked[0]) | blank(linked[1]) | blank(linked[2]) | blank(linked[3])
    original = F.when(none, F.lit(None).cast("string")).otherwise(first_reason(
        (some, "original_source_unlinked"), (F.col("_o").isNull(), "original_source_missing"),
        (F.col("_o") != F.col("original_hash"), "original_source_changed"),
    ))
    return j.withColumn("source_intact", ~blank("source_hash") & F.col("_s").eqNullSafe(F.col("source_hash"))).withColumn(
        "original_problem", original
    ).drop("_s", "_o")


def review_outcomes(decisions: DataFrame, claims: DataFrame) -> DataFrame:
    """Refusal code or resulting state of each review decision.

    ``claims`` carry ``competing``, ``source_intact`` and ``original_problem``.
    """
    j = decisions.join(claims, ["network_key", "address", "source_reference"], "left")
    accept, promote = F.col("action") == "accept", F.col("promote") & (F.col("destination") != "verified_anchors")
    names = F.coalesce(F.col("evidence_inspected").contains(F.col("source_reference")) | F.col("evidence_inspected").contains(F.col("source_hash")), F.lit(False))
    independent = F.size(F.array_intersect("corroboration", F.array(*[F.lit(k) for k in INDEPENDENT]))) > 0
    refusal = first_reason(
        (blank("reviewer"), "reviewer_required"),
        (blank("rationale"), "rationale_required"),
        (F.col("review_state").isNull(), "no_such_claim"),
        (accept & ~names, "source_not_inspected"),
        (accept & ~F.col("source_intact"), "source_changed"),
    )
    refusal = F.coalesce(refusal, F.when(accept, F.col("original_problem")), first_reason(
        (promote & _is("assertion_type", "deposit_candidate"), "candidate_cannot_become_an_anchor"),
        (promote & ~independent, "promotion_without_independent_evidence"),
        (accept & F.col("competing") & ~F.col("conflict_acknowledged"), "conflict_unacknowledged"),
    ))
    state = F.coalesce(*[F.when(F.col("action") == a, F.lit(s)) for a, s in ACTION_STATES.items()])
    ok = refusal.isNull()
    return j.select(
        "decision_id", "address", "source_reference", refusal.alias("refusal"), F.when(ok, state).alias("to_state"),
        F.when(ok & promote, "verified_anchors").alias("promoted_to"), (ok & accept & F.col("competing")).alias("marks_conflict"),
    )


def review_queue(sets: list[DataFrame]) -> DataFrame:
    """Unreviewed claims over all label sets."""
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return out.filter("review_state = 'unreviewed'")


def control_review(decisions: DataFrame, registry: DataFrame) -> DataFrame:
    """Review of control wallets: terminal states stay, except accepted to quarantined."""
    j = decisions.join(registry, ["network", "address", "control_category"], "left")
    state = F.coalesce(*[F.when(F.col("action") == a, F.lit(s)) for a, s in ACTION_STATES.items()])
    now = F.col("review_state")
    names = F.coalesce(F.col("evidence_inspected").contains(F.col("source_reference")), F.lit(False)) | (
        ~blank("upstream_source_id") & F.coalesce(F.col("evidence_inspected").contains(F.col("upstream_source_id")), F.lit(False))
    )
    allowed = (now == "accepted") & (state == "quarantined")
    refusal = first_reason(
        (now.isNull(), "no_such_record"), (invalid_reviewer(F.col("reviewer")), "reviewer_required"),
        (blank("rationale"), "rationale_required"), (~names, "evidence_not_identified"),
        (now.isin(*TERMINAL) & ~allowed, "already_terminal"),
    )
    return j.select("decision_id", refusal.alias("refusal"), now.alias("from_state"), F.when(refusal.isNull(), state).alias("to_state"))


def control_wallets(registry: DataFrame) -> DataFrame:
    """Problem of each control record; only sound accepted ones are usable."""
    problem = first_reason(
        (~_is("control_category", *CONTROL_CATEGORIES), "unsupported_category"), (blank("source_reference"), "source_required"),
        (blank("evidence_type"), "evidence_type_required"), (~_is("review_state", *CONTROL_STATES), "unsupported_state"),
    )
    return registry.withColumn("problem", problem).withColumn("usable", problem.isNull() & (F.col("review_state") == "accepted"))


def wallet_eligibility(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether a window can be built for a wallet: evidence decides, not its state."""
    have = runs.select("network", "address").distinct().withColumn("_run", F.lit(True))
    per = registry.groupBy("network", "address").agg(F.max((F.col("review_state") == "accepted").cast("int")).alias("ok"))
    status = F.when(F.col("_run"), "materializable_window_present").when(F.col("ok") == 1, "accepted_but_no_materializable_window").otherwise(
        "not_accepted_and_no_materializable_window"
    )
    return per.join(have, ["network", "address"], "left").select("network", "address", status.alias("status"))


def registration_verdicts(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """What is left to do for a wallet that is to be registered."""
    key = ["network", "address"]
    any_ = registry.select(*key).distinct().withColumn("_any", F.lit(True))
    exact = registry.groupBy(*key, "control_category").agg(
        F.min_by(F.struct(F.col("review_state").alias("state"), F.col("source_reference").alias("source"), F.col("reviewer").alias("by")), "record_id").alias("e")
    )
    j = incoming.join(any_, key, "left").join(exact, [*key, "control_category"], "left")
    verdict = first_reason(
        (F.col("_any").isNull(), "not_found"), (F.col("e").isNull(), "category_mismatch"),
        ((F.col("e.state") == "accepted") & (blank("e.source") | invalid_reviewer(F.col("e.by"))), "accepted_invalid"),
        (F.col("e.state") == "accepted", "accepted"), (F.col("e.state") == "unreviewed", "unreviewed"), (F.lit(True), "terminal_not_accepted"),
    )
    return j.select(*key, "control_category", verdict.alias("verdict"))


def _reports(complaints: DataFrame, assets: DataFrame) -> DataFrame:
    """Reported wallets with what their network and contract offer; nothing is expanded."""
    w = complaints.select("external_reference", "analysis_start", "analysis_cutoff", F.explode("wallets").alias("w")).select(
        "external_reference", "analysis_start", "analysis_cutoff", "w.*"
    )
    networks = assets.groupBy("network_key").agg(F.count_if("is_supported").alias("_offered"))
    named = assets.filter("is_supported").select("network_key", "token_contract").distinct().withColumn("_named", F.lit(1))
    j = w.join(networks, "network_key", "left").join(named, ["network_key", "token_contract"], "left")
    matching = F.when(F.col("token_contract").isNull(), F.col("_offered")).otherwise(F.coalesce("_named", F.lit(0)))
    return j.withColumn("matching", F.coalesce(matching, F.lit(0)))


def intake_refusals(complaints: DataFrame, assets: DataFrame) -> DataFrame:
    """Verdict per complaint: how many tasks it would make, and why it is refused if it is.

    Tasks are counted from the assets of each network, so a complaint that would expand
    into too many is refused before it expands.
    """
    r = _reports(complaints, assets)
    # Reports of one wallet and seed share tasks: all assets once, or the contracts named.
    per = r.groupBy("external_reference", "network_key", "address", "seed_event_reference").agg(
        F.max(F.when(F.col("token_contract").isNull(), F.col("_offered"))).alias("_all"),
        F.count_distinct(F.when(F.col("_named") == 1, F.col("token_contract"))).alias("_some"),
        F.max(F.coalesce(F.col("analysis_start") > F.col("analysis_cutoff"), F.lit(False))).alias("_late"),
        F.max(F.col("_offered").isNull()).alias("_unknown"), F.min("matching").alias("_least"),
        F.max(F.col("seed_event_reference").isNotNull() & (F.col("matching") != 1)).alias("_vague"),
    )
    each = per.groupBy("external_reference").agg(
        F.sum(F.coalesce("_all", "_some")).alias("tasks"), F.max("_late").alias("late"), F.max("_unknown").alias("unknown"),
        F.min("_least").alias("least"), F.max("_vague").alias("vague"),
    )
    reason = first_reason(
        (F.col("late"), "start_after_cutoff"), (F.col("unknown"), "unsupported_network"), (F.col("least") == 0, "no_supported_asset"),
        (F.col("vague"), "seed_needs_one_asset"), (F.col("tasks") > MAX_TASKS, "too_many_tasks"),
    )
    return each.select("external_reference", "tasks", reason.alias("reason"))


def intake_tasks(complaints: DataFrame, assets: DataFrame) -> DataFrame:
    """Trace tasks of the accepted complaints: one per reported wallet and supported asset, once."""
    accepted = intake_refusals(complaints, assets).filter("reason IS NULL").select("external_reference", "tasks")
    w = complaints.join(accepted, "external_reference").select(
        "external_reference", "tasks", "analysis_start", "analysis_cutoff", F.explode("wallets").alias("w")
    ).select("external_reference", "tasks", "analysis_start", "analysis_cutoff", "w.*")
    dim = assets.filter("is_supported").select("network_key", F.col("token_contract").alias("asset_contract"))
    j = w.join(dim, "network_key").filter("token_contract IS NULL OR token_contract = asset_contract")
    task = j.select(
        "external_reference", "network_key", "address", F.col("asset_contract").alias("token_contract"), "seed_event_reference",
        F.when(F.col("seed_event_reference").isNull(), "address_discovery").otherwise("incident").alias("mode"),
        "analysis_start", "analysis_cutoff", "tasks",
    ).distinct()
    facts = ["network_key", "address", "token_contract", "seed_event_reference", "mode"]
    printed = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in facts]), 256)
    return task.withColumn("fingerprint", printed)


def intake_dedupe(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Same reference and content is a repeat, other content under it a conflict."""
    known = existing.select("source", "external_reference", F.col("payload_sha256").alias("_h"), F.col("data_mode").alias("_m"))
    j = incoming.join(known, ["source", "external_reference"], "left")
    same = (F.col("_h") == F.col("payload_sha256")) & (F.col("_m") == F.col("data_mode"))
    verdict = F.when(F.col("_h").isNull(), "new").when(same, "duplicate").otherwise("conflict")
    return j.select("source", "external_reference", verdict.alias("verdict"))


def seed_drafts(complaints: DataFrame) -> DataFrame:
    """Suggested seed per complaint; an amount is kept only with a named event."""
    has = ~blank("seed_event_reference")
    return complaints.select(
        "complaint_reference", F.when(has, "incident").otherwise("address_discovery").alias("mode"), "network_key", "address",
        F.when(has, F.col("amount_base_units")).alias("amount_base_units"),
    )


def seed_validation(seeds: DataFrame) -> DataFrame:
    problem = first_reason(
        ((F.col("mode") == "incident") & F.col("asset_id").isNull(), "asset_required"),
        ((F.col("mode") == "address_discovery") & F.col("amount_base_units").isNotNull(), "amount_not_accepted"),
        (F.col("amount_base_units").isNotNull() & ~F.col("amount_base_units").rlike(r"^-*[0-9]+\z"), "amount_not_an_integer"),
    )
    return seeds.select(
        "seed_id", problem.alias("problem"), F.when(F.col("mode") == "incident", "established").otherwise("not_established").alias("case_flow_linkage")
    )


def resolve_assets(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """Exact contract, or the only supported asset of the network; never a guess."""
    ok = assets.filter("is_supported")
    only = ok.groupBy("network_key").agg(F.count(F.lit(1)).alias("_n"), F.min("asset_id").alias("_only"))
    exact = ok.groupBy("network_key", "token_contract").agg(F.min("asset_id").alias("_exact"))
    j = requests.join(only, "network_key", "left").join(exact, ["network_key", "token_contract"], "left")
    picked = F.when(F.col("token_contract").isNotNull(), F.col("_exact")).when(F.col("_n") == 1, F.col("_only"))
    problem = first_reason(
        (F.col("token_contract").isNotNull() & F.col("_exact").isNull(), "contract_not_supported"),
        (F.col("token_contract").isNull() & (F.coalesce("_n", F.lit(0)) != 1), "asset_not_specified"),
    )
    return j.select("request_id", picked.alias("asset_id"), problem.alias("problem"))
