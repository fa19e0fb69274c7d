"""Registry, review and intake rules, and claim outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivermark.operators import outcome as out
from rivermark.operators import registry_review as reg
from rivermark.plans.base import ACCOUNTS, LABELS, OBS, sql
from rivermark.plans.resources import _RES
from rivermark.plans.traces import ENDINGS, saved
from rivermark.registry import query
from rivermark.sources import tables as src

_DOC = [
    "CASE WHEN c_custkey % 31 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN 'n9' ELSE 'n0' END AS network",
    "CASE WHEN c_custkey % 29 = 0 THEN ' ' ELSE concat('w', c_custkey) END AS address",
    "CASE WHEN c_custkey % 23 = 0 THEN '' ELSE concat('Service ', c_nationkey) END AS entity_name",
    "CASE WHEN c_custkey % 19 = 0 THEN 'rumour' WHEN c_custkey % 3 = 0 THEN 'deposit_candidate' WHEN c_custkey % 3 = 1 THEN 'service_control' ELSE 'sanctions_tag' END AS assertion_type",
    "CASE c_custkey % 4 WHEN 0 THEN 'deposit' WHEN 1 THEN 'cold_reserve' WHEN 2 THEN 'hot_wallet' ELSE 'unknown' END AS address_role",
    "CASE c_custkey % 5 WHEN 0 THEN 'proof_of_reserves' WHEN 1 THEN 'signed_address_verification' WHEN 2 THEN 'aggregator_tagpack' WHEN 3 THEN 'authorized_observation' ELSE 'chain_observation' END AS disclosure_kind",
    "concat('doc', c_custkey % 40) AS source_hash", "concat('up', c_custkey % 11) AS upstream_source", "c_custkey",
]
_IMP = f"""doc AS (SELECT {', '.join(_DOC)} FROM customer),
imp AS (SELECT *, CASE WHEN trim(network)='' THEN 'network_not_stated' WHEN network<>'n0' THEN 'network_mismatch' WHEN trim(address)='' THEN 'missing_address' WHEN assertion_type='rumour' THEN 'unreadable_row'
 WHEN entity_name='' THEN 'missing_entity' WHEN (disclosure_kind='proof_of_reserves' AND address_role NOT IN ('cold_reserve','unknown')) OR (disclosure_kind='authorized_observation' AND address_role NOT IN ('deposit','unknown'))
  OR (disclosure_kind='chain_observation' AND address_role<>'unknown') THEN 'role_not_supported_by_source' END AS rejection,
 disclosure_kind IN ('aggregator_tagpack','authorized_observation','chain_observation') AS lead FROM doc)"""


def _imported(spark, sf):
    return reg.import_checked(src.table(spark, sf, "customer").selectExpr(*_DOC), "n0")


@query("import_routing", sql(_IMP, body="""
SELECT c_custkey, CASE WHEN assertion_type='deposit_candidate' THEN 'deposit_candidates' WHEN assertion_type='service_control' AND NOT lead THEN 'verified_anchors' ELSE 'independent_review' END AS destination,
 CASE WHEN assertion_type='service_control' AND lead THEN CASE WHEN disclosure_kind='aggregator_tagpack' THEN 'aggregator_cannot_verify' ELSE 'observation_is_not_an_anchor' END END AS downgrade FROM imp WHERE rejection IS NULL"""))
def _(spark, sf):
    return _imported(spark, sf).filter("rejection IS NULL").select("c_custkey", "destination", "downgrade")


@query("import_rejections", sql(_IMP, body="SELECT rejection, count(*) AS rows FROM imp WHERE rejection IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return _imported(spark, sf).filter("rejection IS NOT NULL").groupBy("rejection").agg(F.count(F.lit(1)).alias("rows"))


@query("corroboration", """
SELECT 'n' || (o_custkey % 2) AS network, 'w' || (o_custkey % 700) AS address, count(DISTINCT o_orderpriority) AS independent_sources, count(DISTINCT o_orderkey % 50) AS documents FROM orders GROUP BY 1,2""")
def _(spark, sf):
    claims = src.table(spark, sf, "orders").selectExpr(
        "concat('n', o_custkey % 2) AS network", "concat('w', o_custkey % 700) AS address", "o_orderpriority AS upstream_source", "o_orderkey % 50 AS source_hash"
    )
    return reg.corroboration(claims)


@query("independent_sources", """
SELECT o_orderstatus AS review_state, count(DISTINCT o_custkey) FILTER (WHERE o_custkey%9<>0) + count(*) FILTER (WHERE o_custkey%9=0) AS independent_sources, count(*) AS records FROM orders GROUP BY 1""")
def _(spark, sf):
    rows = src.table(spark, sf, "orders").selectExpr(
        "o_orderstatus AS review_state", "CASE WHEN o_custkey % 9 = 0 THEN ' ' ELSE cast(o_custkey as string) END AS upstream_source_id"
    )
    return reg.independent_sources(rows, ["review_state"])


_COMP = """cmp AS (SELECT l.*, coalesce(lo <> trim(entity_name) OR hi <> trim(entity_name), false) AS competing FROM labels_in l JOIN
 (SELECT address, min(trim(entity_name)) FILTER (WHERE review_state NOT IN ('rejected','conflicted')) AS lo, max(trim(entity_name)) FILTER (WHERE review_state NOT IN ('rejected','conflicted')) AS hi FROM labels_in GROUP BY 1) e USING (address))"""


@query("competing_claims", sql(LABELS, _COMP, body="SELECT address, source_reference, competing FROM cmp"))
def _(spark, sf):
    return reg.competing_claims(src.labels(spark, sf)).select("address", "source_reference", "competing")


def _claim_files(spark, sf):
    """Claims with their source file; documents stand for the preserved files."""
    docs = src.table(spark, sf, "documents")
    n = docs.agg(F.count(F.lit(1))).scalar()
    files = docs.selectExpr("concat('d', doc_id) AS file", "sha2(text, 256) AS actual").filter("file <> 'd3'")
    want = docs.selectExpr("doc_id", "sha2(text, 256) AS sha")
    claims = src.labels(spark, sf).withColumn("doc", F.col("row_no") % n).join(want, F.col("doc") == F.col("doc_id"))
    return claims.selectExpr(
        "*", "concat('d', doc) AS source_file", "CASE WHEN row_no % 13 = 0 THEN 'other' ELSE sha END AS source_hash",
        "CASE WHEN row_no % 3 = 0 THEN concat('d', CASE WHEN row_no % 2 = 0 THEN doc ELSE -1 END) END AS original_reference",
        "CASE WHEN row_no % 3 = 0 THEN CASE WHEN row_no % 4 = 0 THEN 'other' ELSE sha END END AS original_hash",
        "CASE WHEN row_no % 3 = 0 AND row_no % 5 <> 0 THEN 'm' END AS original_member", "CASE WHEN row_no % 3 = 0 THEN 'r' END AS original_row_locator",
    ), files


_INT = """cf AS (SELECT c.*, row_no % (SELECT count(*) FROM documents) AS doc FROM cmp c),
ci AS (SELECT *, row_no%13<>0 AND doc<>3 AS source_intact, CASE WHEN row_no%3<>0 THEN NULL WHEN row_no%5=0 THEN 'original_source_unlinked' WHEN row_no%2=1 OR doc=3 THEN 'original_source_missing' WHEN row_no%4=0 THEN 'original_source_changed' END AS original_problem FROM cf)"""


@query("source_integrity", sql(LABELS, _COMP, _INT, body="SELECT source_reference, source_intact, original_problem FROM ci"))
def _(spark, sf):
    claims, files = _claim_files(spark, sf)
    return reg.source_integrity(claims, files).select("source_reference", "source_intact", "original_problem")


@query("review_outcomes", sql(LABELS, _COMP, _INT, body="""
, d AS (SELECT *, CASE row_no%4 WHEN 0 THEN 'reject' ELSE 'accept' END AS action, row_no%5=1 AND destination<>'verified_anchors' AS prom FROM (SELECT *, CASE WHEN assertion_type='deposit_candidate' THEN 'deposit_candidates' WHEN review_state='accepted' THEN 'verified_anchors' ELSE 'independent_review' END AS destination FROM ci)),
r AS (SELECT *, CASE WHEN row_no%37=0 THEN 'reviewer_required' WHEN row_no%41=0 THEN 'rationale_required' WHEN row_no%43=0 THEN 'no_such_claim' WHEN action='accept' AND row_no%47=0 THEN 'source_not_inspected' WHEN action='accept' AND NOT source_intact THEN 'source_changed'
 WHEN action='accept' AND original_problem IS NOT NULL THEN original_problem WHEN prom AND assertion_type='deposit_candidate' THEN 'candidate_cannot_become_an_anchor' WHEN prom AND row_no%2=0 THEN 'promotion_without_independent_evidence'
 WHEN action='accept' AND competing AND row_no%3=0 THEN 'conflict_unacknowledged' END AS refusal FROM d)
SELECT row_no AS decision_id, address, CASE WHEN row_no%43=0 THEN 'none' ELSE source_reference END AS source_reference, refusal, CASE WHEN refusal IS NULL THEN CASE action WHEN 'accept' THEN 'accepted' ELSE 'rejected' END END AS to_state,
 CASE WHEN refusal IS NULL AND prom THEN 'verified_anchors' END AS promoted_to, refusal IS NULL AND action='accept' AND competing AS marks_conflict FROM r""".lstrip()))
def _(spark, sf):
    claims, files = _claim_files(spark, sf)
    sound = reg.source_integrity(reg.competing_claims(claims), files).withColumn(
        "destination", F.expr("CASE WHEN assertion_type = 'deposit_candidate' THEN 'deposit_candidates' WHEN review_state = 'accepted' THEN 'verified_anchors' ELSE 'independent_review' END")
    )
    decisions = src.labels(spark, sf).selectExpr(
        "row_no AS decision_id", "network_key", "address", "CASE WHEN row_no % 43 = 0 THEN 'none' ELSE source_reference END AS source_reference",
        "CASE WHEN row_no % 37 = 0 THEN ' ' ELSE 'R. Smith' END AS reviewer", "CASE WHEN row_no % 41 = 0 THEN '' ELSE 'because' END AS rationale",
        "CASE row_no % 4 WHEN 0 THEN 'reject' ELSE 'accept' END AS action", "row_no % 5 = 1 AS promote", "row_no % 3 <> 0 AS conflict_acknowledged",
        "CASE WHEN row_no % 47 = 0 THEN 'something else' ELSE concat('opened ', source_reference) END AS evidence_inspected",
        "CASE WHEN row_no % 2 = 1 THEN array('signed_ownership') ELSE array('same_pattern') END AS corroboration",
    )
    drop = ["row_no", "doc", "doc_id", "sha"]
    found = reg.review_outcomes(decisions, sound.drop(*drop))
    return found.withColumn("marks_conflict", F.coalesce("marks_conflict", F.lit(False)))


@query("review_queue", sql(LABELS, body="SELECT address, source_reference, assertion_type FROM labels_in WHERE review_state='unreviewed'"))
def _(spark, sf):
    claims = src.labels(spark, sf)
    sets = [claims.filter(F.col("assertion_type") == a) for a in ("service_control", "deposit_candidate")]
    return reg.review_queue(sets).select("address", "source_reference", "assertion_type")


_CTL = [
    "'n0' AS network", "concat('w', c_custkey) AS address",
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'self_custody' WHEN 'MACHINERY' THEN 'payment_service' WHEN 'HOUSEHOLD' THEN 'frequent_exchange_customer' ELSE 'other' END AS control_category",
    "CASE c_custkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'quarantined' ELSE 'unreviewed' END AS review_state",
    "CASE WHEN c_custkey % 12 = 0 THEN '' ELSE concat('ref', c_custkey) END AS source_reference",
    "CASE WHEN c_custkey % 14 = 0 THEN '' ELSE 'attested' END AS evidence_type", "concat('up', c_custkey % 9) AS upstream_source_id",
    "CASE c_custkey % 6 WHEN 0 THEN 'AI reviewer' WHEN 1 THEN '' ELSE 'Aiyana Modelska' END AS reviewer", "c_custkey AS record_id",
]


def _control(spark, sf):
    return src.table(spark, sf, "customer").selectExpr(*_CTL)


_CT = f"ctl AS (SELECT {', '.join(_CTL)} FROM customer)"


@query("control_wallets", sql(_CT, body="""
SELECT address, problem, problem IS NULL AND review_state='accepted' AS usable FROM (SELECT *, CASE WHEN control_category='other' THEN 'unsupported_category' WHEN source_reference='' THEN 'source_required' WHEN evidence_type='' THEN 'evidence_type_required' END AS problem FROM ctl)"""))
def _(spark, sf):
    return reg.control_wallets(_control(spark, sf)).select("address", "problem", "usable")


@query("registry_states", sql(_CT, body="SELECT review_state, count(*) AS n FROM ctl GROUP BY 1"))
def _(spark, sf):
    return _control(spark, sf).groupBy(F.coalesce(F.nullif(F.trim("review_state"), F.lit("")), F.lit("unknown")).alias("review_state")).agg(F.count(F.lit(1)).alias("n"))


@query("control_review", sql(_CT, body="""
, d AS (SELECT *, CASE record_id%3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'quarantine' END AS action FROM ctl),
r AS (SELECT *, CASE action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'quarantined' END AS st FROM d),
f AS (SELECT *, CASE WHEN reviewer='' OR reviewer='AI reviewer' THEN 'reviewer_required' WHEN record_id%25=0 THEN 'rationale_required' WHEN record_id%8=0 THEN 'evidence_not_identified'
 WHEN review_state IN ('accepted','rejected','quarantined') AND NOT (review_state='accepted' AND st='quarantined') THEN 'already_terminal' END AS refusal FROM r)
SELECT record_id AS decision_id, refusal, review_state AS from_state, CASE WHEN refusal IS NULL THEN st END AS to_state FROM f""".lstrip()))
def _(spark, sf):
    registry = _control(spark, sf)
    decisions = registry.selectExpr(
        "record_id AS decision_id", "network", "address", "control_category", "reviewer", "CASE record_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'quarantine' END AS action",
        "CASE WHEN record_id % 25 = 0 THEN '' ELSE 'r' END AS rationale", "CASE WHEN record_id % 8 = 0 THEN 'unrelated' ELSE concat('saw ', upstream_source_id) END AS evidence_inspected",
    )
    known = registry.select("network", "address", "control_category", "review_state", F.nullif("source_reference", F.lit("")).alias("source_reference"), "upstream_source_id")
    return reg.control_review(decisions, known)


@query("wallet_eligibility", sql(_CT, body="""
SELECT network, address, CASE WHEN record_id < (SELECT count(DISTINCT user_id) FROM events) THEN 'materializable_window_present' WHEN review_state='accepted' THEN 'accepted_but_no_materializable_window' ELSE 'not_accepted_and_no_materializable_window' END AS status FROM ctl"""))
def _(spark, sf):
    runs = src.table(spark, sf, "events").selectExpr("'n0' AS network", "concat('w', user_id) AS address")
    return reg.wallet_eligibility(_control(spark, sf), runs)


@query("registration_verdicts", sql(_CT, body="""
SELECT network, address, want AS control_category, CASE WHEN absent THEN 'not_found' WHEN want<>control_category THEN 'category_mismatch' WHEN review_state='accepted' AND (source_reference='' OR reviewer IN ('','AI reviewer')) THEN 'accepted_invalid'
 WHEN review_state='accepted' THEN 'accepted' WHEN review_state='unreviewed' THEN 'unreviewed' ELSE 'terminal_not_accepted' END AS verdict
FROM (SELECT network, CASE WHEN record_id%10=0 THEN 'q' || record_id ELSE address END AS address, record_id%10=0 AS absent, CASE WHEN record_id%7=0 THEN 'energy_rental_recipient' ELSE control_category END AS want, control_category, review_state, source_reference, reviewer FROM ctl)"""))
def _(spark, sf):
    registry = _control(spark, sf)
    incoming = registry.selectExpr(
        "network", "CASE WHEN record_id % 10 = 0 THEN concat('q', record_id) ELSE address END AS address", "CASE WHEN record_id % 7 = 0 THEN 'energy_rental_recipient' ELSE control_category END AS control_category"
    )
    return reg.registration_verdicts(incoming, registry)


#: Complaints of up to four neighbouring orders; networks of eight assets, one of forty unsupported.
_INTAKE = """a AS (SELECT 'n' || (p_partkey // 8) AS network_key, 'a' || p_partkey AS c, p_partkey % 40 <> 7 AS ok FROM part),
nets AS (SELECT network_key, count(*) FILTER (WHERE ok) AS offered FROM a GROUP BY 1),
w AS (SELECT 'c' || (o_orderkey // 4) AS ref, (o_orderkey // 4) % 11 = 0 AS late, CASE WHEN o_orderkey % 97 = 0 THEN 'nx' ELSE 'n' || (o_custkey % 20) END AS network_key, 'w' || o_custkey AS address,
 CASE WHEN o_orderkey % 3 = 0 THEN 'a' || ((o_custkey % 20) * 8 + o_orderkey % 8) END AS tc, CASE WHEN o_orderkey % 12 = 0 OR o_orderkey % 101 = 0 THEN 'e' || o_orderkey END AS seed FROM orders),
t AS (SELECT DISTINCT ref, network_key, address, c, seed FROM w JOIN a USING (network_key) WHERE ok AND (tc IS NULL OR tc = c)),
m AS (SELECT w.*, offered, (SELECT count(*) FROM a WHERE a.network_key = w.network_key AND ok AND (w.tc IS NULL OR w.tc = a.c)) AS hits FROM w LEFT JOIN nets USING (network_key)),
v AS (SELECT ref, (SELECT count(*) FROM t WHERE t.ref = m.ref) AS tasks, CASE WHEN bool_or(late) THEN 'start_after_cutoff' WHEN bool_or(offered IS NULL) THEN 'unsupported_network'
 WHEN min(hits) = 0 THEN 'no_supported_asset' WHEN bool_or(seed IS NOT NULL AND hits <> 1) THEN 'seed_needs_one_asset' WHEN (SELECT count(*) FROM t WHERE t.ref = m.ref) > 60 THEN 'too_many_tasks' END AS reason FROM m GROUP BY ref)"""


def _intake(spark, sf):
    assets = src.table(spark, sf, "part").selectExpr("concat('n', p_partkey div 8) AS network_key", "concat('a', p_partkey) AS token_contract", "p_partkey % 40 <> 7 AS is_supported")
    report = (
        "named_struct('network_key', CASE WHEN o_orderkey % 97 = 0 THEN 'nx' ELSE concat('n', o_custkey % 20) END, 'address', concat('w', o_custkey),"
        " 'token_contract', CASE WHEN o_orderkey % 3 = 0 THEN concat('a', o_custkey % 20 * 8 + o_orderkey % 8) END,"
        " 'seed_event_reference', CASE WHEN o_orderkey % 12 = 0 OR o_orderkey % 101 = 0 THEN concat('e', o_orderkey) END)"
    )
    # At most four orders share a complaint, so its wallet list stays short.
    complaints = src.table(spark, sf, "orders").groupBy(F.expr("o_orderkey div 4").alias("k")).agg(F.expr(f"collect_list({report})").alias("wallets")).selectExpr(
        "concat('c', k) AS external_reference", "wallets", "CASE WHEN k % 11 = 0 THEN timestamp_seconds(2000) ELSE timestamp_seconds(500) END AS analysis_start",
        "timestamp_seconds(1000) AS analysis_cutoff",
    )
    return complaints, assets


@query("intake_tasks", sql(_INTAKE, body="""
SELECT ref AS external_reference, address, c AS token_contract, seed AS seed_event_reference, CASE WHEN seed IS NULL THEN 'address_discovery' ELSE 'incident' END AS mode, tasks,
 sha256(network_key || '|' || address || '|' || c || '|' || coalesce(seed,'') || '|' || CASE WHEN seed IS NULL THEN 'address_discovery' ELSE 'incident' END) AS fingerprint FROM t JOIN v USING (ref) WHERE reason IS NULL"""))
def _(spark, sf):
    return reg.intake_tasks(*_intake(spark, sf)).select("external_reference", "address", "token_contract", "seed_event_reference", "mode", "tasks", "fingerprint")


@query("intake_refusals", sql(_INTAKE, body="SELECT ref AS external_reference, tasks, reason FROM v"))
def _(spark, sf):
    return reg.intake_refusals(*_intake(spark, sf))


@query("intake_dedupe", """
SELECT 'gw' AS source, 'r' || o_orderkey AS external_reference, CASE WHEN o_orderkey%3=0 THEN 'new' WHEN o_orderkey%5=0 OR o_orderkey%7=0 THEN 'conflict' ELSE 'duplicate' END AS verdict FROM orders""")
def _(spark, sf):
    o = src.table(spark, sf, "orders")
    base = ["'gw' AS source", "concat('r', o_orderkey) AS external_reference"]
    incoming = o.selectExpr(*base, "sha2(o_orderstatus, 256) AS payload_sha256", "'LIVE' AS data_mode")
    existing = o.filter("o_orderkey % 3 <> 0").selectExpr(
        *base, "CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE sha2(o_orderstatus, 256) END AS payload_sha256", "CASE WHEN o_orderkey % 7 = 0 THEN 'SYNTHETIC' ELSE 'LIVE' END AS data_mode"
    )
    return reg.intake_dedupe(incoming, existing)


@query("seed_drafts", """
SELECT 'c' || o_orderkey AS complaint_reference, CASE WHEN o_orderstatus='O' THEN 'incident' ELSE 'address_discovery' END AS mode, 'n0' AS network_key, 'w' || o_custkey AS address,
 CASE WHEN o_orderstatus='O' THEN CAST(o_orderkey*100 AS VARCHAR) END AS amount_base_units FROM orders""")
def _(spark, sf):
    return reg.seed_drafts(src.table(spark, sf, "orders").selectExpr(
        "concat('c', o_orderkey) AS complaint_reference", "CASE WHEN o_orderstatus = 'O' THEN 'e1' ELSE '' END AS seed_event_reference", "'n0' AS network_key",
        "concat('w', o_custkey) AS address", "cast(o_orderkey * 100 as string) AS amount_base_units",
    ))


@query("seed_validation", """
SELECT o_orderkey AS seed_id, CASE WHEN o_orderstatus='O' AND o_orderkey%4=0 THEN 'asset_required' WHEN o_orderstatus<>'O' AND o_orderkey%3=0 THEN 'amount_not_accepted' WHEN o_orderkey%3=0 AND o_orderkey%2=0 THEN 'amount_not_an_integer' END AS problem,
 CASE WHEN o_orderstatus='O' THEN 'established' ELSE 'not_established' END AS case_flow_linkage FROM orders""")
def _(spark, sf):
    return reg.seed_validation(src.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS seed_id", "CASE WHEN o_orderstatus = 'O' THEN 'incident' ELSE 'address_discovery' END AS mode", "CASE WHEN o_orderkey % 4 <> 0 THEN 'a' END AS asset_id",
        "CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '1.5' ELSE '15' END END AS amount_base_units",
    ))


@query("resolve_assets", """
WITH a AS (SELECT p_partkey, 'n' || CASE WHEN p_partkey%50<40 THEN p_partkey%50 ELSE 100+p_partkey END AS network_key FROM part WHERE p_size%3<>0),
n AS (SELECT network_key, count(*) AS k, min(p_partkey) AS one FROM a GROUP BY 1),
r AS (SELECT o_orderkey, 'n' || CASE WHEN o_orderkey%3=0 THEN 100+o_custkey ELSE o_custkey%50 END AS network_key, CASE WHEN o_orderkey%2=0 THEN o_custkey END AS want FROM orders)
SELECT o_orderkey AS request_id, CASE WHEN want IS NOT NULL THEN e.p_partkey WHEN n.k=1 THEN n.one END AS asset_id,
 CASE WHEN want IS NOT NULL AND e.p_partkey IS NULL THEN 'contract_not_supported' WHEN want IS NULL AND coalesce(n.k,0)<>1 THEN 'asset_not_specified' END AS problem
FROM r LEFT JOIN n USING (network_key) LEFT JOIN a e ON e.network_key = r.network_key AND e.p_partkey = r.want""")
def _(spark, sf):
    assets = src.table(spark, sf, "part").selectExpr(
        "p_partkey AS asset_id", "concat('n', CASE WHEN p_partkey % 50 < 40 THEN p_partkey % 50 ELSE 100 + p_partkey END) AS network_key", "concat('a', p_partkey) AS token_contract", "p_size % 3 <> 0 AS is_supported"
    )
    requests = src.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS request_id", "concat('n', CASE WHEN o_orderkey % 3 = 0 THEN 100 + o_custkey ELSE o_custkey % 50 END) AS network_key", "CASE WHEN o_orderkey % 2 = 0 THEN concat('a', o_custkey) END AS token_contract"
    )
    return reg.resolve_assets(requests, assets)


_AT = src.EPOCH + 100_000


def _claims(spark, sf):
    """Candidate wallets against the first claim on record for the wallet they name."""
    one = F.min_by(F.struct("network_key", "entity_name", "review_state", "valid_from", "valid_to"), "row_no")
    anchors = src.labels(spark, sf).groupBy("address").agg(one.alias("c")).select("address", "c.*")
    candidates = src.table(spark, sf, "orders").selectExpr(
        "concat('o', o_orderkey) AS candidate_address", "concat('w', o_custkey) AS anchor_address", "CASE WHEN o_orderkey % 15 = 0 THEN 'n1' ELSE 'n0' END AS network_key",
        f"timestamp_seconds({_AT}) AS at", "CASE WHEN o_orderstatus = 'O' THEN 'receipt_verified' ELSE 'history_only' END AS verification_quality",
        "o_orderkey % 8 = 0 AS ordering_ambiguous", "o_orderkey % 6 <> 0 AS has_evidence", "o_orderkey % 21 = 0 AS conflict",
    )
    return out.claims(candidates, anchors)


_CLM = f"""anc AS (SELECT * FROM labels_in QUALIFY row_number() OVER (PARTITION BY address ORDER BY row_no)=1),
clm AS (SELECT 'o' || o_orderkey || '->w' || o_custkey AS claim_id, o_orderkey, a.entity_name AS service_name, a.review_state AS label_review_state,
 CASE WHEN a.entity_name IS NOT NULL THEN (a.valid_from IS NULL OR {_AT} >= a.valid_from) AND (a.valid_to IS NULL OR {_AT} <= a.valid_to) END AS label_in_date, CASE WHEN a.entity_name IS NOT NULL THEN o_orderkey%15<>0 END AS label_network_matches,
 o_orderstatus='O' AND o_orderkey%8<>0 AS proven, o_orderkey%6<>0 AS has_evidence, o_orderkey%21=0 AS conflict FROM orders LEFT JOIN anc a ON a.address = 'w' || o_custkey),
oc AS (SELECT *, CASE WHEN reason IS NULL THEN 'supported_destination' WHEN reason IN ('unreviewed_label','insufficient_verification') AND has_evidence THEN 'candidate_lead' ELSE 'unknown_or_blocked' END AS category FROM (
 SELECT *, CASE WHEN conflict THEN 'unresolved_conflict' WHEN service_name IS NULL THEN 'no_accepted_label' WHEN label_review_state<>'accepted' THEN 'unreviewed_label' WHEN NOT label_in_date THEN 'expired_label' WHEN NOT label_network_matches THEN 'wrong_network' WHEN NOT proven THEN 'insufficient_verification' END AS reason FROM clm)),
ie AS (SELECT claim_id, n AS qualifying, s AS sources, n>=1 AND s>=2 AS promoted FROM (SELECT c.claim_id, count(*) FILTER (WHERE l_linenumber%2=1 AND l_returnflag<>'A') AS n, count(DISTINCT l_suppkey%5) FILTER (WHERE l_linenumber%2=1 AND l_returnflag<>'A') AS s FROM clm c JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1))"""


@query("claims", sql(LABELS, _CLM, body="SELECT claim_id, service_name, label_review_state, label_in_date, label_network_matches FROM clm"))
def _(spark, sf):
    return _claims(spark, sf).select("claim_id", "service_name", "label_review_state", "label_in_date", "label_network_matches")


@query("service_outcomes", sql(LABELS, _CLM, body="SELECT claim_id, category, reason, CASE WHEN category<>'unknown_or_blocked' THEN service_name END AS shown_service FROM oc"))
def _(spark, sf):
    return out.service_outcomes(_claims(spark, sf)).select("claim_id", "category", "reason", "shown_service")


def _evidence(spark, sf):
    lines = src.table(spark, sf, "lineitem").join(src.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return out.independent_evidence(lines.selectExpr(
        "concat('o', o_orderkey, '->w', o_custkey) AS claim_id", "CASE WHEN l_linenumber % 2 = 1 THEN 'reviewed_linkage' ELSE 'behavioral' END AS family",
        "l_returnflag <> 'A' AS reviewed", "true AS address_specific", "l_suppkey % 5 AS upstream_source_id",
    ))


@query("independent_evidence", sql(LABELS, _CLM, body="SELECT * FROM ie"))
def _(spark, sf):
    return _evidence(spark, sf)


@query("strong_inference", sql(LABELS, _CLM, body="""
SELECT claim_id, CASE WHEN category='candidate_lead' AND b IS NULL THEN 'strong_inference' ELSE category END AS category, CASE WHEN category='candidate_lead' THEN b END AS blocked_by FROM (
 SELECT oc.claim_id, category, CASE WHEN o_orderkey%10=0 THEN 'backdated_state' WHEN NOT coalesce(label_in_date AND label_network_matches,false) THEN 'label_scope' WHEN NOT coalesce(promoted,false) THEN 'missing_evidence' END AS b FROM oc LEFT JOIN ie USING (claim_id))"""))
def _(spark, sf):
    rows = out.service_outcomes(_claims(spark, sf)).withColumn(
        "current_state_only", F.expr("cast(regexp_extract(claim_id, 'o([0-9]+)', 1) as bigint) % 10 = 0")
    ).withColumn("claimed_as_historical", F.lit(True))
    return out.strong_inference(rows, _evidence(spark, sf))


@query("evidence_levels", sql(OBS, _RES, ACCOUNTS, body="""
, cd AS (SELECT candidate_address, anchor_address, incoming_truncated OR outgoing_truncated AS tr, user_id FROM accounts),
anc AS (SELECT 'p' || (s_suppkey%30) AS a, min(s_suppkey) AS f, max(s_suppkey) AS u FROM supplier WHERE s_suppkey%30 < 15 GROUP BY 1),
p AS (SELECT candidate_address, count(*) AS n, min(t) AS f, max(t) AS u FROM obs WHERE direction='outgoing' GROUP BY 1), b AS (SELECT candidate_address, count(*) AS n, min(t) AS f, max(t) AS u FROM obs GROUP BY 1),
r AS (SELECT candidate_address, count(*) AS n, min(t) AS f, max(t) AS u FROM res WHERE rel<>'token_transfer' GROUP BY 1)
SELECT candidate_address, 'anchor_only' AS level, CASE WHEN a IS NOT NULL THEN 'complete' ELSE 'not_applicable' END AS status, anc.f AS scope_start, anc.u AS scope_end, CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS evidence_rows FROM cd LEFT JOIN anc ON a = anchor_address
UNION ALL SELECT candidate_address, 'chronological_tracing', CASE WHEN n>0 THEN 'complete' ELSE 'not_applicable' END, f, u, coalesce(n,0) FROM cd LEFT JOIN p USING (candidate_address)
UNION ALL SELECT candidate_address, 'tracing_plus_behavioral_rules', CASE WHEN n>0 THEN CASE WHEN tr THEN 'truncated' ELSE 'complete' END ELSE 'not_applicable' END, f, u, coalesce(n,0) FROM cd LEFT JOIN b USING (candidate_address)
UNION ALL SELECT candidate_address, 'tracing_plus_behavioral_rules_plus_resource_evidence', CASE WHEN n>0 THEN CASE WHEN tr THEN 'truncated' ELSE 'complete' END ELSE 'not_applicable' END, f, u, coalesce(n,0) FROM cd LEFT JOIN r USING (candidate_address)""".lstrip()))
def _(spark, sf):
    acc, rows = src.accounts(spark, sf), src.observations(spark, sf)
    anchors = src.table(spark, sf, "supplier").filter("s_suppkey % 30 < 15").groupBy(F.expr("concat('p', s_suppkey % 30) AS address")).agg(
        F.min("s_suppkey").alias("valid_from"), F.max("s_suppkey").alias("valid_to")
    )
    cut = acc.selectExpr("candidate_address", "incoming_truncated OR outgoing_truncated AS truncated")

    def part(df):
        return df.groupBy("candidate_address").agg(
            F.count(F.lit(1)).alias("n"), F.unix_seconds(F.min("block_time")).alias("first_at"), F.unix_seconds(F.max("block_time")).alias("last_at")
        )

    resources = src.resource_rows(spark, sf).filter("relationship_type <> 'token_transfer'")
    return out.evidence_levels(
        acc, anchors, part(rows.filter("direction = 'outgoing'")), part(rows).join(cut, "candidate_address"), part(resources).join(cut, "candidate_address")
    )


@query("trace_unverified", sql(*ENDINGS, body="""
SELECT trace_id, event_reference, tx_hash, CASE WHEN order_key%11=0 THEN 'receipt_unavailable' ELSE 'result_not_stated' END AS reason FROM obs_t WHERE order_key%11=0 OR order_key%5=0"""))
def _(spark, sf):
    receipts = src.table(spark, sf, "orders").filter("o_orderkey % 11 <> 0").selectExpr(
        "concat('h', o_orderkey) AS tx_hash", "CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'success' END AS execution_status", "'confirmed' AS confirmation_state"
    )
    # The receipts decide, not the statuses the walk carried.
    return out.trace_unverified(saved(spark, sf).observed.drop("execution_status", "confirmation_state"), receipts)
