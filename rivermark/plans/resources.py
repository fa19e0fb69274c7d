"""Resource evidence and sponsor leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivermark.operators import resources as res
from rivermark.plans.base import OBS, sql
from rivermark.registry import query
from rivermark.sources import tables as src

_RES = """res AS (SELECT candidate_address, coalesce(counterparty_address,'unknown') AS cp, CASE event_type WHEN 'purchase' THEN 'token_transfer' WHEN 'click' THEN 'trx_funding' ELSE 'resource_delegation' END AS rel,
 CASE event_type WHEN 'view' THEN 'current_state_only' ELSE 'historical' END AS temporal, CASE event_type WHEN 'signup' THEN 'delegate' WHEN 'error' THEN 'undelegate' WHEN 'view' THEN CASE WHEN event_id%2=0 THEN 'current_index' ELSE 'current_detail' END END AS op,
 event_reference, amount, t, event_id, user_id FROM obs)"""
R = (OBS, _RES)
HIST = "rel='resource_delegation' AND temporal='historical'"


@query("resource_counts", sql(*R, body="""
SELECT rel AS relationship_type, temporal AS temporal_status, count(*) AS rows, count(*) FILTER (WHERE op='delegate') AS delegate,
 count(*) FILTER (WHERE op='undelegate') AS undelegate FROM res GROUP BY ROLLUP (rel, temporal)"""))
def _(spark, sf):
    out = res.resource_counts(src.resource_rows(spark, sf))
    return out.select("relationship_type", "temporal_status", "rows", F.coalesce("delegate", F.lit(0)).alias("delegate"), F.coalesce("undelegate", F.lit(0)).alias("undelegate"))


@query("counterparty_types", sql(*R, body="SELECT cp AS counterparty_address, string_agg(DISTINCT rel, ',' ORDER BY rel) AS types, count(*) AS rows FROM res GROUP BY 1"))
def _(spark, sf):
    return res.counterparty_types(src.resource_rows(spark, sf))


@query("resource_token", sql(*R, body="""
SELECT candidate_address, count(*) AS token_transfers, CAST(sum(amount) AS VARCHAR) AS token_units, count(DISTINCT cp) AS distinct_anchors FROM res WHERE rel='token_transfer' GROUP BY 1"""))
def _(spark, sf):
    return res.resource_token(src.resource_rows(spark, sf))


@query("resource_history", sql(*R, body=f"""
SELECT candidate_address, count(*) AS operations, count(*) FILTER (WHERE op='delegate') AS delegate, count(*) FILTER (WHERE op='undelegate') AS undelegate,
 count(DISTINCT cp) AS counterparties, min(t) AS first_at, max(t) AS last_at FROM res WHERE {HIST} GROUP BY 1"""))
def _(spark, sf):
    return res.resource_history(src.resource_rows(spark, sf))


@query("resource_gap", sql(*R, body=f"""
SELECT candidate_address, gap_seconds, CASE WHEN gap_seconds IS NULL THEN 'unknown' ELSE 'complete' END AS status FROM (
 SELECT candidate_address, max(t) FILTER (WHERE rel='token_transfer') - max(t) FILTER (WHERE {HIST}) AS gap_seconds FROM res GROUP BY 1)"""))
def _(spark, sf):
    return res.resource_gap(src.resource_rows(spark, sf))


@query("resource_current", sql(*R, body="""
SELECT candidate_address, count(DISTINCT cp) AS current_counterparties, min(t) AS observed_from, max(t) AS observed_to FROM res WHERE temporal='current_state_only' GROUP BY 1"""))
def _(spark, sf):
    return res.resource_current(src.resource_rows(spark, sf))


@query("resource_funding", sql(*R, body="""
SELECT candidate_address, count(*) FILTER (WHERE rel='trx_funding') AS fundings, CAST(coalesce(sum(amount) FILTER (WHERE rel='trx_funding'),0) AS VARCHAR) AS funding_units,
 CASE WHEN any_value(user_id)%5=1 THEN 'truncated' ELSE 'complete' END AS status FROM res GROUP BY 1"""))
def _(spark, sf):
    cut = src.accounts(spark, sf).select("candidate_address", F.col("incoming_truncated").alias("truncated"))
    return res.resource_funding(src.resource_rows(spark, sf), cut)


@query("resource_evidence_rows", """
WITH h AS (SELECT 'w' || o_custkey AS w, o_orderkey, epoch(o_orderdate) AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'trx_funding' ELSE 'resource_delegation' END AS rel,
 CASE o_orderkey % 3 WHEN 1 THEN 'delegate' WHEN 2 THEN 'undelegate' END AS op FROM orders WHERE o_orderstatus <> 'P'),
n AS (SELECT *, row_number() OVER (PARTITION BY w, rel ORDER BY t, 'h' || o_orderkey) AS rn, count(*) OVER (PARTITION BY w, rel) AS k FROM h)
SELECT w AS candidate_address, rel AS relationship_type, 'h' || o_orderkey AS tx_id, op AS operation_type, k > CASE rel WHEN 'resource_delegation' THEN 4 ELSE 2 END AS truncated
FROM n WHERE rn <= CASE rel WHEN 'resource_delegation' THEN 4 ELSE 2 END""")
def _(spark, sf):
    history = src.table(spark, sf, "orders").selectExpr(
        "concat('w', o_custkey) AS candidate_address", "concat('h', o_orderkey) AS tx_id",
        "CASE o_orderkey % 3 WHEN 0 THEN 'TransferContract' WHEN 1 THEN 'DelegateResourceContract' ELSE 'UnDelegateResourceContract' END AS contract_type",
        "CASE WHEN o_orderstatus = 'P' THEN 'other' ELSE concat('w', o_custkey) END AS receiver_address",
        "CASE WHEN o_orderstatus = 'P' THEN 'other' ELSE concat('w', o_custkey) END AS to_address",
        f"timestamp_seconds({src.epoch_seconds('o_orderdate')}) AS block_time",
    )
    return res.resource_evidence_rows(history, 4, 2).select("candidate_address", "relationship_type", "tx_id", "operation_type", "truncated")


def _delegations(spark, sf):
    """Orders as delegations: supplier-like sponsors to customers, dated or current."""
    return src.table(spark, sf, "orders").selectExpr(
        "concat('s', o_orderkey % 61 * (o_orderkey % 7)) AS sponsor", "concat('w', o_custkey) AS receiver",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'energy' ELSE 'bandwidth' END AS resource",
        "CASE WHEN o_orderstatus = 'P' THEN 'current_state' ELSE 'historical_operation' END AS basis",
        f"timestamp_seconds({src.epoch_seconds('o_orderdate')}) AS observed_at",
        f"timestamp_seconds({src.epoch_seconds('o_orderdate')} - 86400) AS operation_time", "o_orderkey",
    )


_DEL = """del AS (SELECT 's' || (o_orderkey % 61 * (o_orderkey % 7)) AS sponsor, 'w' || o_custkey AS receiver, CASE WHEN o_orderkey%5=0 THEN NULL WHEN o_orderkey%2=0 THEN 'energy' ELSE 'bandwidth' END AS resource,
 o_orderstatus='P' AS cur, CAST(epoch(o_orderdate) AS BIGINT) AS t, o_orderkey FROM orders),
lead_p AS (SELECT sponsor, receiver, count(*) AS observations, bool_or(cur) AS undated, any_value(f.n) AS sponsor_fanout FROM del JOIN (SELECT sponsor, count(DISTINCT receiver) AS n FROM del GROUP BY 1) f USING (sponsor) GROUP BY 1,2)"""


@query("resource_current_rows", sql(_DEL, body="""
SELECT receiver AS candidate_address, sponsor, resource, CASE WHEN resource IS NULL THEN 'current_index' ELSE 'current_detail' END AS operation_type,
 max(place) OVER (PARTITION BY receiver) > 2 AS truncated_by_provider_limit
FROM (SELECT *, dense_rank() OVER (PARTITION BY receiver ORDER BY sponsor) AS place FROM (SELECT DISTINCT sponsor, receiver, resource FROM del WHERE cur) WHERE receiver IN (SELECT 'w' || user_id FROM events))
QUALIFY place <= 2"""))
def _(spark, sf):
    current = _delegations(spark, sf).filter("basis = 'current_state'").select("sponsor", "receiver", "resource").distinct()
    wanted = src.accounts(spark, sf).selectExpr("concat('w', user_id) AS candidate_address")
    return res.resource_current_rows(current, wanted, 2).select("candidate_address", "sponsor", "resource", "operation_type", "truncated_by_provider_limit")


@query("backfill_operation_type", sql(*R, body="""
SELECT event_reference, CASE WHEN event_id%4=0 THEN op WHEN rel<>'resource_delegation' THEN NULL WHEN event_id%4=1 THEN 'current_index' WHEN event_id%4=2 THEN 'current_detail' WHEN event_id%8=3 THEN 'delegate' ELSE 'undelegate' END AS operation_type FROM res"""))
def _(spark, sf):
    rows = src.resource_rows(spark, sf).selectExpr(
        "tx_or_operation_id AS event_reference", "relationship_type",
        "CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'delegation_index_current_state' WHEN 2 THEN 'delegated_resource_detail_current_state' ELSE 'historical_operation_scan' END AS acquisition_mode",
        "CASE WHEN event_id % 8 = 3 THEN 'DelegateResourceContract operation' ELSE 'UnDelegateResourceContract operation' END AS interpretation_limitations",
        "CASE WHEN event_id % 4 = 0 THEN operation_type END AS operation_type",
    )
    return res.backfill_operation_type(rows).select("event_reference", "operation_type")


@query("sponsor_leads", sql(_DEL, body="SELECT *, sponsor_fanout >= 20 AS shared_service FROM lead_p"))
def _(spark, sf):
    return res.sponsor_leads(_delegations(spark, sf))


@query("lead_promotion", sql(_DEL, body="""
SELECT sponsor, receiver, sponsor_fanout<20 AND observations%3=0 AS allowed, CASE WHEN sponsor_fanout>=20 THEN 'shared_service' WHEN observations%3<>0 THEN 'no_independent_evidence' ELSE 'independent_evidence' END AS reason,
 CASE WHEN sponsor_fanout<20 AND observations%3=0 THEN 'inferred' END AS resulting_status FROM lead_p"""))
def _(spark, sf):
    leads = res.sponsor_leads(_delegations(spark, sf)).withColumn(
        "corroboration", F.when(F.col("observations") % 3 == 0, F.array(F.lit("shared_sponsor"), F.lit("signed_ownership"))).otherwise(F.array(F.lit("shared_sponsor")))
    )
    return res.lead_promotion(leads)


@query("delegation_active_at", sql(_DEL, body="""
SELECT o_orderkey, CASE WHEN cur THEN CASE WHEN 899251200 >= t THEN true END ELSE 899251200 >= t - 86400 END AS active, CASE WHEN cur THEN 'unknown' ELSE 'dated' END AS established FROM del"""))
def _(spark, sf):
    return res.active_at(_delegations(spark, sf), F.timestamp_seconds(F.lit(899251200))).select("o_orderkey", "active", "established")


@query("delegation_coverage", sql(_DEL, body="SELECT receiver, CASE WHEN bool_or(NOT cur) THEN 'complete_within_scope' ELSE 'unknown' END AS coverage, count(*) AS observations FROM del GROUP BY 1"))
def _(spark, sf):
    return res.delegation_coverage(_delegations(spark, sf))


@query("scan_coverage", sql(OBS, body="""
, p AS (SELECT 'n' || (user_id % 7) AS anchor_address, candidate_address AS address, direction, count(*) AS n FROM obs GROUP BY 1,2,3),
s AS (SELECT anchor_address, count(DISTINCT address) AS a, count(*) FILTER (WHERE n > 40) AS c FROM p GROUP BY 1)
SELECT anchor_address, least(a, 21) AS examined, c AS cut_histories, concat_ws(',', CASE WHEN a > 21 THEN 'address_limit' END, CASE WHEN c > 0 THEN 'event_limit' END) AS limits_hit, a <= 21 AND c = 0 AS complete FROM s""".lstrip()))
def _(spark, sf):
    scans = src.observations(spark, sf).selectExpr("concat('n', user_id % 7) AS anchor_address", "candidate_address AS address", "direction")
    return res.scan_coverage(scans, 21, 40)
