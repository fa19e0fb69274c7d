"""Per-wallet behaviour features."""

from __future__ import annotations

from rivermark.operators import behaviour as b
from rivermark.plans.base import ACCOUNTS, OBS, sql
from rivermark.registry import query
from rivermark.sources import tables as src


@query("behavior_counts", sql(OBS, body="""
SELECT candidate_address, count(*) FILTER (WHERE direction='incoming') AS incoming_count,
 count(DISTINCT counterparty_address) FILTER (WHERE direction='incoming') AS incoming_counterparties,
 CAST(coalesce(sum(amount) FILTER (WHERE direction='incoming'),0) AS VARCHAR) AS incoming_units,
 count(*) FILTER (WHERE direction='outgoing') AS outgoing_count,
 count(DISTINCT counterparty_address) FILTER (WHERE direction='outgoing') AS outgoing_counterparties,
 CAST(coalesce(sum(amount) FILTER (WHERE direction='outgoing'),0) AS VARCHAR) AS outgoing_units
FROM obs GROUP BY 1"""))
def _(spark, sf):
    return b.behaviour_counts(src.observations(spark, sf))


@query("anchor_concentration", sql(OBS, ACCOUNTS, body="""
SELECT a.candidate_address, CASE WHEN anchor_address IS NOT NULL THEN
  CAST(coalesce(sum(amount) FILTER (WHERE counterparty_address = anchor_address),0) AS DOUBLE) / nullif(CAST(sum(amount) AS DOUBLE),0) END AS concentration,
 CASE WHEN anchor_address IS NULL THEN 'unknown' WHEN count(o.event_id)=0 THEN CASE WHEN outgoing_truncated THEN 'truncated' ELSE 'unknown' END
  WHEN outgoing_truncated THEN 'truncated' ELSE 'complete' END AS status
FROM accounts a LEFT JOIN obs o ON o.candidate_address = a.candidate_address AND o.direction='outgoing'
GROUP BY a.candidate_address, anchor_address, outgoing_truncated"""))
def _(spark, sf):
    return b.anchor_concentration(src.observations(spark, sf), src.accounts(spark, sf))


_CP = """cp AS (SELECT candidate_address, counterparty_address AS cp, count(*) AS n, CAST(sum(amount) AS BIGINT) AS units
 FROM obs WHERE direction='outgoing' GROUP BY 1,2)"""


@query("max_concentration", sql(OBS, _CP, body="""
SELECT candidate_address, arg_min(cp, (-n, cp)) FILTER (WHERE cp IS NOT NULL) AS by_count,
 arg_min(cp, (-units, cp)) FILTER (WHERE cp IS NOT NULL) AS by_amount,
 CAST(max(n) FILTER (WHERE cp IS NOT NULL) AS DOUBLE)/sum(n) AS max_by_count,
 CAST(max(units) FILTER (WHERE cp IS NOT NULL) AS DOUBLE)/CAST(nullif(sum(units),0) AS DOUBLE) AS max_by_amount
FROM cp GROUP BY 1"""))
def _(spark, sf):
    return b.max_concentration(src.observations(spark, sf))


@query("repeat_counterparties", sql(OBS, _CP, body="""
SELECT candidate_address, max(n) AS repeated_forwarding_count, count(*) FILTER (WHERE n>1) AS with_repeat
FROM cp WHERE cp IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    return b.repeat_counterparties(src.observations(spark, sf))


_MATCH = """ins AS (SELECT candidate_address, t, max(event_reference) AS ref FROM obs WHERE direction='incoming' AND t IS NOT NULL GROUP BY 1,2),
side AS (SELECT candidate_address, count(*) FILTER (WHERE direction='incoming') AS n_in FROM obs GROUP BY 1),
outs AS (SELECT * FROM obs WHERE direction='outgoing' AND t IS NOT NULL),
m0 AS (SELECT o.candidate_address, o.event_reference AS out_reference, i.ref AS in_reference, (o.t - i.t)*1000000 AS gap_us
 FROM outs o ASOF LEFT JOIN ins i ON o.candidate_address = i.candidate_address AND o.t > i.t),
m AS (SELECT m0.*, CASE WHEN gap_us IS NOT NULL THEN CASE WHEN incoming_truncated OR outgoing_truncated THEN 'truncated' ELSE 'complete' END
  WHEN n_in = 0 THEN 'unknown' WHEN incoming_truncated THEN 'truncated' ELSE 'unknown' END AS status
 FROM m0 JOIN side USING (candidate_address) JOIN accounts USING (candidate_address))"""


def _matches(spark, sf):
    return b.receipt_to_outflow(src.observations(spark, sf), src.accounts(spark, sf))


@query("receipt_to_outflow", sql(OBS, ACCOUNTS, _MATCH, body="SELECT * FROM m"))
def _(spark, sf):
    return _matches(spark, sf)


@query("gap_summary", sql(OBS, ACCOUNTS, _MATCH, body="""
, r AS (SELECT *, row_number() OVER (PARTITION BY candidate_address ORDER BY gap_us) AS rn,
 count(*) OVER (PARTITION BY candidate_address) AS n FROM m WHERE gap_us IS NOT NULL)
SELECT g.*, CASE WHEN pairs % 2 = 1 THEN (SELECT gap_us FROM r WHERE r.candidate_address = g.candidate_address AND rn = n//2+1) END AS median_gap_us,
 CASE WHEN pairs=0 THEN 'unknown' WHEN pairs%2=0 THEN 'not_applicable' ELSE 'reported' END AS median_status
FROM (SELECT candidate_address, count(gap_us) AS pairs, count(*) FILTER (WHERE gap_us IS NULL) AS ambiguous,
 min(gap_us) AS min_gap_us, arg_min(out_reference, (gap_us, out_reference)) FILTER (WHERE gap_us IS NOT NULL) AS min_gap_reference
 FROM m GROUP BY 1) g""".lstrip()))
def _(spark, sf):
    return b.gap_summary(_matches(spark, sf))


@query("residue", sql(OBS, ACCOUNTS, body="""
, s AS (SELECT candidate_address, sum(amount) FILTER (WHERE direction='incoming') AS i, sum(amount) FILTER (WHERE direction='outgoing') AS o FROM obs GROUP BY 1)
SELECT candidate_address, CASE WHEN i IS NOT NULL AND o IS NOT NULL AND NOT incoming_truncated AND NOT outgoing_truncated THEN CAST(i-o AS VARCHAR) END AS residue_base_units,
 CASE WHEN i IS NOT NULL AND o IS NOT NULL AND NOT incoming_truncated AND NOT outgoing_truncated THEN 'complete' ELSE 'unknown' END AS status
FROM accounts LEFT JOIN s USING (candidate_address)""".lstrip()))
def _(spark, sf):
    return b.residue(src.observations(spark, sf), src.accounts(spark, sf))


@query("quality_axes", sql(OBS, body="""
SELECT candidate_address, CASE WHEN bool_and(execution_status='success') THEN 'receipt_verified' WHEN bool_and(execution_status='unknown') THEN 'history_only' ELSE 'mixed' END AS verification_quality,
 CASE WHEN bool_and(event_index IS NOT NULL) THEN 'receipt_event_index' WHEN NOT bool_or(event_index IS NOT NULL) THEN 'observation_reference_only' ELSE 'mixed' END AS event_identity_quality,
 CASE WHEN NOT bool_or(ordering_ambiguous) THEN 'precise' WHEN bool_and(ordering_ambiguous) THEN 'ambiguous' ELSE 'timestamp_only' END AS ordering_quality
FROM obs GROUP BY 1"""))
def _(spark, sf):
    return b.quality_axes(src.observations(spark, sf))


@query("uncertainty_counts", sql(OBS, body="""
SELECT candidate_address, count(*) FILTER (WHERE execution_status<>'success') AS unverified,
 count(*) FILTER (WHERE ordering_ambiguous) AS ambiguous_order, count(*) FILTER (WHERE event_index IS NULL) AS missing_index,
 count(*) FILTER (WHERE block_number IS NULL) AS missing_block,
 CASE WHEN bool_and(execution_status='success') THEN 'verified_by_collection' ELSE 'not_verified' END AS execution_status
FROM obs GROUP BY 1"""))
def _(spark, sf):
    return b.uncertainty_counts(src.observations(spark, sf))


@query("receipt_crossref", sql(OBS, body="""
SELECT o.candidate_address, count(r.tx) AS receipt_verified_rows FROM obs o
LEFT JOIN (SELECT DISTINCT 'h' || o_orderkey AS tx FROM orders WHERE o_orderstatus <> 'P') r ON r.tx = o.tx_hash GROUP BY 1"""))
def _(spark, sf):
    receipts = src.table(spark, sf, "orders").selectExpr(
        "concat('h', o_orderkey) AS tx_hash",
        "CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'success' END AS execution_status",
    )
    return b.receipt_crossref(src.observations(spark, sf), receipts)


@query("run_completeness", sql(OBS, ACCOUNTS, body="""
SELECT a.candidate_address, min(t) AS window_start, max(t) AS window_end, count(*) AS rows,
 NOT incoming_truncated AS incoming_complete, NOT outgoing_truncated AS outgoing_complete,
 CASE WHEN incoming_truncated OR outgoing_truncated THEN 'truncated' ELSE 'complete' END AS acquisition_completeness
FROM accounts a JOIN obs USING (candidate_address) GROUP BY a.candidate_address, incoming_truncated, outgoing_truncated"""))
def _(spark, sf):
    return b.run_completeness(src.observations(spark, sf), src.accounts(spark, sf))

