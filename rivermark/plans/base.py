"""The input projections of ``sources/tables.py``, as SQL common table expressions."""

from __future__ import annotations

from rivermark.sources.tables import EPOCH, FIRST_DATE

LEDGER = f"""ledger AS (
 SELECT 'n0' AS network_key, 'a0' AS token_contract,
  concat_ws(':','tx',l_orderkey,l_linenumber,l_partkey,l_suppkey,CAST(l_quantity AS BIGINT)) AS event_reference,
  'h' || l_orderkey AS tx_hash,
  CASE WHEN l_linenumber = 7 THEN 'approval' ELSE 'transfer' END AS event_kind,
  'w' || o_custkey AS from_address,
  'w' || ((l_partkey*31 + l_suppkey) % (SELECT count(*) FROM customer)) AS to_address,
  CAST(l_quantity AS BIGINT) * 1000000 AS amount,
  CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'success' END AS execution_status,
  CASE WHEN l_returnflag = 'R' THEN 'removed' ELSE 'confirmed' END AS confirmation_state,
  {EPOCH} + (CAST(epoch(o_orderdate) AS BIGINT) - {FIRST_DATE} + l_orderkey % 86400) // 500 AS t,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE
   lpad(CAST(l_orderkey AS VARCHAR),12,'0') || ':' || lpad(CAST(l_linenumber AS VARCHAR),6,'0') END AS seq,
  l_linenumber = 6 AS ordering_ambiguous, CAST(l_linenumber AS BIGINT) AS line,
  l_orderkey AS order_key, o_custkey AS sender_key,
  (l_partkey*31 + l_suppkey) % (SELECT count(*) FROM customer) AS recipient_key,
  l_partkey AS part_key, l_suppkey AS supplier_key
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

SPENDABLE = (
    "event_kind='transfer' AND execution_status='success' AND confirmation_state='confirmed' AND amount>0"
)

#: Spendable events of the plain, busy and thin projections.
SPENT = f"spent AS (SELECT * FROM ledger WHERE {SPENDABLE})"
HUB = f"""hub AS (SELECT * REPLACE ('w' || (sender_key % 50) AS from_address,
 'w' || (recipient_key % 50) AS to_address) FROM ledger WHERE {SPENDABLE})"""
SPARSE = f"""sparse AS (SELECT * REPLACE ('a' || (part_key % 20) AS token_contract),
 't:' || ((t - {EPOCH}) // 3600) || ':a' || (part_key % 20) AS trace_id FROM ledger WHERE {SPENDABLE})"""

LABELS = f"""labels_in AS (
 SELECT 'n0' AS network_key, 'w' || c_custkey AS address,
  CASE WHEN copy = 2 THEN 'Rival ' ELSE 'Service ' END || c_nationkey AS entity_name,
  CASE c_custkey % 3 WHEN 0 THEN 'exchange' WHEN 1 THEN 'custodial_service' ELSE 'bridge' END AS entity_type,
  CASE WHEN c_acctbal >= 8500 AND c_acctbal < 9000 THEN 'deposit_candidate' ELSE 'service_control' END AS assertion_type,
  CASE c_custkey % 4 WHEN 0 THEN 'deposit' WHEN 1 THEN 'hot_wallet' WHEN 2 THEN 'settlement' ELSE 'unknown' END AS address_role,
  CASE WHEN c_acctbal >= 9000 THEN 'accepted' WHEN c_acctbal >= 8500 THEN 'unreviewed'
   WHEN c_acctbal >= 8000 THEN 'unreviewed' WHEN c_acctbal >= 7750 THEN 'accepted'
   WHEN c_acctbal >= 7600 THEN 'rejected' ELSE 'quarantined' END AS review_state,
  'src:' || c_custkey || ':' || copy AS source_reference,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {EPOCH} + (c_custkey * 37) % 200000 END AS valid_from,
  CASE WHEN c_acctbal < 8000 THEN {EPOCH} + 1000 WHEN c_custkey % 5 = 0 THEN NULL
   ELSE {EPOCH} + 150000 + (c_custkey * 91) % 260000 END AS valid_to,
  c_custkey * 2 + copy AS row_no
 FROM customer JOIN (VALUES (1),(2)) v(copy) ON copy = 1 OR (c_acctbal >= 9000 AND c_acctbal < 9300)
 WHERE c_acctbal >= 7500)"""

#: Accepted service claims that cover a moment ``t`` of a row ``x``.
ACTIVE = (
    "l.assertion_type='service_control' AND l.review_state='accepted'"
    " AND (l.valid_from IS NULL OR x.t >= l.valid_from) AND (l.valid_to IS NULL OR x.t <= l.valid_to)"
)

OBS = f"""obs AS (
 SELECT 'n0' AS network, 'u' || user_id AS candidate_address,
  CASE WHEN event_type IN ('click','view') THEN 'incoming' ELSE 'outgoing' END AS direction,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'p' || (event_id % 23) END AS counterparty_address,
  'e' || event_id AS event_reference, 'h' || (event_id // 2) AS tx_hash,
  CAST(floor(value * 100) AS BIGINT) AS amount,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS t,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 11 END AS event_index,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id // 10 END AS block_number,
  CASE WHEN event_type = 'error' THEN 'unknown' ELSE 'success' END AS execution_status,
  CASE WHEN event_id % 31 = 0 THEN 'removed' ELSE 'confirmed' END AS confirmation_state,
  event_id % 5 = 0 AS ordering_ambiguous, event_type, event_id, user_id
 FROM events)"""

ACCOUNTS = """accounts AS (
 SELECT 'u' || user_id AS candidate_address,
  CASE WHEN user_id % 6 = 0 THEN NULL ELSE 'p' || (user_id % 23) END AS anchor_address,
  user_id % 5 = 1 AS incoming_truncated, user_id % 7 = 2 AS outgoing_truncated, user_id
 FROM events GROUP BY user_id)"""


def sql(*parts: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
