"""Readers and normalisers, fed with raw records that Spark builds from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivermark import scale
from rivermark.functions import addresses, amounts
from rivermark.functions.predicates import direction
from rivermark.plans.base import LEDGER, OBS, sql
from rivermark.registry import query
from rivermark.sources import bundles as bun
from rivermark.sources import chainlogs as evm
from rivermark.sources import events as ev
from rivermark.sources import tables as src


@query("transfer_scan", sql(LEDGER, body=f"""
SELECT event_reference, from_address, to_address, t FROM ledger WHERE (from_address = 'w0' OR to_address = 'w0')
 AND t BETWEEN {src.EPOCH} + 50000 AND {src.EPOCH} + 300000"""))
def _(spark, sf):
    at = lambda s: F.timestamp_seconds(F.lit(src.EPOCH + s))
    rows = ev.transfer_scan(src.ledger(spark, sf), "w0", "both", at(50000), at(300000), F.lit("a0"))
    return rows.select("event_reference", "from_address", "to_address", F.unix_seconds("block_time").alias("t"))


@query("event_search", sql(LEDGER, body="""
SELECT event_reference, true AS has_more FROM ledger WHERE event_reference > 'tx:2' ORDER BY 1 LIMIT 100"""))
def _(spark, sf):
    return ev.event_search(src.ledger(spark, sf).select("event_reference"), "event_reference", F.lit("tx:2"), 100)


@query("watch_direction", sql(LEDGER, body="""
SELECT from_address AS wallet, CASE WHEN from_address = to_address THEN 'self' ELSE 'outgoing' END AS direction, count(*) AS n FROM ledger GROUP BY 1,2
UNION ALL SELECT to_address, 'incoming', count(*) FROM ledger WHERE from_address <> to_address GROUP BY 1,2"""))
def _(spark, sf):
    e = src.ledger(spark, sf).select("from_address", "to_address")
    seen = e.withColumn("wallet", F.explode(F.array_distinct(F.array("from_address", "to_address"))))
    return seen.groupBy("wallet", direction(F.col("wallet")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


def _history(spark, sf):
    """History rows as the account endpoint returns them."""
    return src.ledger(spark, sf).selectExpr(
        "tx_hash AS transaction_id", "unix_seconds(block_time) * 1000 AS block_timestamp", "from_address AS `from`",
        "to_address AS `to`", "amount_base_units AS value",
        "CASE event_kind WHEN 'approval' THEN 'Approval' ELSE CASE WHEN line = 5 THEN 'Other' ELSE 'Transfer' END END AS type",
        "named_struct('address', token_contract, 'decimals', 6, 'name', 'T', 'symbol', 'T') AS token_info", "line",
    )


def _event_rows(spark, sf):
    """Event detail per transaction; some lack an index, some name another contract."""
    return src.ledger(spark, sf).selectExpr(
        "tx_hash", "CASE WHEN event_kind = 'approval' THEN 'Approval' ELSE 'Transfer' END AS event_name",
        "CASE WHEN line = 2 THEN 'zz' ELSE token_contract END AS contract_address",
        "CASE WHEN line = 3 THEN NULL ELSE line END AS event_index", "from_address AS `from`", "to_address AS `to`",
        "amount_base_units AS value",
    )


_HIST = """hist AS (SELECT tx_hash, from_address || '|' || to_address || '|' || amount AS ck, t, line, event_kind, from_address, to_address, amount FROM ledger),
erow AS (SELECT tx_hash, from_address || '|' || to_address || '|' || amount AS ck, CASE WHEN event_kind='approval' THEN 'Approval' ELSE 'Transfer' END AS name,
  CASE WHEN line=2 THEN 'zz' ELSE 'a0' END AS contract, CASE WHEN line=3 THEN NULL ELSE line END AS ix FROM ledger),
pk AS (SELECT tx_hash, ck, count(*) AS n, min(ix) AS ix FROM erow WHERE name='Transfer' AND contract='a0' AND ix IS NOT NULL GROUP BY 1,2),
idx AS (SELECT tx_hash, ck, ix FROM pk WHERE tx_hash IN (SELECT tx_hash FROM pk GROUP BY 1 HAVING max(n)=1))"""


@query("normalize_history_rows", sql(LEDGER, _HIST, body="""
SELECT CASE WHEN ix IS NULL THEN 'tron:' || tx_hash || ':unindexed:' || substring(sha256(ck),1,16) ELSE 'tron:' || tx_hash || ':' || ix END AS event_reference,
 CASE WHEN event_kind='approval' THEN 'approval' WHEN line=5 THEN 'unknown' ELSE 'transfer' END AS event_kind, t, ix IS NULL AS ordering_ambiguous
FROM hist LEFT JOIN idx USING (tx_hash, ck)"""))
def _(spark, sf):
    idx = ev.resolve_event_index(_event_rows(spark, sf), F.lit("a0"))
    return ev.normalize_history(_history(spark, sf), idx).select(
        "event_reference", "event_kind", F.unix_seconds("block_time").alias("t"), "ordering_ambiguous"
    )


@query("resolve_event_index", sql(LEDGER, _HIST, body="SELECT tx_hash, ck AS content_key, ix AS event_index FROM idx"))
def _(spark, sf):
    return ev.resolve_event_index(_event_rows(spark, sf), F.lit("a0"))


@query("reconcile_events", sql(LEDGER, _HIST, body="""
SELECT l.event_reference, h.ck IS NOT NULL AS matched, CASE WHEN h.ck IS NOT NULL THEN 'agrees' WHEN k.tx_hash IS NULL THEN 'no_event_detail' ELSE 'no_matching_event' END AS reason
FROM ledger l LEFT JOIN (SELECT DISTINCT tx_hash, ck FROM erow WHERE name='Transfer' AND contract='a0') h
 ON h.tx_hash = l.tx_hash AND h.ck = l.from_address || '|' || l.to_address || '|' || l.amount
LEFT JOIN (SELECT DISTINCT tx_hash FROM erow WHERE name='Transfer') k ON k.tx_hash = l.tx_hash"""))
def _(spark, sf):
    return ev.reconcile_events(src.ledger(spark, sf), _event_rows(spark, sf))


def _receipts(spark, sf):
    return src.table(spark, sf, "orders").selectExpr(
        "concat('h', o_orderkey) AS tx_hash",
        "CASE o_orderstatus WHEN 'O' THEN 'SUCCESS' WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'REVERT' ELSE 'OUT_OF_ENERGY' END END AS result",
        "o_orderkey % 3 <> 0 AS solidified", "o_orderkey",
    )


_RCPT = """rc AS (SELECT 'h' || o_orderkey AS tx_hash, CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN CASE WHEN o_orderkey%2=0 THEN 'reverted' ELSE 'failed' END ELSE 'unknown' END AS es,
 CASE WHEN o_orderkey%3<>0 THEN 'confirmed' ELSE 'provisional' END AS cs, o_orderkey FROM orders)"""


@query("classify_receipts", sql(_RCPT, body="SELECT tx_hash, es AS execution_status, cs AS confirmation_state FROM rc"))
def _(spark, sf):
    return ev.classify_receipts(_receipts(spark, sf))


def _partial(spark, sf):
    """Receipts that could be read; every eleventh is missing at the provider."""
    return ev.classify_receipts(_receipts(spark, sf).filter("o_orderkey % 11 <> 0"))


@query("verify_execution", sql(LEDGER, _RCPT, body="""
SELECT event_reference, coalesce(es,'unknown') AS execution_status, coalesce(cs,'unknown') AS confirmation_state,
 CASE WHEN es IS NULL THEN 'receipt_unavailable' WHEN es='unknown' THEN 'result_not_stated' END AS unverified
FROM ledger l LEFT JOIN rc ON rc.tx_hash = l.tx_hash AND rc.o_orderkey % 11 <> 0"""))
def _(spark, sf):
    return ev.verify_execution(src.ledger(spark, sf), _partial(spark, sf)).select(
        "event_reference", "execution_status", "confirmation_state", "unverified"
    )


@query("receipt_gate", sql(LEDGER, _RCPT, body="""
SELECT event_reference, CASE WHEN l.confirmation_state='removed' THEN l.execution_status ELSE coalesce(es,'unknown') END AS execution_status,
 CASE WHEN l.confirmation_state='removed' THEN 'removed' ELSE coalesce(cs,'unknown') END AS confirmation_state
FROM ledger l LEFT JOIN rc ON rc.tx_hash = l.tx_hash AND rc.o_orderkey % 11 <> 0"""))
def _(spark, sf):
    return ev.receipt_gate(src.ledger(spark, sf), _partial(spark, sf)).select(
        "event_reference", "execution_status", "confirmation_state"
    )


def _hexaddr(c):
    return f"lpad(lower(hex({c})), 40, '0')"


def _logs(spark, sf):
    """Raw logs: malformed topics, extra topics, long numbers and the largest amount included."""
    z = "repeat('0', 24)"
    return src.ledger(spark, sf).selectExpr(
        "'1' AS chain_id", "'0xA0B1' AS address", "tx_hash AS transactionHash", "concat('0x', CASE WHEN line = 2 THEN repeat('0', 40) ELSE '' END, lower(hex(line))) AS logIndex",
        "concat('0x', lower(hex(order_key))) AS blockNumber", "CASE WHEN line = 6 THEN NULL ELSE '0x1' END AS transactionIndex",
        f"filter(array('{evm.TRANSFER_TOPIC}', concat('0x', CASE WHEN line = 5 THEN '01' ELSE '00' END, repeat('0', 22), {_hexaddr('sender_key')}),"
        f" concat('0x', {z}, {_hexaddr('recipient_key')}), CASE WHEN line = 4 THEN '0x00' END), x -> x IS NOT NULL) AS topics",
        "concat('0x', CASE WHEN line = 3 THEN repeat('f', 64) ELSE lpad(lower(hex(cast(amount_base_units as bigint))), 64, '0') END) AS data",
        "confirmation_state = 'removed' AS removed", "sender_key", "recipient_key",
    )


_LOGS = f"""dl AS (SELECT DISTINCT ON (tx_hash, line) 'eip155:1:' || tx_hash || ':' || line AS event_reference, '0x' || lpad(printf('%x', sender_key),40,'0') AS from_address,
 '0x' || lpad(printf('%x', recipient_key),40,'0') AS to_address, CASE WHEN line=3 THEN '{amounts.UINT256_MAX}' ELSE CAST(amount AS VARCHAR) END AS amount_base_units,
 CASE WHEN confirmation_state='removed' THEN 'removed' ELSE 'unknown' END AS confirmation_state, line=6 AS ordering_ambiguous, order_key FROM ledger WHERE line NOT IN (4,5))"""


@query("decode_transfer_logs", sql(LEDGER, _LOGS.replace("DISTINCT ON (tx_hash, line) ", ""), body="""
SELECT event_reference, from_address, to_address, amount_base_units, confirmation_state, ordering_ambiguous FROM dl"""))
def _(spark, sf):
    return evm.decode_transfer_logs(_logs(spark, sf), F.lit("0xa0b1")).select(
        "event_reference", "from_address", "to_address", "amount_base_units", "confirmation_state", "ordering_ambiguous"
    )


@query("union_dedupe_logs", sql(LEDGER, _LOGS, body=f"""
SELECT event_reference, {src.EPOCH} + order_key AS t FROM dl"""))
def _(spark, sf):
    # Both directions read the same logs, so they are decoded once.
    logs = scale.staged(evm.decode_transfer_logs(_logs(spark, sf), F.lit("0xa0b1")))
    blocks = src.table(spark, sf, "orders").selectExpr(
        "'1' AS chain_id", "o_orderkey AS block_height", f"timestamp_seconds({src.EPOCH} + o_orderkey) AS block_time"
    )
    both = evm.union_dedupe_logs(logs, logs.filter("NOT ordering_ambiguous"), blocks)
    return both.select("event_reference", F.unix_seconds("block_time").alias("t"))


@query("block_range_for_window", """
WITH b AS (SELECT o_custkey % 5 AS net, o_orderkey AS h, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders),
hd AS (SELECT net, max(t) AS ht FROM b GROUP BY 1),
w AS (SELECT c_custkey AS id, c_custkey % 5 AS net, 788918400 + c_custkey * 86400 AS s, 788918400 + c_custkey * 172800 AS c FROM customer),
g AS (SELECT id, max(h) FILTER (WHERE b.t <= w.c) AS hi, coalesce(max(h) FILTER (WHERE b.t < w.s),0) AS lo FROM w JOIN b USING (net) GROUP BY 1)
SELECT CAST(id AS VARCHAR) AS window_id, 'n' || net AS network_key, least(lo, coalesce(hi,0)) AS from_block, coalesce(hi,0) AS to_block,
 CASE WHEN c > ht THEN 'cutoff_after_head' WHEN s > ht THEN 'start_after_head' END AS truncated_reason FROM w JOIN g USING (id) JOIN hd USING (net)""")
def _(spark, sf):
    blocks = src.table(spark, sf, "orders").selectExpr(
        "concat('n', o_custkey % 5) AS network_key", "o_orderkey AS block_height",
        f"timestamp_seconds({src.epoch_seconds('o_orderdate')}) AS block_time",
    )
    windows = src.table(spark, sf, "customer").selectExpr(
        "cast(c_custkey as string) AS window_id", "concat('n', c_custkey % 5) AS network_key",
        f"timestamp_seconds({src.FIRST_DATE} + c_custkey * 86400) AS start",
        f"timestamp_seconds({src.FIRST_DATE} + c_custkey * 172800) AS cutoff",
    )
    return evm.block_ranges(windows, blocks)


@query("receipt_finality", """
WITH tg AS (SELECT o_custkey % 5 AS net, CASE WHEN o_custkey % 5 < 3 THEN max(o_orderkey) // 2 END AS f, CASE WHEN o_custkey % 5 < 4 THEN max(o_orderkey) * 3 // 4 END AS s FROM orders GROUP BY 1),
r AS (SELECT 'h' || o_orderkey AS tx_hash, o_custkey % 5 AS net, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey END AS h, o_orderstatus FROM orders),
d AS (SELECT tx_hash, o_orderstatus, CASE WHEN h IS NULL THEN 'unknown' WHEN h <= f THEN 'finalized' WHEN h <= s THEN 'safe' WHEN f IS NOT NULL OR s IS NOT NULL THEN 'head_unfinalized' ELSE 'unknown' END AS finality FROM r JOIN tg USING (net))
SELECT tx_hash, CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'reverted' ELSE 'unknown' END AS execution_status, finality,
 CASE finality WHEN 'finalized' THEN 'confirmed' WHEN 'unknown' THEN 'unknown' ELSE 'provisional' END AS confirmation_state FROM d""")
def _(spark, sf):
    orders = src.table(spark, sf, "orders")
    receipts = orders.selectExpr(
        "concat('h', o_orderkey) AS tx_hash", "concat('n', o_custkey % 5) AS network_key",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey END AS block_height",
        "CASE o_orderstatus WHEN 'O' THEN '0x1' WHEN 'F' THEN '0x0' END AS status",
    )
    tags = orders.groupBy(F.expr("o_custkey % 5 AS net")).agg(F.max("o_orderkey").alias("top")).selectExpr(
        "concat('n', net) AS network_key", "CASE WHEN net < 3 THEN top div 2 END AS finalized", "CASE WHEN net < 4 THEN top * 3 div 4 END AS safe"
    )
    return evm.receipt_finality(receipts, tags)


@query("parse_account_history", """
SELECT 'h' || o_orderkey AS tx_id, o_orderkey AS block_number, CASE WHEN o_orderkey % 2 = 0 THEN 'TransferContract' ELSE 'DelegateResourceContract' END AS contract_type,
 'w' || o_custkey AS owner_address, CASE WHEN o_orderstatus <> 'P' THEN 'SUCCESS' END AS execution_result FROM orders""")
def _(spark, sf):
    body = """to_json(named_struct('txID', concat('h', o_orderkey), 'blockNumber', o_orderkey, 'block_timestamp', o_orderkey * 1000,
      'raw_data', named_struct('contract', array(named_struct('type', CASE WHEN o_orderkey % 2 = 0 THEN 'TransferContract' ELSE 'DelegateResourceContract' END,
        'parameter', named_struct('value', map('owner_address', concat('w', o_custkey), 'amount', cast(o_orderkey as string)))))),
      'ret', CASE WHEN o_orderstatus <> 'P' THEN array(named_struct('contractRet', 'SUCCESS')) END)) AS body"""
    parsed = ev.parse_account_history(src.table(spark, sf, "orders").selectExpr(body))
    return parsed.select("tx_id", "block_number", "contract_type", F.col("contract_value")["owner_address"].alias("owner_address"), "execution_result")


@query("parse_delegations", """
SELECT 's' || s_suppkey AS sponsor, 'w' || (s_suppkey % 7) AS receiver, 'energy' AS resource, s_suppkey * 10 AS balance, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS expires FROM supplier WHERE s_suppkey > 0
UNION ALL SELECT 's' || s_suppkey, 'w' || (s_suppkey % 7), 'bandwidth', s_suppkey % 4, NULL FROM supplier WHERE s_suppkey % 4 > 0
UNION ALL SELECT 'f' || s_suppkey, 's' || s_suppkey, NULL, NULL, NULL FROM supplier
UNION ALL SELECT 's' || s_suppkey, 'r' || s_suppkey, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 2 = 0""")
def _(spark, sf):
    s = src.table(spark, sf, "supplier")
    detail = s.selectExpr("""to_json(named_struct('delegatedResource', array(named_struct('from', concat('s', s_suppkey), 'to', concat('w', s_suppkey % 7),
      'frozen_balance_for_energy', s_suppkey * 10, 'frozen_balance_for_bandwidth', s_suppkey % 4,
      'expire_time_for_energy', CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey * 1000 END, 'expire_time_for_bandwidth', 0)))) AS body""")
    index = s.selectExpr("""to_json(named_struct('account', concat('s', s_suppkey), 'fromAccounts', array(concat('f', s_suppkey)),
      'toAccounts', CASE WHEN s_suppkey % 2 = 0 THEN array(concat('r', s_suppkey)) END)) AS body""")
    rows = ev.parse_delegation_detail(detail).unionByName(ev.parse_delegation_index(index))
    return rows.withColumn("expires", F.unix_seconds("lock_expires_at")).drop("lock_expires_at")


_ADDR = "substring(sha256(c_name),1,40)"


@query("canonicalize_addresses", f"""
WITH a AS (SELECT c_custkey, {_ADDR} AS h FROM customer)
SELECT CASE WHEN c_custkey%3=0 THEN 'evm' ELSE 'tron' END AS network_key, c_custkey AS wallet,
 CASE c_custkey%9 WHEN 0 THEN '0x' || h WHEN 3 THEN '0x' || h WHEN 6 THEN NULL WHEN 1 THEN '41' || h WHEN 2 THEN '41' || h WHEN 4 THEN '41' || h WHEN 5 THEN NULL WHEN 7 THEN NULL ELSE NULL END AS canonical,
 CASE c_custkey%9 WHEN 6 THEN 'wrong_shape' WHEN 5 THEN 'bad_checksum' WHEN 7 THEN 'bad_alphabet' WHEN 8 THEN 'wrong_prefix' END AS reason FROM a""")
def _(spark, sf):
    k = F.col("c_custkey") % 9
    h = F.substring(F.sha2("c_name", 256), 1, 40)
    key = F.concat(F.lit("41"), h)
    good = addresses.display_tron(key)
    bad = addresses.hex_to_base58(F.concat(key, F.lit("00000000")))
    raw = (
        F.when(k == 0, F.concat(F.lit("0x"), F.upper(h))).when(k == 3, F.concat(F.lit(" 0x"), h, F.lit(" ")))
        .when(k == 6, h).when(k == 1, F.concat(F.lit("0x41"), F.upper(h))).when(k == 2, key).when(k == 4, good)
        .when(k == 5, bad).when(k == 7, F.concat(F.substring(good, 1, 33), F.lit("0"))).otherwise(F.concat(F.lit("42"), h))
    )
    # The addresses are written once: they cost much to make and are read twice. A small file
    # is one task, so its rows are dealt out first.
    people = src.table(spark, sf, "customer").select("c_custkey", "c_name")
    rows = scale.staged(people.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select(
        F.col("c_custkey").alias("wallet"), F.when(F.col("c_custkey") % 3 == 0, "evm").otherwise("tron").alias("network_key"), raw.alias("address")
    ))
    return rows.join(addresses.canonicalize(rows), ["network_key", "address"]).select("network_key", "wallet", "canonical", "reason")


@query("build_star_schema", sql(LEDGER, body="""
SELECT sha256('n0:' || event_reference) AS event_key, sha256('n0:' || tx_hash) AS transaction_key, sha256('n0:' || from_address) AS from_key,
 sha256('n0:' || to_address) AS to_key, amount = 0 AS is_zero_value, ordering_ambiguous FROM ledger"""))
def _(spark, sf):
    star = bun.star_schema(src.ledger(spark, sf).withColumn("event_index", F.col("line")))
    return star["events"].select(
        "event_key", "transaction_key", "from_key", "to_key", "is_zero_value", "ordering_ambiguous"
    )


@query("scan_recordings", """
WITH k AS (SELECT event_id AS sequence, sha256('{"method":"GET","params":{"a":"' || (user_id % 10) || '","b":"' || event_type || '"},"path":"/v1/' || event_type || '","payload":{}}') AS key FROM events)
SELECT key, sequence, row_number() OVER (PARTITION BY key ORDER BY sequence) AS position FROM k""")
def _(spark, sf):
    rows = src.table(spark, sf, "events").selectExpr(
        "event_id AS sequence", "'get' AS method", "concat('/v1/', event_type) AS path",
        "map('b', event_type, 'a', cast(user_id % 10 as string)) AS params", "cast(null as map<string,string>) AS payload",
    )
    return bun.scan_recordings(rows)


#: A run has the documents of one source out of 200 that follow each other.
_RUN = "concat(source, '-', cast(doc_id div 200 as string))"


def _checked(spark, sf):
    """Documents as files of runs; some changed, some lost."""
    docs = src.table(spark, sf, "documents").selectExpr(f"{_RUN} AS run_id", "cast(doc_id as string) AS file", "doc_id", "sha2(text, 256) AS digest")
    manifest = docs.filter("doc_id % 19 <> 0").selectExpr("run_id", "file", "CASE WHEN doc_id % 23 = 0 THEN 'other' ELSE digest END AS expected")
    files = docs.filter("doc_id % 29 <> 0").selectExpr("run_id", "file", "digest AS actual")
    return bun.verify_manifests(manifest, files)


_CHK = """chk AS (SELECT source || '-' || CAST(doc_id // 200 AS VARCHAR) AS run_id, CAST(doc_id AS VARCHAR) AS file, CASE WHEN doc_id%19=0 THEN CASE WHEN doc_id%29<>0 THEN 'unlisted' END WHEN doc_id%29=0 THEN 'missing' WHEN doc_id%23=0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents),
integ AS (SELECT run_id, count(*) FILTER (WHERE status<>'unlisted') AS checked, count(*) FILTER (WHERE status='ok') AS ok, count(*) FILTER (WHERE status='mismatch') AS failed, count(*) FILTER (WHERE status='missing') AS missing FROM chk WHERE status IS NOT NULL GROUP BY 1)"""


@query("verify_manifests", sql(_CHK, body="SELECT * FROM chk WHERE status IS NOT NULL"))
def _(spark, sf):
    return _checked(spark, sf).select("run_id", "file", "status")


@query("manifest_integrity", sql(_CHK, body="SELECT *, checked>0 AND failed=0 AND missing=0 AS intact FROM integ"))
def _(spark, sf):
    return bun.integrity(_checked(spark, sf))


@query("bundle_inventory", sql(_CHK, body="""
SELECT p.run_id, 'routing' AS kind, concat_ws(',', CASE WHEN bool_or(file='1') THEN '1' END, CASE WHEN bool_or(file='2') THEN '2' END, CASE WHEN bool_or(file='3') THEN '3' END) AS files_present,
 any_value(i.checked>0 AND i.failed=0 AND i.missing=0) AS intact FROM chk p JOIN integ i USING (run_id) WHERE status IN ('unlisted','ok','mismatch') GROUP BY 1"""))
def _(spark, sf):
    checked = _checked(spark, sf)
    kinds = src.table(spark, sf, "documents").selectExpr(f"{_RUN} AS run_id", "'routing' AS kind").distinct()
    return bun.bundle_inventory(checked.filter("actual IS NOT NULL"), checked, kinds, ("1", "2", "3"))


@query("intact_runs", sql(_CHK, body="""
SELECT network_key, count(*) AS intact_runs FROM (SELECT run_id, 'n' || (min(CAST(file AS BIGINT)) % 3) AS network_key FROM chk GROUP BY 1) r JOIN integ i USING (run_id) WHERE i.failed + i.missing = 0 AND i.checked > 0 GROUP BY 1"""))
def _(spark, sf):
    runs = src.table(spark, sf, "documents").groupBy(F.expr(_RUN).alias("run_id")).agg(F.min("doc_id").alias("d")).selectExpr(
        "run_id", "concat('n', d % 3) AS network_key", "'succeeded' AS status", "'live' AS mode"
    )
    return bun.intact_runs(runs, _checked(spark, sf))


@query("latest_run", """
SELECT 'w' || o_custkey AS candidate_address, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id, CAST(epoch(max(o_orderdate)) AS BIGINT) AS finished_at FROM orders GROUP BY 1""")
def _(spark, sf):
    runs = src.table(spark, sf, "orders").selectExpr(
        "concat('w', o_custkey) AS candidate_address", "o_orderkey AS run_id", f"{src.epoch_seconds('o_orderdate')} AS finished_at"
    )
    return bun.latest_run(runs)


@query("validate_bundles", """
SELECT 'b' || c_custkey AS bundle, concat_ws(',', CASE WHEN c_custkey%4=0 THEN 'manifest.json' END, CASE WHEN c_custkey%5=0 THEN 'evidence.json' END) AS missing,
 CASE WHEN c_custkey%4=0 THEN '' ELSE concat_ws(',', CASE WHEN c_custkey%7=0 THEN 'run_id_missing' END, CASE WHEN c_mktsegment='BUILDING' THEN 'subject_kind_missing' END,
  CASE WHEN c_custkey%6=0 THEN 'window_selection_missing' END, CASE WHEN c_mktsegment='MACHINERY' AND c_custkey%3=0 THEN 'registry_snapshot_missing' END,
  CASE WHEN c_acctbal<0 THEN 'run_status_not_final' END) END AS errors,
 c_custkey%4<>0 AND c_custkey%5<>0 AND c_custkey%7<>0 AND c_mktsegment<>'BUILDING' AND c_custkey%6<>0 AND NOT (c_mktsegment='MACHINERY' AND c_custkey%3=0) AND c_acctbal>=0 AS ok FROM customer""")
def _(spark, sf):
    rows = src.table(spark, sf, "customer").selectExpr(
        "concat('b', c_custkey) AS bundle",
        "filter(array(CASE WHEN c_custkey % 4 <> 0 THEN 'manifest.json' END, CASE WHEN c_custkey % 5 <> 0 THEN 'evidence.json' END, 'raw'), x -> x IS NOT NULL) AS files",
        "CASE WHEN c_custkey % 7 <> 0 THEN 'r' END AS manifest_run_id",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN '' WHEN c_mktsegment = 'MACHINERY' THEN 'evaluation_wallet' ELSE 'candidate' END AS subject_kind",
        "'n0' AS network", "'w' AS address", "CASE WHEN c_custkey % 6 <> 0 THEN 's' END AS window_start", "'c' AS window_cutoff",
        "CASE WHEN c_custkey % 3 <> 0 THEN 'snap' END AS registry_snapshot",
        "CASE WHEN c_acctbal < 0 THEN 'running' ELSE 'complete' END AS run_status", "'truncated' AS completeness",
    )
    return bun.validate_bundles(rows)


@query("export_rows_safe", """
WITH p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '-' WHEN 3 THEN '' ELSE '@' END || p_name AS label, p_brand FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS part, CASE WHEN regexp_matches(label, '^\\s*[=+@-]') THEN '''' || label ELSE label END AS label, p_brand AS brand FROM p""")
def _(spark, sf):
    rows = src.table(spark, sf, "part").selectExpr(
        "p_partkey AS part", "concat(CASE p_size % 5 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '-' WHEN 3 THEN '' ELSE '@' END, p_name) AS label", "p_brand AS brand"
    )
    return bun.export_rows_safe(rows)


@query("append_new_evidence", sql(OBS, body="""
SELECT direction, tx_hash, min(event_reference) AS event_reference FROM obs WHERE (direction, tx_hash) NOT IN (SELECT direction, tx_hash FROM obs WHERE event_type='view') GROUP BY 1,2"""))
def _(spark, sf):
    rows = src.observations(spark, sf).select("direction", "tx_hash", "event_reference", "event_type")
    stored = rows.filter("event_type = 'view'")
    return bun.append_new(stored, rows.drop("event_type"), ["direction", "tx_hash"])


@query("amount_display", sql(LEDGER, body="""
SELECT event_reference, CAST(amount // CAST(pow(10, line*2) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(amount % CAST(pow(10, line*2) AS BIGINT) AS VARCHAR), CAST(line*2 AS INTEGER), '0') AS shown,
 CAST(amount AS VARCHAR) AS parsed FROM ledger"""))
def _(spark, sf):
    e = src.ledger(spark, sf).withColumn("decimals", (F.col("line") * 2).cast("int"))
    shown = amounts.to_display(F.col("amount_base_units"), F.col("decimals"))
    return e.withColumn("shown", shown).select("event_reference", "shown", amounts.from_display(F.col("shown"), F.col("decimals")).alias("parsed"))


@query("verify_token_metadata", """
SELECT 'n' || (p_partkey % 3) AS network_key, 'a' || p_partkey AS token_contract, CAST(p_size % 19 AS BIGINT) AS decimals,
 CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(CASE WHEN p_partkey % 10 = 1 THEN p_size % 17 ELSE p_size % 19 END AS BIGINT) END AS observed_decimals,
 CASE WHEN p_partkey % 8 = 0 OR p_partkey % 9 = 0 THEN 'no_contract_code' WHEN p_partkey % 10 = 1 AND p_size % 17 <> p_size % 19 THEN 'decimals_differ' END AS problem FROM part""")
def _(spark, sf):
    p = src.table(spark, sf, "part")
    base = ["concat('n', p_partkey % 3) AS network_key", "concat('a', p_partkey) AS token_contract"]
    assets = p.selectExpr(*base, "cast(p_size % 19 as bigint) AS decimals")
    seen = p.filter("p_partkey % 8 <> 0").selectExpr(
        *base, "CASE WHEN p_partkey % 9 = 0 THEN '0x' ELSE '0x6001' END AS code",
        "cast(CASE WHEN p_partkey % 10 = 1 THEN p_size % 17 ELSE p_size % 19 END as bigint) AS decimals",
    )
    return evm.verify_token_metadata(assets, seen)


