"""Cross-chain burns and mints, built as raw logs from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivermark.operators import bridge as br
from rivermark.plans.base import sql
from rivermark.registry import query
from rivermark.scale import staged
from rivermark.sources import tables as src
from rivermark.sources.chainlogs import TRANSFER_TOPIC, ZERO_TOPIC

W = lambda e: f"lpad(lower(hex(cast({e} as bigint))), 64, '0')"
U4 = lambda e: f"lpad(lower(hex(cast({e} as bigint))), 8, '0')"
MT, TM = br.CONTRACTS["MessageTransmitterV2"], br.CONTRACTS["TokenMessengerV2"]


def _body(amount, fee, expiry):
    token = f"concat(repeat('0', 24), '{br.USDC['ethereum'][2:]}')"
    return f"{U4('1')}, {token}, {W('o_custkey')}, {W(amount)}, {W('o_orderkey')}, {W('100')}, {W(fee)}, {W(expiry)}"


def _message(nonce, amount, executed, fee, expiry):
    mess = f"concat(repeat('0', 24), '{TM[2:]}')"
    return f"concat({U4('1')}, {U4('0')}, {U4('6')}, {W(nonce)}, {mess}, {mess}, repeat('0', 64), {U4('1000')}, {U4(executed)}, {_body(amount, fee, expiry)})"


def messages(spark, sf):
    """One or two messages per order; ``k`` numbers them."""
    o = src.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    i = F.explode(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN array(0) ELSE array(0, 1) END")).alias("i")
    rows = o.select("*", i).withColumn("k", F.expr("o_orderkey * 2 + i")).withColumn("amt", F.expr("k * 1000 + 7")).withColumn("fee", F.expr("k % 7"))
    return rows.withColumn("sent", F.expr(_message("0", "amt", "0", "0", "0"))).withColumn(
        "sealed", F.expr(_message("k + 1", "CASE WHEN k % 37 = 0 THEN amt + 1 ELSE amt END", "2000", "fee", "9"))
    )


def source_receipts(spark, sf):
    log = "named_struct('address', {a}, 'topics', array({t}), 'data', {d}, 'logIndex', concat('0x', lower(hex({n}))))"
    sent = log.format(a=f"'{MT}'", t=f"'{br.MESSAGE_SENT}'", d=f"concat('0x', {W('32')}, {W('376')}, sent, repeat('0', 16))", n="i * 2")
    z = "concat('0x', {})"
    burn = log.format(
        a=f"'{TM}'", t=f"'{br.DEPOSIT_FOR_BURN}', concat('0x', repeat('0', 24), '{br.USDC['ethereum'][2:]}'), {z.format(W('o_orderkey'))}, {z.format(W('1000'))}",
        d=f"concat('0x', {W('amt')}, {W('o_custkey')}, {W('6')}, repeat('0', 64), repeat('0', 64), {W('100')})", n="i * 2 + 1",
    )
    per = messages(spark, sf).selectExpr("o_orderkey", "o_orderstatus", "i", f"{sent} AS s", f"{burn} AS b")
    # A transaction holds at most two messages here, so its log list is tiny.
    return per.groupBy("o_orderkey", "o_orderstatus").agg(F.sort_array(F.collect_list(F.struct("i", F.array("s", "b").alias("l")))).alias("g")).selectExpr(
        "concat('h', o_orderkey) AS tx_hash", "CASE WHEN o_orderstatus = 'P' THEN '0x0' ELSE '0x1' END AS status", "o_orderkey AS block_number", "flatten(transform(g, x -> x.l)) AS logs"
    )


def destination_receipts(spark, sf):
    log = "named_struct('address', '{a}', 'topics', array({t}), 'data', {d}, 'logIndex', '0x{n}')"
    got = log.format(a=MT, t=f"'{br.MESSAGE_RECEIVED}', concat('0x', repeat('0', 64)), concat('0x', {W('k + 1')}), concat('0x', {W('2000')})",
                     d=f"concat('0x', {W('0')}, {W('1')}, {W('96')}, {W('228')}, substring(sealed, 297, 456))", n="1")
    minted = W("amt - fee + CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END")
    mint = log.format(a=TM, t=f"'{br.MINT_TOPICS[0]}', concat('0x', {W('o_custkey')})", d=f"concat('0x', {minted})", n="2")
    paid = log.format(a=br.USDC["base"], t=f"'{TRANSFER_TOPIC}', '{ZERO_TOPIC}', concat('0x', {W('o_custkey')})", d=f"concat('0x', {minted})", n="3")
    copies = "explode(CASE WHEN k % 19 = 0 THEN array() WHEN k % 31 = 0 THEN array('d', 'x') ELSE array('d') END) AS c"
    return messages(spark, sf).selectExpr("*", copies).selectExpr(
        "concat(c, k) AS tx_hash", "CASE WHEN k % 23 = 0 THEN '0x0' ELSE '0x1' END AS status", "o_orderkey + 3 AS block_number", f"array({got}, {mint}, {paid}) AS logs"
    )


def attestations(spark, sf):
    copies = "explode(CASE WHEN k % 11 = 0 THEN array() WHEN k % 13 = 0 THEN array(1, 2) ELSE array(1) END) AS c"
    return messages(spark, sf).selectExpr("*", copies).selectExpr(
        "concat('h', o_orderkey) AS tx_hash", "6L AS destination_domain", f"'{br.USDC['ethereum']}' AS burn_token", f"concat('0x', substring({W('o_custkey')}, 25, 40)) AS mint_recipient",
        "cast(CASE WHEN k % 17 = 0 THEN amt + 1 ELSE amt END as string) AS amount", "CASE WHEN k % 5 = 0 THEN 'pending_confirmations' ELSE 'complete' END AS status",
        "CASE WHEN k % 5 = 0 THEN 'PENDING' ELSE '0xab' END AS attestation", f"{W('k + 1')} AS event_nonce", "sealed AS attested",
    )


def linked(spark, sf):
    found = br.match_attestations(br.burns(source_receipts(spark, sf)), attestations(spark, sf))
    return br.links(br.discover_destination(found, br.receives(destination_receipts(spark, sf))))


def checked(spark, sf):
    blocks = src.table(spark, sf, "orders").selectExpr("o_orderkey AS block_number", "CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE o_orderkey END AS block_time")
    top = src.table(spark, sf, "orders").agg((F.max("o_orderkey") * 9).cast("long")).scalar()
    return br.strict_check(linked(spark, sf), blocks, F.call_function("div", top, F.lit(10)))


H40 = "'0x' || lpad(printf('%x', {}), 40, '0')"
_MSG = f"""msg AS (SELECT *, k*1000+7 AS amt, k%7 AS fee, 'h' || o_orderkey AS tx, {H40.format('o_custkey')} AS rcp, {H40.format('o_orderkey')} AS dep FROM (
 SELECT o_orderkey, o_custkey, o_orderstatus, i, o_orderkey*2+i AS k FROM orders JOIN (VALUES (0),(1)) v(i) ON i=0 OR o_orderkey%2=1)),
brn AS (SELECT *, 'eip155:1:' || tx || ':' || (i*2+1) AS burn_reference, 'eip155:1:' || tx || ':' || (i*2) AS message_reference FROM msg WHERE o_orderstatus<>'P'),
att AS (SELECT b.*, CASE WHEN k%11=0 THEN CASE WHEN o_orderkey%2=1 AND (CASE i WHEN 0 THEN k+1 ELSE k-1 END)%11<>0 THEN 'NOT_MATCHED' ELSE 'NOT_FOUND' END WHEN k%17=0 THEN 'NOT_MATCHED' WHEN k%13=0 THEN 'AMBIGUOUS' WHEN k%5=0 THEN 'PENDING' ELSE 'API_REPORTED_COMPLETE' END AS ast FROM brn b),
dsc AS (SELECT *, one AND k%19<>0 AND k%31<>0 AS found FROM (SELECT *, ast IN ('PENDING','API_REPORTED_COMPLETE') AS one FROM att)),
lnk AS (SELECT *, CASE WHEN NOT found THEN 'UNKNOWN' WHEN k%29=0 THEN 'MISMATCH' ELSE 'MATCHES_PROTOCOL_EXPECTATION' END AS reconciliation, CASE WHEN NOT one OR k%19=0 THEN 'NOT_FOUND' WHEN k%31=0 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS discovery FROM dsc),
ls AS (SELECT *, CASE WHEN ast='AMBIGUOUS' THEN 'AMBIGUOUS' WHEN found AND k%23=0 THEN 'FAILED' WHEN reconciliation='MISMATCH' THEN 'FAILED' WHEN found AND ast='API_REPORTED_COMPLETE' THEN 'COMPLETE' WHEN found THEN 'DESTINATION_RECEIVED' WHEN one THEN 'INCOMPLETE' ELSE 'MESSAGE_IDENTIFIED' END AS linkage_status FROM lnk),
top AS (SELECT CAST(max(o_orderkey)*9//10 AS BIGINT) AS f FROM orders),
chk AS (SELECT *, o_orderkey+3 <= (SELECT max(o_orderkey) FROM orders) AS dblock, CASE WHEN o_orderkey%2=1 THEN 'more_than_one_message' WHEN o_orderkey > f THEN 'source_not_final' WHEN ast<>'API_REPORTED_COMPLETE' THEN 'attestation_incomplete' WHEN k%37=0 THEN 'immutable_bytes_differ'
 WHEN NOT found THEN 'destination_not_unique' WHEN k%23=0 THEN 'destination_not_successful' WHEN o_orderkey+3 > f THEN 'destination_not_final'
 WHEN (CASE WHEN (o_orderkey+3)%41=0 THEN 0 ELSE o_orderkey+3 END) < (CASE WHEN o_orderkey%41=0 THEN 0 ELSE o_orderkey END) THEN 'destination_before_source' WHEN reconciliation<>'MATCHES_PROTOCOL_EXPECTATION' THEN 'amount_differs' END AS failure FROM ls, top)"""


@query("cctp_burns", sql(_MSG, body="SELECT tx AS tx_hash, burn_reference, message_reference, dep AS depositor, rcp AS mint_recipient, CAST(amt AS VARCHAR) AS amount, '100' AS max_fee, CAST(6 AS BIGINT) AS destination_domain FROM brn"))
def _(spark, sf):
    return br.burns(source_receipts(spark, sf)).select("tx_hash", "burn_reference", "message_reference", "depositor", "mint_recipient", "amount", "max_fee", "destination_domain")


@query("cctp_receives", sql(_MSG, body="""
SELECT c || k AS tx_hash, CASE WHEN k%23=0 THEN 'reverted' ELSE 'success' END AS execution_status, lpad(printf('%x', k+1),64,'0') AS nonce, rcp AS mint_recipient, CAST(amt-fee+CASE WHEN k%29=0 THEN 1 ELSE 0 END AS VARCHAR) AS mint_amount, 'eip155:8453:' || c || k || ':2' AS mint_reference
FROM msg JOIN (VALUES ('d'),('x')) v(c) ON c='d' OR k%31=0 WHERE k%19<>0"""))
def _(spark, sf):
    return br.receives(destination_receipts(spark, sf)).select("tx_hash", "execution_status", "nonce", "mint_recipient", "mint_amount", "mint_reference")


@query("match_attestations", sql(_MSG, body="SELECT burn_reference, ast AS attestation_status, CASE WHEN ast IN ('PENDING','API_REPORTED_COMPLETE') THEN lpad(printf('%x', k+1),64,'0') END AS nonce FROM att"))
def _(spark, sf):
    return br.match_attestations(br.burns(source_receipts(spark, sf)), attestations(spark, sf)).select("burn_reference", "attestation_status", "nonce")


@query("discover_destination", sql(_MSG, body="SELECT burn_reference, discovery, CASE WHEN found THEN 'd' || k END AS destination_tx FROM lnk"))
def _(spark, sf):
    return linked(spark, sf).select("burn_reference", "discovery", F.col("d.tx_hash").alias("destination_tx"))


@query("cctp_reconcile", sql(_MSG, body="SELECT burn_reference, reconciliation FROM lnk"))
def _(spark, sf):
    return linked(spark, sf).select("burn_reference", "reconciliation")


@query("cctp_links", sql(_MSG, body="SELECT burn_reference, linkage_status FROM ls"))
def _(spark, sf):
    return linked(spark, sf).select("burn_reference", "linkage_status")


@query("cctp_strict_check", sql(_MSG, body="SELECT burn_reference, failure, failure IS NULL AS matched FROM chk"))
def _(spark, sf):
    return checked(spark, sf).select("burn_reference", "failure", "matched")


@query("cctp_transfers", sql(_MSG, body=f"""
SELECT burn_reference, 'cctp_burn' AS event_type, tx AS tx, dep AS from_address, '{TM}' AS to_address, CAST(amt AS VARCHAR) AS amount_base_units FROM ls WHERE linkage_status='COMPLETE'
UNION ALL SELECT burn_reference, 'cctp_mint', 'd' || k, '0x' || repeat('0',40), rcp, CAST(amt-fee AS VARCHAR) FROM ls WHERE linkage_status='COMPLETE'"""))
def _(spark, sf):
    return br.link_transfers(linked(spark, sf).filter("linkage_status = 'COMPLETE'")).drop("network")


@query("continuation_tasks", sql(_MSG, body="SELECT burn_reference, rcp AS address, 'address_discovery' AS mode, CASE WHEN (o_orderkey+3)%41=0 THEN 0 ELSE o_orderkey+3 END AS analysis_start FROM chk WHERE failure IS NULL AND i=0 AND k%3<>0"))
def _(spark, sf):
    # Written once: the existing tasks are some of the same links.
    proven = staged(checked(spark, sf).select("burn_reference", "mint_recipient", "d_time", "matched"))
    done = proven.filter("substring_index(substring_index(burn_reference, ':', -2), ':', 1) like 'h%'").filter(
        "cast(substring(split(burn_reference, ':')[2], 2) as bigint) * 2 % 3 = 0"
    )
    return br.continuation_tasks(proven, done).select("burn_reference", "address", "mode", "analysis_start")
