"""Watches, polls, alerts and casework overviews."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rivermark import scale
from rivermark.operators import casework as cw
from rivermark.operators import monitor as mon
from rivermark.plans.base import LEDGER, sql
from rivermark.plans.traces import ENDINGS, saved
from rivermark.registry import query
from rivermark.sources import tables as src
from rivermark.streaming import watch as stream

DAY = 86400


def watches(spark, sf):
    return src.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").selectExpr(
        "concat('v', c_custkey) AS watch_id", "concat('w', c_custkey) AS watch_address", "'n0' AS watch_network", "concat('a', c_custkey % 3) AS watch_contract",
        f"timestamp_seconds({src.EPOCH} + (c_custkey * 7) % 100000) AS baseline", "c_custkey % 4 * 300 AS overlap_seconds", "concat('c', c_custkey % 50) AS case_id", "c_custkey",
    )


def observations(spark, sf, lines=None):
    """Three polls over the ledger with statuses that change in between."""
    polls = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    e = src.ledger(spark, sf, lines).withColumn("token_contract", F.expr("concat('a', part_key % 3)")).select("*", polls)
    proved = "execution_status = 'success' OR (k > 0 AND order_key % 2 = 0)"
    return e.selectExpr(
        "network_key", "token_contract", "event_reference", "tx_hash", "event_kind", "from_address", "to_address", "amount_base_units", "block_time", "k",
        f"CASE WHEN k = 2 AND order_key % 10 = 0 THEN 'failed' WHEN {proved} THEN 'success' ELSE 'unknown' END AS execution_status",
        "CASE WHEN k = 2 AND order_key % 9 = 0 THEN 'removed' WHEN confirmation_state = 'removed' THEN CASE WHEN k = 2 THEN 'confirmed' ELSE 'provisional' END"
        " WHEN k = 0 AND supplier_key % 2 = 0 THEN 'unknown' ELSE 'confirmed' END AS confirmation_state",
        f"timestamp_seconds({src.EPOCH} + {DAY} * 6 + k * {DAY}) AS poll_time",
    )


_SEEN = f"""wt AS (SELECT 'v' || c_custkey AS watch_id, 'w' || c_custkey AS watch_address, 'a' || (c_custkey%3) AS watch_contract, {src.EPOCH} + (c_custkey*7)%100000 AS baseline, c_custkey%4*300 AS overlap_seconds, 'c' || (c_custkey%50) AS case_id, c_custkey FROM customer WHERE c_mktsegment='BUILDING'),
ob AS (SELECT 'a' || (part_key%3) AS token_contract, event_reference, event_kind, from_address, to_address, amount, t, k,
 CASE WHEN k=2 AND order_key%10=0 THEN 'failed' WHEN execution_status='success' OR (k>0 AND order_key%2=0) THEN 'success' ELSE 'unknown' END AS es,
 CASE WHEN k=2 AND order_key%9=0 THEN 'removed' WHEN confirmation_state='removed' THEN CASE WHEN k=2 THEN 'confirmed' ELSE 'provisional' END WHEN k=0 AND supplier_key%2=0 THEN 'unknown' ELSE 'confirmed' END AS cs,
 CAST({src.EPOCH} + {DAY}*6 + k*{DAY} AS BIGINT) AS poll FROM ledger, (VALUES (0),(1),(2)) v(k)),
seen AS (SELECT watch_id, watch_address, case_id, c_custkey, ob.*, CASE WHEN token_contract<>watch_contract THEN 'unsupported_asset_contract' WHEN event_kind='approval' THEN 'approval' WHEN es='failed' THEN 'failed_execution' WHEN cs='removed' THEN 'removed' WHEN t<baseline THEN 'before_watch_scope' END AS reason
 FROM ob JOIN wt ON wt.watch_address = ob.from_address OR wt.watch_address = ob.to_address)"""
SEEN = (LEDGER, _SEEN)


def _seen(spark, sf):
    return mon.watched(observations(spark, sf), watches(spark, sf))


@query("watch_exclusions", sql(*SEEN, body="SELECT watch_id, reason, count(*) AS n FROM seen WHERE reason IS NOT NULL GROUP BY 1,2"))
def _(spark, sf):
    return mon.watch_exclusions(_seen(spark, sf))


_ALERT = """op AS (SELECT watch_id, event_reference, min(poll) AS f, arg_min(es, poll) AS es0, arg_min(cs, poll) AS cs0 FROM seen WHERE reason IS NULL GROUP BY 1,2),
al AS (SELECT s.watch_id, s.event_reference, any_value(f) AS first_observed, any_value(es0) AS es0, any_value(cs0) AS cs0, any_value(t) AS t, any_value(case_id) AS case_id, any_value(s.c_custkey) AS ck,
 any_value(CASE WHEN from_address=to_address THEN 'self' WHEN from_address=watch_address THEN 'outgoing' ELSE 'incoming' END) AS direction, any_value(watch_address) AS watch_address,
 min(poll) FILTER (WHERE poll>f AND reason IN ('failed_execution','removed')) AS rp, arg_min(es, poll) FILTER (WHERE poll>f AND reason IN ('failed_execution','removed')) AS res_, arg_min(cs, poll) FILTER (WHERE poll>f AND reason IN ('failed_execution','removed')) AS rcs,
 arg_max(cs, poll) FILTER (WHERE reason IS NULL AND cs<>'unknown') AS lc, bool_or(reason IS NULL AND es='success') AS proved, count(*) FILTER (WHERE reason IS NULL OR (poll>f AND reason IN ('failed_execution','removed'))) AS observations
 FROM seen s JOIN op USING (watch_id, event_reference) GROUP BY 1,2),
alerts AS (SELECT watch_id, event_reference, first_observed, CASE WHEN rp IS NULL THEN 'active' ELSE 'retracted' END AS state, CASE WHEN res_='failed' THEN 'failed' WHEN es0='unknown' AND proved THEN 'success' ELSE es0 END AS execution_status,
 CASE WHEN rcs='removed' THEN 'removed' ELSE coalesce(lc, cs0) END AS confirmation_state, observations, t, direction, case_id, watch_address, ck FROM al)"""


@query("watch_alerts", sql(*SEEN, _ALERT, body="""
SELECT watch_id, event_reference, first_observed, state, execution_status, confirmation_state, observations, direction, 'new_transfer:' || event_reference AS dedupe_key FROM alerts"""))
def _(spark, sf):
    return mon.watch_alerts(_seen(spark, sf)).select(
        "watch_id", "event_reference", F.unix_seconds("first_observed_at").alias("first_observed"), "state", "execution_status", "confirmation_state", "observations", "direction", "dedupe_key"
    )


_HISTORY = """h0 AS (SELECT s.watch_id, s.event_reference, poll, f, reason IS NOT NULL AS back, cs, es, max(CASE WHEN reason IS NOT NULL THEN 1 END) OVER w AS gone
 FROM seen s JOIN op USING (watch_id, event_reference) WHERE poll>=f AND (reason IS NULL OR reason IN ('failed_execution','removed')) WINDOW w AS (PARTITION BY s.watch_id, s.event_reference ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, coalesce(last_value(CASE WHEN (NOT back AND cs<>'unknown') OR (back AND gone IS NULL AND cs='removed') THEN cs END IGNORE NULLS) OVER w, 'unknown') AS pc,
  coalesce(last_value(CASE WHEN (NOT back AND es='success') OR (back AND gone IS NULL AND es='failed') THEN es END IGNORE NULLS) OVER w, 'unknown') AS pe
 FROM h0 WINDOW w AS (PARTITION BY watch_id, event_reference ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hist AS (SELECT watch_id, event_reference, poll AS poll_at, CASE WHEN poll=f THEN 'opened' WHEN back AND gone IS NULL THEN 'retracted' WHEN NOT back AND ((cs<>'unknown' AND cs<>pc) OR (pe='unknown' AND es='success')) THEN 'status_changed' END AS change FROM h)"""
_STATES = sql(*SEEN, _ALERT, _HISTORY, body="SELECT * FROM hist WHERE change IS NOT NULL")


@query("alert_states", _STATES)
def _(spark, sf):
    return mon.alert_states(_seen(spark, sf)).select("watch_id", "event_reference", F.unix_seconds("poll_time").alias("poll_at"), "change")


def _polled(spark, sf, order):
    """The polls as a stream of files in the given order, two micro-batches for each poll."""
    seen = observations(spark, sf)
    folder = f"{scale.shared_folder(spark)}/polls-{uuid.uuid4().hex}"
    files = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in order:
        seen.filter(F.col("k") == k).repartition(files).write.mode("append").parquet(folder)
    polls = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", (files + 1) // 2).parquet(folder)
    return stream.run_once(polls, watches(spark, sf))


@query("watch_stream", _STATES)
def _(spark, sf):
    """The same history from the streaming job, poll by poll over several micro-batches."""
    path = _polled(spark, sf, (0, 1, 2))
    return stream.changes(spark, path).select("watch_id", "event_reference", F.unix_seconds("poll_time").alias("poll_at"), "change")


@query("late_observations", sql(*SEEN, body="SELECT watch_id, count(*) AS late FROM seen WHERE k = 1 GROUP BY 1"))
def _(spark, sf):
    """The second poll arrives after the third: its rows are counted by the stream and not applied."""
    return stream.late(spark, _polled(spark, sf, (0, 2, 1)))


@query("alert_lag", sql(*SEEN, _ALERT, body="""
SELECT watch_id, event_reference, CASE WHEN ck%4=0 THEN 'unavailable_recorded_replay' WHEN ck%4=1 THEN 'simulated_clock' WHEN ck%4=2 THEN 'synthetic_fixture_times' ELSE 'live_wall_clock' END AS basis, CASE WHEN ck%4<>0 THEN first_observed - t END AS lag_seconds FROM alerts"""))
def _(spark, sf):
    k = F.regexp_extract("watch_id", "v([0-9]+)", 1).cast("bigint") % 4
    alerts = mon.watch_alerts(_seen(spark, sf)).withColumn(
        "data_mode", F.when(k == 0, "RECORDED_PUBLIC").when(k < 3, "SYNTHETIC").otherwise("LIVE")
    ).withColumn("simulated", k == 1)
    return mon.alert_lag(alerts).select("watch_id", "event_reference", "basis", "lag_seconds")


@query("alert_outbox", sql(*SEEN, _ALERT, body="""
SELECT watch_id, event_reference, CASE WHEN ck%6<>0 THEN b END AS body, CASE WHEN ck%6<>0 THEN sha256(b) END AS sha256, CASE WHEN ck%6=0 THEN 'context_missing' END AS refusal FROM (SELECT *,
 '{"case":{"id":"' || case_id || '"},"watch":{"id":"' || watch_id || '","address":"' || watch_address || '"},"alert":{"event_reference":"' || event_reference || '","state":"' || state || '"}}' AS b FROM alerts)"""))
def _(spark, sf):
    context = watches(spark, sf).withColumn("case_id", F.when(F.col("c_custkey") % 6 != 0, F.col("case_id"))).select("watch_id", "case_id", "watch_network", "watch_address", "watch_contract")
    return mon.alert_outbox(mon.watch_alerts(_seen(spark, sf)), context)


def _polls(spark, sf):
    """Orders as poll runs of the customer's watch."""
    return src.table(spark, sf, "orders").selectExpr(
        "concat('v', o_custkey) AS watch_id", "o_orderkey AS run_id", f"timestamp_seconds({src.epoch_seconds('o_orderdate')}) AS started_at",
        f"timestamp_seconds({src.epoch_seconds('o_orderdate')} + 60) AS completed_at", f"timestamp_seconds({src.epoch_seconds('o_orderdate')}) AS window_end",
        f"timestamp_seconds({src.epoch_seconds('o_orderdate')} - o_orderkey) AS checkpoint_before",
        "CASE WHEN o_orderstatus = 'P' THEN 'timeout' END AS error", "o_orderkey % 3 AS pages", "o_orderkey % 5 = 0 AS truncated",
    )


_POLL = """pl AS (SELECT 'v' || o_custkey AS watch_id, o_orderkey AS run_id, CAST(epoch(o_orderdate) AS BIGINT) AS t, CASE WHEN o_orderstatus='P' THEN CASE WHEN o_orderkey%3=0 THEN 'provider_failure' ELSE 'partial' END WHEN o_orderkey%5=0 THEN 'truncated' ELSE 'succeeded' END AS status FROM orders)"""


@query("poll_classification", sql(_POLL, body="""
SELECT run_id, status, CASE status WHEN 'succeeded' THEN 'complete_within_scope' WHEN 'provider_failure' THEN 'failed' ELSE 'partial' END AS coverage_status, CASE WHEN status='succeeded' THEN t ELSE t-run_id END AS checkpoint_after FROM pl"""))
def _(spark, sf):
    return mon.classify_polls(_polls(spark, sf)).select("run_id", "status", "coverage_status", F.unix_seconds("checkpoint_after").alias("checkpoint_after"))


@query("watch_status", sql(_POLL, body="""
SELECT watch_id, arg_max(status,(t,run_id)) AS last_status, arg_max(run_id,(t,run_id)) AS last_run, max(t+60) FILTER (WHERE status='succeeded') AS last_success, count(*) AS polls FROM pl GROUP BY 1"""))
def _(spark, sf):
    return mon.watch_status(mon.classify_polls(_polls(spark, sf))).withColumn("last_success", F.unix_seconds("last_success"))


@query("poll_windows", sql(LEDGER, _SEEN, _POLL, body=f"""
SELECT watch_id, greatest(baseline, max(t) FILTER (WHERE status='succeeded') - overlap_seconds) AS window_start, max(t) FILTER (WHERE status='succeeded') AS checkpoint FROM wt LEFT JOIN pl USING (watch_id) GROUP BY watch_id, baseline, overlap_seconds"""))
def _(spark, sf):
    found = mon.poll_windows(watches(spark, sf), mon.classify_polls(_polls(spark, sf)), F.timestamp_seconds(F.lit(src.CUTOFF)))
    return found.select("watch_id", F.unix_seconds("window_start").alias("window_start"), F.unix_seconds("checkpoint").alias("checkpoint"))


@query("canonical_inclusion", """
SELECT 'h' || l_orderkey AS tx_hash, arg_max('b' || l_partkey, (l_suppkey*1000+l_linenumber, 'b' || l_partkey)) FILTER (WHERE l_returnflag<>'R') AS canonical_block, count(*) AS inclusions, count(*) FILTER (WHERE l_returnflag='R') AS orphaned FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return mon.canonical_inclusion(src.table(spark, sf, "lineitem").selectExpr(
        "concat('h', l_orderkey) AS tx_hash", "concat('b', l_partkey) AS block_hash", "l_suppkey * 1000 + l_linenumber AS observed_at", "l_returnflag <> 'R' AS is_canonical"
    ))


@query("job_overview", """
SELECT status, jobs, samples, mean_ms, max_ms, (SELECT count(*) FROM events WHERE event_type<>'view') AS open_signals, (SELECT count(*) FROM lineitem) AS indexed_events FROM (
 SELECT CASE o_orderstatus WHEN 'O' THEN 'succeeded' WHEN 'F' THEN 'partial' ELSE 'failed' END AS status, count(*) AS jobs, count(*) FILTER (WHERE o_orderstatus<>'P') AS samples,
 round(avg(o_orderkey % 5000) FILTER (WHERE o_orderstatus<>'P'),2) AS mean_ms, max(o_orderkey % 5000) FILTER (WHERE o_orderstatus<>'P') AS max_ms FROM orders GROUP BY 1)""")
def _(spark, sf):
    jobs = src.table(spark, sf, "orders").selectExpr("CASE o_orderstatus WHEN 'O' THEN 'succeeded' WHEN 'F' THEN 'partial' ELSE 'failed' END AS status", "o_orderkey % 5000 AS duration_ms")
    signals = src.table(spark, sf, "events").selectExpr("event_id AS signal_id", "CASE WHEN event_type = 'view' THEN ts END AS acknowledged_at")
    return cw.job_overview(jobs, signals, src.table(spark, sf, "lineitem"))


@query("run_comparison", """
SELECT user_id AS scenario, CAST(avg(CASE WHEN value>50 THEN 1.0 ELSE 0.0 END) FILTER (WHERE event_type='click') AS DOUBLE) AS click_top1, CAST(avg(CASE WHEN value>20 THEN 1.0 ELSE 0.0 END) FILTER (WHERE event_type='click') AS DOUBLE) AS click_top3, nullif(count(*) FILTER (WHERE event_type='click'),0) AS click_n,
 CAST(avg(CASE WHEN value>50 THEN 1.0 ELSE 0.0 END) FILTER (WHERE event_type='view') AS DOUBLE) AS view_top1, CAST(avg(CASE WHEN value>20 THEN 1.0 ELSE 0.0 END) FILTER (WHERE event_type='view') AS DOUBLE) AS view_top3, nullif(count(*) FILTER (WHERE event_type='view'),0) AS view_n FROM events GROUP BY 1""")
def _(spark, sf):
    rows = src.table(spark, sf, "events").selectExpr("user_id AS scenario", "event_type AS stage", "cast(value > 50 as int) AS agrees", "cast(value > 20 as int) AS in_top3")
    return cw.run_comparison(rows, ["click", "view"])


@query("latency_percentiles", """
WITH v AS (SELECT user_id % 40 AS route, CAST(floor(value*100) AS BIGINT) AS ms FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY ms) AS rn, count(*) OVER (PARTITION BY route) AS n FROM v)
SELECT route, n AS samples, (max(ms) FILTER (WHERE rn=(n+1)//2) + max(ms) FILTER (WHERE rn=(n+2)//2))/2.0::DOUBLE AS median,
 CASE WHEN n<20 THEN max(ms)::DOUBLE ELSE (max(ms) FILTER (WHERE rn=least(n-1, 19*(n+1)//20)) * (20 - (19*(n+1) - 20*least(n-1, 19*(n+1)//20))) + max(ms) FILTER (WHERE rn=least(n-1, 19*(n+1)//20)+1) * (19*(n+1) - 20*least(n-1, 19*(n+1)//20)))/20.0::DOUBLE END AS p95 FROM r GROUP BY route, n""")
def _(spark, sf):
    rows = src.table(spark, sf, "events").selectExpr("user_id % 40 AS route", "cast(floor(value * 100) as bigint) AS ms")
    return cw.latency_percentiles(rows, ["route"], "ms", 1000)


@query("case_runs", """
SELECT 'c' || (o_custkey%20) AS case_id, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey%20 ORDER BY o_orderdate DESC, o_orderkey DESC) AS position, count(*) OVER (PARTITION BY o_custkey%20) > 200 AS truncated FROM orders QUALIFY position <= 200""")
def _(spark, sf):
    runs = src.table(spark, sf, "orders").selectExpr("concat('c', o_custkey % 20) AS case_id", "o_orderkey AS run_id", "o_orderdate AS created_at")
    return cw.case_runs(runs).select("case_id", "run_id", F.col("position").cast("long").alias("position"), "truncated")


@query("signal_feed", "SELECT event_id AS signal_id, event_type AS kind FROM events WHERE event_type<>'view' AND event_id > 100 ORDER BY event_id DESC LIMIT 200")
def _(spark, sf):
    signals = src.table(spark, sf, "events").selectExpr("event_id AS signal_id", "event_type AS kind", "CASE WHEN event_type = 'view' THEN ts END AS acknowledged_at")
    return cw.signal_feed(signals, 100, 200, True).select("signal_id", "kind")


@query("window_relations", """
WITH w AS (SELECT o_orderkey AS id, o_custkey AS wallet, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS s, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + (o_orderkey%40) - 2 AS c FROM orders),
g AS (SELECT * FROM w WHERE c > s)
SELECT w.id, CASE WHEN w.c=w.s THEN 'zero_duration' WHEN w.c<w.s THEN 'reversed' END AS problem, CASE WHEN w.c>w.s THEN CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.wallet=w.wallet AND g.id<>w.id AND g.s=w.s AND g.c=w.c) THEN 'identical'
 WHEN EXISTS (SELECT 1 FROM g WHERE g.wallet=w.wallet AND g.id<>w.id AND g.s<w.c AND w.s<g.c) THEN 'overlapping' ELSE 'distinct' END END AS relation FROM w""")
def _(spark, sf):
    day = src.epoch_seconds("o_orderdate") + " div 86400"
    w = src.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS wallet", f"timestamp_seconds({day} * 86400) AS start", f"timestamp_seconds(({day} + o_orderkey % 40 - 2) * 86400) AS cutoff"
    )
    return cw.window_relations(w, ["wallet"]).select("id", "problem", "relation")


@query("transfer_timeline", sql(*ENDINGS, body="""
SELECT trace_id, event_reference, from_address, to_address, t AS at, false AS derived FROM obs_t WHERE hop>0
UNION ALL SELECT e.trace_id, e.r, v.from_address, e.address, v.t, true FROM endings e JOIN ev v ON v.event_reference = e.r WHERE e.trace_id NOT IN (SELECT trace_id FROM obs_t WHERE hop>0)"""))
def _(spark, sf):
    t = saved(spark, sf)
    rows = cw.transfer_timeline(t.observed.filter("hop_depth > 0"), t.endings, t.header, src.ledger(spark, sf).select("tx_hash", "block_time"))
    return rows.withColumn("at", F.unix_seconds("at"))


