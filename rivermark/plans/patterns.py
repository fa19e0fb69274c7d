"""Verified sets, totals and behavioural rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermark.functions.predicates import fund_flow, spendable
from rivermark.operators import attribution as att
from rivermark.operators import labels as lab
from rivermark.operators import patterns as pat
from rivermark.operators import transfers as tr
from rivermark.plans.base import HUB, LABELS, LEDGER, SPARSE, SPENT, sql
from rivermark.registry import query
from rivermark.sources import tables as src

MOMENT = src.EPOCH + 200_000
MOMENT_TS = f"timestamp_seconds({MOMENT})"

#: Every line twice under its two-column key, which is not unique in the data.
RAW = """raw AS (SELECT * REPLACE ('tx:' || order_key || ':' || line AS event_reference) FROM ledger)"""


def spent(spark, sf):
    return src.ledger(spark, sf).filter(spendable())


def thin(spark, sf):
    return src.hourly(src.sparse(spent(spark, sf)))


def raw(spark, sf):
    return src.ledger(spark, sf).withColumn(
        "event_reference", F.concat_ws(":", F.lit("tx"), "order_key", "line")
    )


def services(spark, sf):
    """Addresses with one agreed accepted claim at a fixed moment."""
    picked = lab.label_conflicts(src.labels(spark, sf), F.expr(MOMENT_TS))
    return picked.filter("NOT conflict").select("address")


PICKED = f"""picked AS (SELECT network_key, address,
  count(DISTINCT (lower(trim(entity_name)), entity_type, address_role)) AS conclusions,
  arg_min(source_reference, row_no) AS src
 FROM labels_in WHERE assertion_type='service_control' AND review_state='accepted'
  AND (valid_from IS NULL OR valid_from <= {MOMENT}) AND (valid_to IS NULL OR valid_to >= {MOMENT})
 GROUP BY ALL),
services AS (SELECT address FROM picked WHERE conclusions = 1)"""


@query("spendable_transfers", sql(LEDGER, SPENT, body="""
SELECT event_reference, from_address, to_address, CAST(amount AS VARCHAR) AS amount_base_units, t FROM spent"""))
def _(spark, sf):
    return spent(spark, sf).select(
        "event_reference", "from_address", "to_address", "amount_base_units",
        F.unix_seconds("block_time").alias("t"),
    )


@query("fund_flow_events", sql(LEDGER, body="""
SELECT from_address, count(*) AS n, CAST(sum(amount) AS VARCHAR) AS units FROM ledger
WHERE event_kind='transfer' AND amount>0 AND execution_status NOT IN ('failed','reverted')
 AND confirmation_state <> 'removed' GROUP BY 1"""))
def _(spark, sf):
    from rivermark.functions.amounts import sum_units

    flow = src.ledger(spark, sf).filter(fund_flow())
    return flow.groupBy("from_address").agg(
        F.count(F.lit(1)).alias("n"), sum_units(F.col("amount_base_units")).alias("units")
    )


_CONTENT = "(from_address,to_address,amount,t,token_contract,tx_hash)"
_OK = "execution_status='success' AND confirmation_state='confirmed' AND amount>0"


@query("verified_events", sql(LEDGER, RAW, body=f"""
SELECT event_reference, min(from_address) AS from_address, min(to_address) AS to_address,
 CAST(min(amount) AS VARCHAR) AS amount_base_units FROM raw WHERE {_OK}
GROUP BY event_reference HAVING count(DISTINCT {_CONTENT}) = 1"""))
def _(spark, sf):
    return tr.verified_events(raw(spark, sf), ["network_key"]).select(
        "event_reference", "from_address", "to_address", "amount_base_units"
    )


_IDS = f"""content AS (SELECT event_reference, from_address, to_address, CAST(amount AS VARCHAR) AS amt, t,
  token_contract, tx_hash, count(*) AS copies FROM raw WHERE {_OK} GROUP BY ALL),
ids AS (SELECT event_reference, count(*) AS contents,
  arg_min(copies, (from_address, to_address, amt, t, token_contract, tx_hash)) AS first_copies FROM content GROUP BY 1)"""


_FOREIGN = """mixed AS (SELECT * REPLACE (CASE WHEN part_key % 11 = 0 THEN 'n9' ELSE network_key END AS network_key) FROM raw)"""
_HOME = f"""home AS (SELECT * FROM mixed WHERE network_key = 'n0' AND {_OK}),
content AS (SELECT event_reference, from_address, to_address, CAST(amount AS VARCHAR) AS amt, t, token_contract, tx_hash, count(*) AS copies FROM home GROUP BY ALL),
ids AS (SELECT event_reference, count(*) AS contents, arg_min(copies, (from_address, to_address, amt, t, token_contract, tx_hash)) AS first_copies FROM content GROUP BY 1)"""


@query("excluded_foreign_events", sql(LEDGER, RAW, _FOREIGN, _HOME, body=f"""
SELECT * FROM (
 SELECT 'execution_or_finality_unverified' AS reason, count(*) AS n FROM mixed WHERE NOT ({_OK})
 UNION ALL SELECT 'different_network', count(*) FROM mixed WHERE {_OK} AND network_key <> 'n0'
 UNION ALL SELECT 'duplicate_event', CAST(sum(first_copies-1) AS BIGINT) FROM ids
 UNION ALL SELECT 'conflicting_event_identity', count(*) FROM ids WHERE contents > 1) WHERE n > 0"""))
def _(spark, sf):
    """Rows of another network among those of a case."""
    rows = raw(spark, sf).withColumn("network_key", F.expr("CASE WHEN part_key % 11 = 0 THEN 'n9' ELSE network_key END"))
    return tr.excluded_event_counts(rows, [], "n0").select("reason", "n")


@query("excluded_event_counts", sql(LEDGER, RAW, _IDS, body=f"""
SELECT * FROM (
 SELECT 'execution_or_finality_unverified' AS reason, count(*) AS n FROM raw WHERE NOT ({_OK})
 UNION ALL SELECT 'duplicate_event', CAST(sum(first_copies-1) AS BIGINT) FROM ids
 UNION ALL SELECT 'conflicting_event_identity', count(*) FROM ids WHERE contents > 1) WHERE n > 0"""))
def _(spark, sf):
    return tr.excluded_event_counts(raw(spark, sf), ["network_key"]).select("reason", "n")


@query("dedupe_conflicts", sql(LEDGER, RAW, body=f"""
SELECT event_reference, count(*) AS copies, count(DISTINCT {_CONTENT}) AS contents,
 count(DISTINCT {_CONTENT}) > 1 AS conflict FROM raw GROUP BY 1"""))
def _(spark, sf):
    return tr.repeat_report(raw(spark, sf), ["network_key", "event_reference"]).drop("network_key")


@query("observed_volume", sql(LEDGER, SPARSE, body="""
SELECT trace_id, token_contract, count(*) AS observed_transfer_count,
 CAST(sum(amount) AS VARCHAR) AS gross_base_units FROM sparse GROUP BY 1,2"""))
def _(spark, sf):
    return tr.observed_volume(thin(spark, sf), ["trace_id"])


_DEG = """p AS (SELECT trace_id, from_address a, to_address b, count(*) n FROM sparse GROUP BY ALL),
deg AS (SELECT trace_id, w, sum(o) o, sum(i) i FROM (
 SELECT trace_id, a w, 1 o, 0 i FROM p UNION ALL SELECT trace_id, b, 0, 1 FROM p) GROUP BY ALL),
d AS (SELECT trace_id, count(*) wallets, count(*) FILTER (WHERE o>=3 OR i>=3) j, max(o) mo, max(i) mi FROM deg GROUP BY 1),
e AS (SELECT trace_id, CAST(sum(n) AS BIGINT) n, count(*) prs, CAST(coalesce(sum(n) FILTER (WHERE a=b),0) AS BIGINT) own FROM p GROUP BY 1)"""


@query("graph_metrics", sql(LEDGER, SPARSE, _DEG, body="""
SELECT trace_id, wallets AS wallet_count, n AS transfer_count, prs AS unique_directed_pairs, j AS junctions
FROM d JOIN e USING (trace_id)"""))
def _(spark, sf):
    return tr.graph_metrics(thin(spark, sf), ["trace_id"])


@query("graph_features", sql(LEDGER, SPARSE, _DEG, body="""
SELECT trace_id, ln(1.0+n::DOUBLE) AS log_verified_transfers, ln(1.0+wallets::DOUBLE) AS log_distinct_addresses,
 ln(1.0+mi::DOUBLE) AS log_max_in_degree, ln(1.0+mo::DOUBLE) AS log_max_out_degree,
 (n-prs)::DOUBLE/n AS repeated_pair_fraction, own::DOUBLE/n AS self_transfer_fraction FROM d JOIN e USING (trace_id)"""))
def _(spark, sf):
    out = tr.graph_features(thin(spark, sf), ["trace_id"])
    # Logs of two maths libraries may differ in the last digit.
    return out.select("trace_id", *[F.round(c, 9).alias(c) for c in out.columns if c != "trace_id"])


@query("fan_in", sql(LEDGER, SPARSE, LABELS, PICKED, body="""
SELECT to_address AS address, token_contract, count(DISTINCT from_address) AS counterparties, count(*) AS transfers
FROM sparse WHERE to_address NOT IN (SELECT address FROM services)
GROUP BY 1,2 HAVING count(DISTINCT from_address) >= 3"""))
def _(spark, sf):
    found = pat.fan(src.sparse(spent(spark, sf)), ["network_key"], "in", services(spark, sf))
    return found.drop("network_key")


@query("fan_out", sql(LEDGER, SPARSE, LABELS, PICKED, body="""
SELECT from_address AS address, token_contract, count(DISTINCT to_address) AS counterparties, count(*) AS transfers
FROM sparse WHERE from_address NOT IN (SELECT address FROM services)
GROUP BY 1,2 HAVING count(DISTINCT to_address) >= 3"""))
def _(spark, sf):
    found = pat.fan(src.sparse(spent(spark, sf)), ["network_key"], "out", services(spark, sf))
    return found.drop("network_key")


_MOVES = """m AS (
 SELECT to_address AS address, token_contract, 'in' AS side, event_reference, amount, t, seq, ordering_ambiguous FROM hub
 UNION ALL SELECT from_address, token_contract, 'out', event_reference, amount, t, seq, ordering_ambiguous FROM hub),
g AS (SELECT *, lag(side) OVER w ps, lag(event_reference) OVER w pr, lag(amount) OVER w pa, lag(t) OVER w pt,
  lag(ordering_ambiguous) OVER w po FROM m
 WINDOW w AS (PARTITION BY address, token_contract ORDER BY t, coalesce(seq,''), event_reference, side)),
rp AS (SELECT address, token_contract, pr AS in_reference, event_reference AS out_reference, t-pt AS elapsed,
  pa, amount, t, coalesce(seq,'') AS s FROM g
 WHERE ps='in' AND side='out' AND NOT po AND NOT ordering_ambiguous AND t-pt > 0 AND t-pt <= 3600
  AND 85*pa <= 100*amount AND 100*amount <= 105*pa)"""


def hub_pairs(spark, sf):
    return pat.rapid_pairs(src.hub(spent(spark, sf)), ["network_key"])


@query("rapid_pairs", sql(LEDGER, HUB, _MOVES, body="""
SELECT address, in_reference, out_reference, elapsed, CAST(pa AS VARCHAR) AS received, CAST(amount AS VARCHAR) AS sent FROM rp"""))
def _(spark, sf):
    return hub_pairs(spark, sf).select("address", "in_reference", "out_reference", "elapsed", "received", "sent")


@query("rapid_forwarding", sql(LEDGER, HUB, _MOVES, body="""
SELECT address, in_reference, out_reference, elapsed FROM rp
QUALIFY row_number() OVER (PARTITION BY address, token_contract ORDER BY t, s, out_reference) = 1"""))
def _(spark, sf):
    return pat.rapid_forwarding(hub_pairs(spark, sf), ["network_key"]).select(
        "address", "in_reference", "out_reference", "elapsed"
    )


@query("repeated_forwarding", sql(LEDGER, HUB, _MOVES, body="""
SELECT address, count(*) AS observed_pairs FROM rp GROUP BY address, token_contract HAVING count(*) >= 3"""))
def _(spark, sf):
    return pat.repeated_forwarding(hub_pairs(spark, sf), ["network_key"]).select("address", "observed_pairs")


_PEEL = """peel AS (SELECT from_address AS address, trace_id, token_contract, min(amount) AS small, max(amount) AS large,
 min(event_reference) AS r1, max(event_reference) AS r2 FROM sparse GROUP BY 1,2,3
 HAVING count(*)=2 AND count(DISTINCT to_address)=2 AND max(t)-min(t) <= 3600
  AND min(amount)*100 <= (min(amount)+max(amount))*10)"""


@query("peeling_split", sql(LEDGER, SPARSE, _PEEL, body="""
SELECT address, trace_id, token_contract, CAST(small AS VARCHAR) AS smaller_base_units,
 CAST(large AS VARCHAR) AS larger_base_units, r1 AS first_reference, r2 AS last_reference FROM peel"""))
def _(spark, sf):
    return pat.peeling_split(thin(spark, sf), ["trace_id"])


@query("intermediaries", sql(LEDGER, HUB, _MOVES, body="""
SELECT i.address, incoming_sources, outgoing_destinations,
 concat_ws(',', CASE WHEN r.address IS NOT NULL THEN 'observed_rapid_forwarding' END,
  CASE WHEN incoming_sources>=3 THEN 'observed_fan_in' END,
  CASE WHEN outgoing_destinations>=3 THEN 'observed_fan_out' END) AS factors
FROM (SELECT to_address AS address, count(DISTINCT from_address) AS incoming_sources FROM hub GROUP BY 1) i
JOIN (SELECT from_address AS address, count(DISTINCT to_address) AS outgoing_destinations FROM hub GROUP BY 1) o USING (address)
LEFT JOIN (SELECT DISTINCT address FROM rp) r ON r.address = i.address"""))
def _(spark, sf):
    events = src.hub(spent(spark, sf))
    out = pat.intermediaries(events, ["network_key"], hub_pairs(spark, sf))
    return out.select("address", "incoming_sources", "outgoing_destinations", "factors")


_REACH = """ed AS (SELECT DISTINCT trace_id, from_address a, to_address b FROM sparse),
reach(trace_id, a, b) AS (SELECT trace_id, a, b FROM ed UNION
 SELECT r.trace_id, r.a, e.b FROM reach r JOIN ed e ON e.trace_id = r.trace_id AND e.a = r.b),
cyc AS (SELECT DISTINCT trace_id FROM reach WHERE a = b)"""


@query("cyclic_topology", sql(LEDGER, SPARSE, _REACH, body="""
SELECT trace_id, trace_id IN (SELECT trace_id FROM cyc) AS has_directed_cycle
FROM (SELECT DISTINCT trace_id FROM sparse)"""))
def _(spark, sf):
    return pat.cyclic_topology(thin(spark, sf), ["trace_id"])


#: Graphs of two densities: an hour of one asset, and a day between fifty busy wallets.
GRAPHS = f"""graphs AS (SELECT * FROM sparse UNION ALL
 SELECT *, 'd:' || ((t - {src.EPOCH}) // 86400) AS trace_id FROM hub)"""


def graphs(spark, sf):
    events = spent(spark, sf)
    busy = src.hub(events).withColumn("trace_id", F.concat(F.lit("d:"), F.expr(f"(unix_seconds(block_time) - {src.EPOCH}) div 86400")))
    return thin(spark, sf).unionByName(busy)


def bridges(spark, sf):
    """Addresses with an agreed accepted claim of a bridge at a fixed moment, where tracing would end."""
    claims = src.labels(spark, sf)
    held = lab.label_conflicts(claims, F.expr(MOMENT_TS)).filter("NOT conflict").select("address", F.col("picked_source").alias("source_reference"))
    kind = claims.select("address", "source_reference", "entity_type").distinct()
    return held.join(kind, ["address", "source_reference"]).filter("entity_type = 'bridge'").select("address")


def _findings(spark, sf):
    """Rule hits per graph; reviewed services are left out, except as the boundary they are."""
    events, known, scope = graphs(spark, sf), services(spark, sf), ["trace_id"]
    pairs = pat.rapid_pairs(events, scope, known)

    def hit(rule, found):
        return found.select("trace_id", F.lit(rule).alias("rule"), "address")

    ends = events.select("trace_id", F.col("to_address").alias("address")).join(bridges(spark, sf), "address").withColumn("boundary_reason", F.lit("bridge"))
    return [
        hit("fan_in", pat.fan(events, scope, "in", known)),
        hit("fan_out", pat.fan(events, scope, "out", known)),
        hit("rapid_forwarding", pairs.select("trace_id", "address").distinct()),
        hit("repeated_forwarding", pat.repeated_forwarding(pairs, scope)),
        hit("peeling_like_split", pat.peeling_split(events, scope, known)),
        hit("cyclic_topology", pat.cyclic_topology(events, scope).filter("has_directed_cycle").withColumn("address", F.lit(""))),
        hit("protocol_boundary", att.protocol_boundary(ends)),
    ]


_TRIAGE = """bridges AS (SELECT p.address FROM picked p WHERE conclusions = 1 AND (SELECT min(entity_type) FROM labels_in l WHERE l.address = p.address AND l.source_reference = p.src) = 'bridge'),
gm AS (SELECT trace_id, to_address AS address, token_contract, 'in' AS side, event_reference, amount, t, seq, ordering_ambiguous FROM graphs WHERE to_address NOT IN (SELECT address FROM services)
 UNION ALL SELECT trace_id, from_address, token_contract, 'out', event_reference, amount, t, seq, ordering_ambiguous FROM graphs WHERE from_address NOT IN (SELECT address FROM services)),
gg AS (SELECT *, lag(side) OVER w ps, lag(amount) OVER w pa, lag(t) OVER w pt, lag(ordering_ambiguous) OVER w po FROM gm
 WINDOW w AS (PARTITION BY trace_id, address, token_contract ORDER BY t, coalesce(seq,''), event_reference, side)),
gp AS (SELECT trace_id, address, token_contract, count(*) AS n FROM gg WHERE ps='in' AND side='out' AND NOT po AND NOT ordering_ambiguous AND t-pt > 0 AND t-pt <= 3600
  AND 85*pa <= 100*amount AND 100*amount <= 105*pa GROUP BY ALL),
ed AS (SELECT DISTINCT trace_id, from_address a, to_address b FROM graphs),
reach(trace_id, a, b) AS (SELECT trace_id, a, b FROM ed UNION SELECT r.trace_id, r.a, e.b FROM reach r JOIN ed e ON e.trace_id = r.trace_id AND e.a = r.b),
f AS (
 SELECT trace_id, 'fan_in' AS rule, 15 AS w FROM graphs WHERE to_address NOT IN (SELECT address FROM services) GROUP BY trace_id, token_contract, to_address HAVING count(DISTINCT from_address)>=3
 UNION ALL SELECT trace_id, 'fan_out', 15 FROM graphs WHERE from_address NOT IN (SELECT address FROM services) GROUP BY trace_id, token_contract, from_address HAVING count(DISTINCT to_address)>=3
 UNION ALL SELECT trace_id, 'rapid_forwarding', 20 FROM gp
 UNION ALL SELECT trace_id, 'repeated_forwarding', 15 FROM gp WHERE n >= 3
 UNION ALL SELECT trace_id, 'peeling_like_split', 10 FROM graphs WHERE from_address NOT IN (SELECT address FROM services) GROUP BY trace_id, token_contract, from_address
  HAVING count(*)=2 AND count(DISTINCT to_address)=2 AND max(t)-min(t) <= 3600 AND min(amount)*100 <= (min(amount)+max(amount))*10
 UNION ALL SELECT DISTINCT trace_id, 'cyclic_topology', 5 FROM reach WHERE a = b
 UNION ALL SELECT DISTINCT trace_id, 'protocol_boundary', 10 FROM graphs WHERE to_address IN (SELECT address FROM bridges))"""


@query("triage_score", sql(LEDGER, SPARSE, HUB, LABELS, PICKED, GRAPHS, _TRIAGE, body="""
SELECT trace_id, least(100, CAST(sum(w) AS BIGINT)) AS score, string_agg(rule, ',' ORDER BY rule) AS rules,
 CASE WHEN sum(w)>=45 THEN 'high' WHEN sum(w)>=20 THEN 'medium' WHEN sum(w)>0 THEN 'low' ELSE 'unscored' END AS priority
FROM (SELECT DISTINCT * FROM f) GROUP BY 1"""))
def _(spark, sf):
    """All seven rules; each hit is folded to its graph and rule before they meet."""
    hits = [h.select("trace_id", "rule").distinct() for h in _findings(spark, sf)]
    return pat.triage_score(reduce(DataFrame.unionByName, hits), ["trace_id"])


_WIDE = """wide AS (
 SELECT 'fan_in' AS rule, to_address AS address, token_contract, event_reference FROM sparse SEMI JOIN
  (SELECT to_address, token_contract FROM sparse GROUP BY ALL HAVING count(DISTINCT from_address)>=3) USING (to_address, token_contract)
 UNION ALL SELECT 'fan_out', from_address, token_contract, event_reference FROM sparse SEMI JOIN
  (SELECT from_address, token_contract FROM sparse GROUP BY ALL HAVING count(DISTINCT to_address)>=3) USING (from_address, token_contract)
 UNION ALL SELECT 'repeated_forwarding', address, token_contract, unnest([in_reference, out_reference]) FROM rp SEMI JOIN
  (SELECT address, token_contract FROM rp GROUP BY ALL HAVING count(*)>=3) USING (address, token_contract)),
parts AS (SELECT rule, address, token_contract, substring(sha256(event_reference),1,3) AS p, count(DISTINCT event_reference) AS n, sha256(string_agg(DISTINCT event_reference, '|' ORDER BY event_reference)) AS d FROM wide GROUP BY ALL),
roots AS (SELECT rule, address, token_contract, CAST(sum(n) AS BIGINT) AS refs, sha256(string_agg(d, '|' ORDER BY p)) AS d FROM parts GROUP BY ALL)"""


@query("wide_pattern_ids", sql(LEDGER, HUB, _MOVES, SPARSE, _WIDE, body="""
SELECT rule, address, token_contract, refs AS references_seen, substring(sha256(rule || '|' || address || '|' || d), 1, 16) AS pattern_id FROM roots"""))
def _(spark, sf):
    """Ids of findings whose references are as many as the ledger has."""
    events = src.sparse(spent(spark, sf))
    pairs = hub_pairs(spark, sf)
    found = [
        pat.fan_references(events, ["network_key"], "in").withColumn("rule", F.lit("fan_in")),
        pat.fan_references(events, ["network_key"], "out").withColumn("rule", F.lit("fan_out")),
        pat.repeated_references(pairs, ["network_key"]).withColumn("rule", F.lit("repeated_forwarding")),
    ]
    return pat.wide_pattern_ids(reduce(DataFrame.unionByName, found), ["network_key"]).drop("network_key")


@query("pattern_ids", sql(LEDGER, HUB, _MOVES, SPARSE, _PEEL, body="""
SELECT 'rapid_forwarding' AS rule, address, substring(sha256('rapid_forwarding|' || address || '|' ||
 least(in_reference,out_reference) || '|' || greatest(in_reference,out_reference)),1,16) AS pattern_id
FROM (SELECT * FROM rp QUALIFY row_number() OVER (PARTITION BY address, token_contract ORDER BY t, s, out_reference) = 1)
UNION ALL SELECT 'peeling_like_split', address,
 substring(sha256('peeling_like_split|' || address || '|' || r1 || '|' || r2),1,16) FROM peel"""))
def _(spark, sf):
    rapid = pat.rapid_forwarding(hub_pairs(spark, sf), ["network_key"]).select(
        F.lit("rapid_forwarding").alias("rule"), "address", "in_reference", "out_reference"
    )
    peel = pat.peeling_split(thin(spark, sf), ["trace_id"]).select(
        F.lit("peeling_like_split").alias("rule"), "address", "first_reference", "last_reference"
    )
    both = rapid.union(peel)
    ident = pat.pattern_id(F.col("rule"), F.col("address"), F.col("in_reference"), F.col("out_reference"))
    return both.select("rule", "address", ident.alias("pattern_id"))


@query("label_interval_join", sql(LEDGER, SPENT, LABELS, body="""
SELECT x.event_reference, l.source_reference, l.entity_name FROM spent x JOIN labels_in l
 ON l.network_key = x.network_key AND l.address = x.to_address
WHERE l.review_state NOT IN ('rejected','quarantined')
 AND (l.valid_from IS NULL OR x.t >= l.valid_from) AND (l.valid_to IS NULL OR x.t <= l.valid_to)"""))
def _(spark, sf):
    hits = lab.label_interval_join(
        spent(spark, sf), src.labels(spark, sf), "to_address", "block_time", ["event_reference"]
    )
    return hits.select("event_reference", "claim.source_reference", "claim.entity_name")


@query("label_conflicts", sql(LABELS, PICKED, body="""
SELECT address, conclusions, conclusions > 1 AS conflict, CASE WHEN conclusions = 1 THEN src END AS picked_source FROM picked"""))
def _(spark, sf):
    return lab.label_conflicts(src.labels(spark, sf), F.expr(MOMENT_TS)).drop("network_key")


@query("load_labels", sql(LABELS, body="""
SELECT address, entity_name, assertion_type, review_state, source_reference, valid_from, valid_to
FROM labels_in WHERE review_state NOT IN ('rejected','quarantined')"""))
def _(spark, sf):
    return lab.load_labels(src.labels(spark, sf)).select(
        "address", "entity_name", "assertion_type", "review_state", "source_reference",
        F.unix_seconds("valid_from").alias("valid_from"), F.unix_seconds("valid_to").alias("valid_to"),
    )


@query("label_snapshot", sql(LABELS, body="""
SELECT assertion_type, review_state, count(*) AS claims, count(DISTINCT address) AS addresses,
 count(*) FILTER (WHERE review_state IN ('rejected','quarantined')) AS withdrawn FROM labels_in GROUP BY 1,2"""))
def _(spark, sf):
    return lab.label_snapshot(src.labels(spark, sf))

