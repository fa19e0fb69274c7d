"""Receiving services, requests, flow graphs and cross-case overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivermark.operators import attribution as att
from rivermark.operators import flow
from rivermark.operators.patterns import digest_of, pattern_id, recommendations
from rivermark.operators.transfers import verified_events
from rivermark.plans.base import LABELS, LEDGER, SPARSE, SPENT, sql
from rivermark.plans.patterns import spent, thin
from rivermark.plans.traces import _COVERED, _LIMITS, ENDINGS, saved
from rivermark.registry import query
from rivermark.sources import tables as src


def damaged(endings):
    """Saved endings, some with a shortened or altered path, as found in old results."""
    kind = F.length("arrival_event_reference") % 5
    return endings.withColumn(
        "branch_path",
        F.when((kind == 0) & (F.size("branch_path") > 1), F.slice("branch_path", F.lit(2), F.size("branch_path")))
        .when(kind == 1, F.transform("branch_path", lambda r, i: F.when(i == 0, F.concat(F.lit("x"), r)).otherwise(r)))
        .otherwise(F.col("branch_path")),
    )


def doubted(observed):
    """Saved events, some found unverified later."""
    late = (F.length("event_reference") % 7 == 0) & (F.substring("event_reference", -1, 1) == "3")
    return observed.withColumn("execution_status", F.when(late, "unknown").otherwise(F.col("execution_status")))


_SERV = """doubt AS (SELECT DISTINCT event_reference FROM spent WHERE length(event_reference) % 7 = 0 AND right(event_reference, 1) = '3'),
serv AS (SELECT e.trace_id, e.address, e.hop, e.path, e.r, e.source_reference, st.entity_name, st.entity_type, st.address_role,
 length(e.r) % 5 AS kind FROM endings e JOIN st USING (trace_id, r) WHERE e.endpoint_class = 'known_service'),
dam AS (SELECT *, CASE WHEN kind = 0 AND hop > 0 THEN substring(path, strpos(path,'>')+1) WHEN kind = 1 THEN 'x' || path ELSE path END AS dpath,
 CASE WHEN kind = 1 OR EXISTS (SELECT 1 FROM unnest(string_split(CASE WHEN kind = 0 AND hop > 0 THEN substring(path, strpos(path,'>')+1) ELSE path END, '>')) u(x) WHERE x IN (SELECT event_reference FROM doubt))
  THEN 'missing_or_unverified_deposit_path' WHEN kind = 0 AND hop > 0 THEN 'disconnected_path' END AS problem FROM serv)"""
SERV = (*ENDINGS, _SERV)


@query("service_boundaries", sql(*SERV, body="""
SELECT trace_id, address, entity_name, CAST(hop AS BIGINT) AS hop_depth, r AS arrival_event_reference, address_role, source_reference,
 address_role = 'deposit' AS deposit_role_verified FROM dam WHERE problem IS NULL OR problem = 'disconnected_path'"""))
def _(spark, sf):
    t = saved(spark, sf)
    return att.service_boundaries(damaged(t.endings), doubted(t.observed), t.header)


@query("receiving_services", sql(*SERV, body="""
SELECT trace_id, 'n0' AS network_key, address, entity_name, entity_type, address_role, r AS arrival_event_reference, dpath AS path,
 CAST(hop+1 AS BIGINT) AS hops, hop = 0 AS direct FROM dam WHERE problem IS NULL AND entity_type IN ('exchange','custodial_service')"""))
def _(spark, sf):
    t = saved(spark, sf)
    return att.receiving_services(damaged(t.endings), doubted(t.observed), t.header)


@query("rejected_paths", sql(*SERV, body="""
SELECT trace_id, address, dpath AS path, problem AS reason FROM dam WHERE problem IS NOT NULL AND entity_type IN ('exchange','custodial_service')"""))
def _(spark, sf):
    t = saved(spark, sf)
    return att.rejected_paths(damaged(t.endings), doubted(t.observed), t.header)


def _services(spark, sf):
    t = saved(spark, sf)
    return att.receiving_services(t.endings, t.observed, t.header)


@query("nearest_services", sql(*SERV, body="""
SELECT trace_id, address, entity_name, path, CAST(hop+1 AS BIGINT) AS hops FROM serv WHERE entity_type IN ('exchange','custodial_service')
QUALIFY rank() OVER (PARTITION BY trace_id ORDER BY hop) = 1"""))
def _(spark, sf):
    return att.nearest_services(_services(spark, sf)).select("trace_id", "address", "entity_name", "path", "hops")


@query("service_groups", sql(*SERV, body="""
SELECT DISTINCT trace_id, 'n0' AS network_key, entity_name, address FROM serv WHERE entity_type IN ('exchange','custodial_service')"""))
def _(spark, sf):
    return att.service_groups(_services(spark, sf))


@query("protocol_boundary", sql(*SERV, body="""
SELECT trace_id, address, 'bridge' AS boundary_reason, substring(sha256('protocol_boundary|' || address || '|'),1,16) AS pattern_id
FROM serv WHERE entity_type = 'bridge'"""))
def _(spark, sf):
    # A stop at a bridge is a protocol boundary, not a custodian.
    ends = saved(spark, sf).endings.withColumn(
        "boundary_reason", F.when(F.col("entity_type") == "bridge", "bridge").otherwise(F.col("boundary_reason"))
    )
    found = att.protocol_boundary(ends.filter("endpoint_class = 'known_service'"))
    return found.withColumn("pattern_id", pattern_id(F.lit("protocol_boundary"), F.col("address")))


@query("recommendations", sql(*SERV, _LIMITS, _COVERED, body="""
, gone AS (SELECT trace_id, count(DISTINCT event_reference) AS excluded FROM lim WHERE code = 'execution_or_finality_unverified' GROUP BY 1)
SELECT trace_id, boundaries, coalesce(excluded, 0) AS excluded, concat_ws(',', 'preserve_evidence', 'review_scope', CASE WHEN boundaries > 0 THEN 'review_vasp_request' END,
 CASE WHEN limited OR coalesce(excluded, 0) > 0 THEN 'resolve_data_gaps' END) AS actions
FROM (SELECT c.trace_id, count(serv.r) AS boundaries, bool_or(c.coverage_status <> 'complete_within_scope') AS limited
 FROM covered c LEFT JOIN serv USING (trace_id) GROUP BY 1) LEFT JOIN gone USING (trace_id)""".lstrip()))
def _(spark, sf):
    t = saved(spark, sf)
    n = att.service_boundaries(t.endings, t.observed, t.header).groupBy("trace_id").agg(F.count(F.lit(1)).alias("boundaries"))
    # Events at the trace's wallets that the verified set turned away.
    turned = t.limitations.filter("code = 'execution_or_finality_unverified'")
    excluded = turned.groupBy("trace_id").agg(F.countDistinct("event_reference").alias("excluded"))
    rows = t.header.select("trace_id", "coverage_status").join(n, "trace_id", "left").join(excluded, "trace_id", "left").select(
        "trace_id", F.coalesce("boundaries", F.lit(0)).cast("long").alias("boundaries"), F.coalesce("excluded", F.lit(0)).alias("excluded"),
        "coverage_status",
    )
    return recommendations(rows).select("trace_id", "boundaries", "excluded", "actions")


@query("trace_digests", sql(*ENDINGS, body="""
, lines AS (SELECT trace_id, 'o|' || event_reference || '|' || hop AS line FROM obs_t
 UNION ALL SELECT trace_id, 'e|' || address || '|' || endpoint_class || '|' || coalesce(boundary_reason, '') || '|' || path FROM endings),
parts AS (SELECT trace_id, substring(sha256(line),1,3) AS p, count(DISTINCT line) AS n, sha256(string_agg(DISTINCT line, '|' ORDER BY line)) AS d FROM lines GROUP BY ALL)
SELECT trace_id, CAST(sum(n) AS BIGINT) AS lines, sha256(string_agg(d, '|' ORDER BY p)) AS trace_sha256 FROM parts GROUP BY 1""".lstrip()))
def _(spark, sf):
    """One digest per saved trace over its transfers and endings."""
    t = saved(spark, sf)
    seen = t.observed.select("trace_id", F.concat_ws("|", F.lit("o"), "event_reference", "hop_depth").alias("line"))
    ends = t.endings.select("trace_id", F.concat_ws("|", F.lit("e"), "address", "endpoint_class", F.coalesce("boundary_reason", F.lit("")), F.array_join("branch_path", ">")).alias("line"))
    return digest_of(seen.unionByName(ends), ["trace_id"], "line").select("trace_id", F.col("n").alias("lines"), F.col("digest").alias("trace_sha256"))


@query("request_identifiers", sql(*ENDINGS, body="""
SELECT trace_id, tx_hash, count(*) OVER (PARTITION BY trace_id) AS observed_transactions FROM (SELECT DISTINCT trace_id, tx_hash FROM obs_t)"""))
def _(spark, sf):
    return att.request_identifiers(saved(spark, sf).observed)


@query("request_eligibility", sql(*SERV, body="""
SELECT DISTINCT trace_id, address, address_role, CASE WHEN address_role IN ('hot_wallet','cold_reserve','settlement') THEN 'pooled_address'
 WHEN address_role = 'unknown' THEN 'role_not_established' END AS refusal,
 address_role NOT IN ('hot_wallet','cold_reserve','settlement','unknown') AS eligible FROM serv"""))
def _(spark, sf):
    return att.request_eligibility(saved(spark, sf).endings)


@query("scope_limitations", sql(*SERV, body="""
SELECT DISTINCT trace_id, 'address_role_unknown' AS code, address AS about FROM serv WHERE address_role = 'unknown'
UNION ALL SELECT DISTINCT s.trace_id, 'snapshot_only_label', s.address FROM serv s JOIN labels_in l USING (source_reference) WHERE l.valid_from = l.valid_to
UNION ALL SELECT DISTINCT trace_id, 'allocation_unknown', NULL FROM serv"""))
def _(spark, sf):
    dates = src.labels(spark, sf).select("source_reference", "valid_from", "valid_to")
    ends = saved(spark, sf).endings.filter("endpoint_class = 'known_service'").join(dates, "source_reference", "left")
    return att.scope_limitations(ends)


@query("run_summary", sql(*ENDINGS, body="""
SELECT s.trace_id, (SELECT count(*) FROM obs_t o WHERE o.trace_id = s.trace_id) AS observed_transfers, count(*) AS branch_endings,
 count(*) FILTER (WHERE endpoint_class='unresolved') AS unresolved, count(*) FILTER (WHERE endpoint_class='deposit_candidate') AS candidate,
 count(*) FILTER (WHERE endpoint_class='known_service') AS known_service FROM seed s JOIN endings e USING (trace_id) GROUP BY 1"""))
def _(spark, sf):
    t = saved(spark, sf)
    seen = t.observed.groupBy("trace_id").agg(F.count(F.lit(1)).alias("observed_transfers"))
    n = lambda c: F.sum((F.col("endpoint_class") == c).cast("long"))
    ends = t.endings.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("branch_endings"), n("unresolved").alias("unresolved"),
        n("deposit_candidate").alias("candidate"), n("known_service").alias("known_service"),
    )
    return seen.join(ends, "trace_id")


@query("incomplete_traces", sql(*ENDINGS, body="""
SELECT trace_id, boundary_reason, count(*) AS endings FROM endings WHERE boundary_reason IN ('hop_limit','event_limit') GROUP BY 1,2"""))
def _(spark, sf):
    return saved(spark, sf).endings.filter(
        "boundary_reason IN ('hop_limit','event_limit','api_budget','time_limit','provider_failure')"
    ).groupBy("trace_id", "boundary_reason").agg(F.count(F.lit(1)).alias("endings"))


_NODES = """fe AS (SELECT trace_id, event_reference, from_address, to_address FROM obs_t),
ed_n AS (SELECT e.*, e.endpoint_class='unresolved' AND e.boundary_reason IS NULL AND EXISTS (SELECT 1 FROM fe WHERE fe.trace_id=e.trace_id AND fe.from_address=e.address) AS rec FROM endings e),
nodes AS (SELECT trace_id, address FROM (SELECT trace_id, from_address AS address FROM fe UNION SELECT trace_id, to_address FROM fe)),
rl AS (SELECT trace_id, address, count(DISTINCT endpoint_class) FILTER (WHERE NOT rec) AS k, min(endpoint_class) FILTER (WHERE NOT rec) AS c, count(*) FILTER (WHERE rec) AS rec FROM ed_n GROUP BY 1,2),
oc AS (SELECT trace_id, from_address AS address, count(*) AS n FROM fe GROUP BY 1,2), ic AS (SELECT trace_id, to_address AS address, count(*) AS n FROM fe GROUP BY 1,2),
sd AS (SELECT s.trace_id, e.from_address AS address FROM seed s JOIN ev e ON e.event_reference = s.r)"""


@query("flow_edges", sql(*ENDINGS, body="""
SELECT trace_id, event_reference, from_address, to_address, CAST(hop AS BIGINT) AS hop_depth, hop = 0 AS is_seed FROM obs_t"""))
def _(spark, sf):
    return flow.flow_edges(saved(spark, sf).observed)


def _edges(t):
    # Nodes read the edges once per end and once for the senders.
    return t.once("edges", lambda: flow.flow_edges(t.observed))


@query("flow_nodes", sql(*ENDINGS, _NODES, body="""
SELECT n.trace_id, n.address, coalesce(ic.n,0) AS incoming, coalesce(oc.n,0) AS outgoing,
 CASE WHEN sd.address IS NOT NULL THEN 'seed' WHEN rl.k > 1 THEN 'mixed' WHEN rl.k = 1 THEN rl.c ELSE 'intermediate' END AS role,
 coalesce(rl.rec,0) AS reconverged FROM nodes n LEFT JOIN ic USING (trace_id,address) LEFT JOIN oc USING (trace_id,address)
 LEFT JOIN rl USING (trace_id,address) LEFT JOIN sd USING (trace_id,address)"""))
def _(spark, sf):
    t = saved(spark, sf)
    return flow.flow_nodes(t.header, _edges(t), t.endings)


@query("fund_flow_stats", sql(*ENDINGS, _NODES, body="""
SELECT s.trace_id, (SELECT count(*) FROM nodes n WHERE n.trace_id=s.trace_id) AS wallets, (SELECT count(*) FROM fe WHERE fe.trace_id=s.trace_id) AS transfers,
 count(*) AS branches, count(*) FILTER (WHERE endpoint_class='known_service') AS supported_boundaries, count(*) FILTER (WHERE endpoint_class='deposit_candidate') AS candidate_leads,
 count(*) FILTER (WHERE endpoint_class='unresolved' AND NOT rec) AS unresolved, count(*) FILTER (WHERE rec) AS reconverged FROM seed s JOIN ed_n USING (trace_id) GROUP BY 1"""))
def _(spark, sf):
    t = saved(spark, sf)
    edges = _edges(t)
    return flow.fund_flow_stats(t.header, edges, flow.flow_nodes(t.header, edges, t.endings), t.endings)


@query("derived_seed_edges", sql(*ENDINGS, body="""
SELECT s.trace_id, s.r AS event_reference, e.from_address, e.to_address FROM seed s JOIN ev e ON e.event_reference = s.r
WHERE EXISTS (SELECT 1 FROM endings d WHERE d.trace_id = s.trace_id AND d.r = s.r)"""))
def _(spark, sf):
    t = saved(spark, sf)
    # Saved results of the old form: the seed transfer itself was not kept.
    return flow.derived_seed_edges(t.header, flow.flow_edges(t.observed.filter("hop_depth > 0")), t.endings)


_LAYERS = """lk AS (SELECT DISTINCT trace_id, from_address a, to_address b FROM sparse WHERE from_address <> to_address),
rc(trace_id, a, b) AS (SELECT trace_id, a, b FROM lk UNION SELECT r.trace_id, r.a, e.b FROM rc r JOIN lk e ON e.trace_id=r.trace_id AND e.a=r.b),
cy AS (SELECT DISTINCT trace_id FROM rc WHERE a=b),
nd AS (SELECT trace_id, w FROM (SELECT trace_id, from_address w FROM sparse UNION SELECT trace_id, to_address FROM sparse)),
lp(trace_id, w, d) AS (SELECT trace_id, w, 0 FROM nd WHERE trace_id NOT IN (SELECT trace_id FROM cy)
 UNION SELECT l.trace_id, e.b, l.d+1 FROM lp l JOIN lk e ON e.trace_id=l.trace_id AND e.a=l.w),
sdl AS (SELECT trace_id, arg_min(from_address, (t, event_reference)) AS w FROM sparse GROUP BY 1),
bf(trace_id, w, d) AS (SELECT trace_id, w, 0 FROM sdl WHERE trace_id IN (SELECT trace_id FROM cy)
 UNION SELECT l.trace_id, e.b, l.d+1 FROM bf l JOIN lk e ON e.trace_id=l.trace_id AND e.a=l.w WHERE l.d < 40),
bm AS (SELECT trace_id, w, min(d) AS d FROM bf GROUP BY 1,2), dp AS (SELECT trace_id, max(d)+1 AS past FROM bm GROUP BY 1)"""


@query("flow_layers", sql(LEDGER, SPARSE, _LAYERS, body="""
SELECT trace_id, w AS address, CAST(max(d) AS BIGINT) AS layer, true AS acyclic FROM lp GROUP BY 1,2
UNION ALL SELECT n.trace_id, n.w, CAST(coalesce(bm.d, dp.past) AS BIGINT), false FROM nd n JOIN dp USING (trace_id) LEFT JOIN bm ON bm.trace_id=n.trace_id AND bm.w=n.w"""))
def _(spark, sf):
    events = thin(spark, sf)
    first = F.min_by("from_address", F.struct("block_time", "event_reference"))
    return flow.flow_layers(events, events.groupBy("trace_id").agg(first.alias("address")))


@query("flow_strays", sql(LEDGER, SPARSE, """lk AS (SELECT DISTINCT trace_id, from_address a, to_address b FROM sparse WHERE from_address <> to_address),
nd AS (SELECT trace_id, w FROM (SELECT trace_id, from_address w FROM sparse UNION SELECT trace_id, to_address FROM sparse)),
sdl AS (SELECT trace_id, arg_min(from_address, (t, event_reference)) AS w FROM sparse GROUP BY 1),
rc(trace_id, w) AS (SELECT * FROM sdl UNION SELECT r.trace_id, e.b FROM rc r JOIN lk e ON e.trace_id = r.trace_id AND e.a = r.w)""", body="""
SELECT n.trace_id, count(*) AS wallets, count(*) FILTER (WHERE r.w IS NULL) AS strays FROM nd n LEFT JOIN rc r ON r.trace_id = n.trace_id AND r.w = n.w GROUP BY 1"""))
def _(spark, sf):
    events = thin(spark, sf)
    first = F.min_by("from_address", F.struct("block_time", "event_reference"))
    return flow.flow_strays(events, events.groupBy("trace_id").agg(first.alias("address")))


def _modes(df):
    return df.withColumn("data_mode", F.lit("LIVE"))


_SHARED = """shr AS (SELECT DISTINCT address FROM labels_in WHERE assertion_type='service_control' AND review_state='accepted')"""


@query("cross_case_overlap", sql(LEDGER, SPENT, LABELS, _SHARED, body="""
, seen AS (SELECT 'c' || (sender_key % 400) AS case_id, unnest(list_distinct([from_address, to_address])) AS address FROM spent),
pc AS (SELECT address, case_id, count(*) AS events FROM seen GROUP BY 1,2),
ov AS (SELECT address, count(*) AS case_count FROM pc GROUP BY 1 HAVING count(*) >= 2)
SELECT pc.*, ov.case_count FROM pc JOIN ov USING (address) WHERE address NOT IN (SELECT address FROM shr)""".lstrip()))
def _(spark, sf):
    events = _modes(spent(spark, sf)).withColumn("case_id", F.expr("concat('c', sender_key % 400)"))
    shared = _modes(src.labels(spark, sf)).filter("assertion_type = 'service_control' AND review_state = 'accepted'")
    return att.cross_case_overlap(events, shared).select("address", "case_id", "events", "case_count")


@query("case_representatives", """
WITH runs AS (SELECT 'c' || (o_custkey % 300) AS case_id, o_orderkey AS run_id, CAST(epoch(o_orderdate) AS BIGINT) AS created_at,
 sha256(o_orderstatus || ':' || o_orderkey) AS dig, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE sha256(o_orderstatus || ':' || o_orderkey) END AS stored FROM orders)
SELECT case_id, arg_max(run_id, (created_at, run_id)) AS run_id, max(created_at) AS created_at FROM runs WHERE dig = stored GROUP BY 1""")
def _(spark, sf):
    runs = src.table(spark, sf, "orders").selectExpr(
        "concat('c', o_custkey % 300) AS case_id", "o_orderkey AS run_id",
        f"{src.epoch_seconds('o_orderdate')} AS created_at", "concat(o_orderstatus, ':', o_orderkey) AS payload",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE sha2(concat(o_orderstatus, ':', o_orderkey), 256) END AS payload_sha256",
    )
    return att.case_representatives(runs)


@query("index_events", sql(LEDGER, SPENT, body="""
SELECT 'c' || (sender_key % 40) AS run_id, event_reference, sha256(event_reference || '|' || from_address || '|' || to_address || '|' || amount) AS observed_sha256
FROM spent WHERE line <> 3"""))
def _(spark, sf):
    events = verified_events(spent(spark, sf), ["network_key"]).withColumn("run_id", F.expr("concat('c', sender_key % 40)"))
    done = events.filter("line = 3")  # an earlier partial run indexed these
    out = att.index_events(events, done, ["event_reference", "from_address", "to_address", "amount_base_units"])
    return out.select("run_id", "event_reference", "observed_sha256")


_ANCHORS = """anch AS (SELECT address, valid_from, valid_to FROM labels_in WHERE assertion_type='service_control' AND review_state='accepted'
 QUALIFY row_number() OVER (PARTITION BY address ORDER BY row_no) = 1),
flow AS (SELECT * FROM ledger WHERE event_kind='transfer' AND amount>0 AND confirmation_state<>'removed' AND execution_status NOT IN ('failed','reverted')),
onto AS (SELECT f.*, (a.valid_from IS NULL OR f.t>=a.valid_from) AND (a.valid_to IS NULL OR f.t<=a.valid_to) AS covered FROM flow f JOIN anch a ON a.address = f.to_address)"""


def _anchors(spark, sf):
    claims = src.labels(spark, sf).filter("assertion_type = 'service_control' AND review_state = 'accepted'")
    one = F.min_by(F.struct("entity_name", "valid_from", "valid_to"), "row_no")
    return claims.groupBy("network_key", "address").agg(one.alias("c")).select("network_key", "address", "c.*")


def _flow(spark, sf):
    from rivermark.functions.predicates import fund_flow

    return src.ledger(spark, sf).filter(fund_flow())


CAP = 20


@query("anchor_senders", sql(LEDGER, LABELS, _ANCHORS, body=f"""
, snd AS (SELECT to_address AS anchor_address, from_address AS candidate_address, min(t) AS t, arg_min(event_reference,(t,event_reference)) AS event_reference FROM onto WHERE covered GROUP BY 1,2)
SELECT anchor_address, candidate_address, event_reference, count(*) OVER (PARTITION BY anchor_address) > {CAP} AS truncated FROM snd
QUALIFY row_number() OVER (PARTITION BY anchor_address ORDER BY t, event_reference) <= {CAP}""".lstrip()))
def _(spark, sf):
    top, _rest = att.anchor_senders(_flow(spark, sf), _anchors(spark, sf), CAP)
    return top.select("anchor_address", "candidate_address", "event_reference", "truncated")


@query("ineligible_events", sql(LEDGER, LABELS, _ANCHORS, body="""
SELECT from_address AS candidate_address, to_address AS anchor_address, event_reference, 'claim_does_not_cover_transfer' AS reason FROM onto WHERE NOT covered"""))
def _(spark, sf):
    return att.anchor_senders(_flow(spark, sf), _anchors(spark, sf), CAP)[1]


_NEIGH = f"""us AS (SELECT * FROM flow WHERE NOT ordering_ambiguous AND t BETWEEN {src.EPOCH} AND {src.EPOCH + 300000}),
ob AS (SELECT u.*, (a.valid_from IS NULL OR u.t>=a.valid_from) AND (a.valid_to IS NULL OR u.t<=a.valid_to) AS covered FROM us u JOIN anch a ON a.address = u.to_address),
sn AS (SELECT to_address AS anchor_address, from_address AS address, count(*) AS repeated, max(t) AS last, count(DISTINCT t // 86400) AS days, sum(amount) AS units FROM ob WHERE covered GROUP BY 1,2),
inf AS (SELECT to_address AS address, from_address AS payer, min(t) AS ft FROM us GROUP BY 1,2),
fd AS (SELECT anchor_address, s.address, count(*) AS n FROM sn s JOIN inf i ON i.address = s.address AND i.ft < s.last GROUP BY 1,2)"""


def _neighbours(spark, sf):
    events = src.ledger(spark, sf).withColumn("event_index", F.col("line"))
    at = lambda s: F.timestamp_seconds(F.lit(src.EPOCH + s))
    return att.neighbourhood(events, _anchors(spark, sf), at(0), at(300000), F.length("address") != 3)


@query("neighborhood_candidates", sql(LEDGER, LABELS, _ANCHORS, _NEIGH, body="""
SELECT anchor_address, s.address, repeated, days, CAST(units AS VARCHAR) AS units, coalesce(n,0) AS distinct_senders,
 CASE WHEN length(s.address) = 3 THEN 'unresolved_candidate_relationship' WHEN repeated>=2 AND coalesce(n,0)>=2 THEN 'collection_candidate'
  WHEN repeated>=2 THEN 'service_neighbor_candidate' ELSE 'deposit_candidate' END AS relationship
FROM sn s LEFT JOIN fd USING (anchor_address, address)"""))
def _(spark, sf):
    found, _context = _neighbours(spark, sf)
    return found.select("anchor_address", "address", "repeated", "days", "units", "distinct_senders", "relationship")


@query("neighborhood_excluded", sql(LEDGER, body=f"""
, rep AS (SELECT * FROM ledger UNION ALL SELECT * FROM ledger WHERE order_key % 13 = 0),
why AS (SELECT event_reference, CASE WHEN part_key % 9 = 0 THEN 'different_network_or_asset' WHEN t NOT BETWEEN {src.EPOCH} AND {src.EPOCH + 300000} THEN 'outside_window'
 WHEN amount <= 0 OR confirmation_state = 'removed' THEN 'no_value_or_removed' WHEN order_key % 8 = 0 THEN 'failed_execution' WHEN ordering_ambiguous THEN 'order_unknown' END AS reason FROM rep)
SELECT reason, CAST(count(*) AS BIGINT) AS excluded FROM why WHERE reason IS NOT NULL GROUP BY 1
UNION ALL SELECT 'repeated_event', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) - 1 AS n FROM why WHERE reason IS NULL GROUP BY event_reference HAVING count(*) > 1)""".lstrip()))
def _(spark, sf):
    """Why observations around the anchors do not count, over a collection with repeated and foreign rows."""
    rows = src.ledger(spark, sf)
    events = rows.unionByName(rows.filter("order_key % 13 = 0")).withColumn("event_index", F.col("line")).withColumn(
        "token_contract", F.expr("CASE WHEN part_key % 9 = 0 THEN 'other' ELSE token_contract END")
    ).withColumn("execution_status", F.expr("CASE WHEN order_key % 8 = 0 THEN 'failed' ELSE execution_status END"))
    at = lambda s: F.timestamp_seconds(F.lit(src.EPOCH + s))
    return att.excluded_observations(events, "n0", "a0", at(0), at(300000))


@query("neighborhood_context", sql(LEDGER, LABELS, _ANCHORS, _NEIGH, body="""
SELECT from_address AS address, to_address AS anchor_address, event_reference FROM ob WHERE NOT covered"""))
def _(spark, sf):
    return _neighbours(spark, sf)[1]
