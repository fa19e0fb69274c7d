"""The forward trace on small hand-made ledgers, and against a plain queue walk."""

import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from rivermark import scale
from rivermark.operators import trace as tr

EVENT = (
    "network_key string, token_contract string, event_reference string, event_kind string, from_address string,"
    " to_address string, amount_base_units string, execution_status string, confirmation_state string, t long,"
    " chain_sequence string, ordering_ambiguous boolean"
)
CLAIM = (
    "network_key string, address string, entity_name string, entity_type string, assertion_type string, address_role string,"
    " review_state string, source_reference string, f long, u long, row_no long"
)
END = 10_000


def ev(ref, a, b, t, seq="", amount="5", kind="transfer", ex="success", conf="confirmed", vague=False):
    s = None if seq is None else (seq or f"{t:06d}:{ref}")
    return ("n", "a", ref, kind, a, b, amount, ex, conf, t, s, vague)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT).withColumn("block_time", F.timestamp_seconds("t")).drop("t")


def claims(spark, rows):
    df = spark.createDataFrame(rows, CLAIM)
    return df.withColumn("valid_from", F.timestamp_seconds("f")).withColumn("valid_to", F.timestamp_seconds("u"))


def label(address, name="X", kind="service_control", state="accepted", f=None, u=None, n=1, role="deposit"):
    return ("n", address, name, "exchange", kind, role, state, f"s{n}", f, u, n)


def run(spark, rows, labels=(), ref="s", hops=8, budget=5000, address="A"):
    seeds = spark.createDataFrame([("t", "n", "a", address, ref)], "trace_id string, network_key string, token_contract string, seed_address string, seed_event_reference string")
    return tr.trace(seeds, events(spark, rows), claims(spark, list(labels)), F.timestamp_seconds(F.lit(END)), hops, budget)


def refs(t):
    return {r.event_reference: r.hop_depth for r in t.observed.collect()}


def ends(t):
    return {(r.address, r.endpoint_class, r.boundary_reason, ">".join(r.branch_path)) for r in t.endings.collect()}


def codes(t):
    return {(r.code, r.event_reference) for r in t.limitations.collect()}


def test_earlier_event_does_not_continue_and_unordered_tie_is_reported(spark):
    t = run(spark, [ev("s", "A", "B", 10, "10:1"), ev("early", "B", "C", 5), ev("tie", "B", "D", 10, None), ev("later", "B", "E", 10, "10:2")])
    assert refs(t) == {"s": 0, "later": 1}
    assert codes(t) == {("ambiguous_ordering", "tie")}
    assert t.header.first().coverage_status == "partial"


def test_later_receipt_cycle_and_reconvergence(spark):
    t = run(spark, [
        ev("s", "A", "B", 1), ev("x", "B", "C", 2), ev("y", "B", "D", 3), ev("z", "C", "E", 4), ev("w", "D", "E", 5),
        ev("tail", "E", "F", 6), ev("back", "F", "B", 7), ev("again", "B", "G", 8),
    ])
    assert refs(t) == {"s": 0, "x": 1, "y": 1, "again": 1, "z": 2, "w": 2, "tail": 3, "back": 4}
    got = ends(t)
    assert ("E", "unresolved", None, "s>y>w") in got
    assert ("B", "unresolved", None, "s>x>z>tail>back") in got
    assert ("G", "unresolved", "no_outgoing_activity", "s>again") in got


def test_what_does_not_carry_value(spark):
    t = run(spark, [
        ev("s", "A", "B", 1), ev("ap", "B", "C", 2, kind="approval"), ev("fail", "B", "C", 3, ex="failed"), ev("gone", "B", "C", 4, conf="removed"),
        ev("zero", "B", "C", 5, amount="0"), ev("unk", "B", "C", 6, ex="unknown"), ev("s", "A", "B", 1),
    ])
    assert refs(t) == {"s": 0}
    assert codes(t) == {("execution_or_finality_unverified", "unk")}


def test_events_without_time_go_by_sequence(spark):
    t = run(spark, [
        ev("s", "A", "B", 10, "010"), ev("e0", "B", "D", None, "005"), ev("e1", "B", "C", None, "020"), ev("e2", "C", "E", 50, "050"),
        ev("e3", "C", "F", 5, "015"), ev("e4", "E", "B", 60, "060"), ev("e5", "B", "G", None, "070"),
    ])
    assert refs(t) == {"s": 0, "e1": 1, "e2": 2, "e4": 3, "e5": 1}


def test_labels(spark):
    rows = [ev("s", "A", "B", 1), ev("x", "B", "C", 2), ev("y", "C", "D", 3), ev("z", "D", "E", 4)]
    assert ("C", "known_service", "service_boundary", "s>x") in ends(run(spark, rows, [label("C")]))
    for lab in ([label("C", f=100)], [label("C", u=1)], [label("C", state="unreviewed")], [label("C", state="rejected")]):
        assert "y" in refs(run(spark, rows, lab))
    single = run(spark, rows, [label("C", f=2, u=2)])
    assert "y" not in refs(single)
    clash = run(spark, rows, [label("C"), label("C", name="Other", n=2)])
    assert "y" in refs(clash) and ("conflicting_service_labels", None) in codes(clash)
    same = run(spark, rows, [label("C"), label("C", name=" x ", n=2)])
    assert "y" not in refs(same)
    lead = run(spark, rows, [label("C", kind="deposit_candidate", state="unreviewed")])
    assert ("C", "deposit_candidate", None, "s>x") in ends(lead) and "y" in refs(lead)


def test_hop_limit_comes_before_the_label(spark):
    rows = [ev("s", "A", "B", 1), ev("x", "B", "C", 2)]
    assert ends(run(spark, rows, [label("C")], hops=1)) == {("C", "boundary", "hop_limit", "s>x")}


def test_seed_gate(spark):
    bad = run(spark, [ev("s", "A", "B", 1, ex="unknown"), ev("x", "B", "C", 2)])
    assert refs(bad) == {} and codes(bad) == {("seed_not_verified", "s")}
    assert bad.header.first().case_flow_linkage == "not_established"
    gone = run(spark, [ev("x", "B", "C", 2)])
    assert gone.header.first().state == "unavailable"
    found = run(spark, [ev("x", "A", "C", 2), ev("y", "C", "D", 3)], ref=None)
    assert refs(found) == {"x": 1, "y": 2}


def queue_walk(rows, seed, hops, budget, stops):
    """One trace the slow way: a queue, one state at a time."""
    out = {}
    for r in rows:
        out.setdefault(r[4], []).append(r)
    pos = lambda r: (r[9], r[10] or "")
    first = next(r for r in rows if r[2] == seed)
    todo = deque([(first, 0, (seed,))])
    seen, claimed, examined, endings = {seed: 0}, set(), 0, set()
    while todo:
        state, hop, path = todo.popleft()
        if hop >= hops or examined >= budget:
            endings.add((state[5], "hop_limit" if hop >= hops else "event_limit", path))
            continue
        if state[5] in stops:
            endings.add((state[5], "service_boundary", path))
            continue
        nexts, merged = [], False
        for e in sorted((e for e in out.get(state[5], []) if e[9] >= state[9]), key=lambda e: (*pos(e), e[2])):
            examined += 1
            if pos(e) <= pos(state):
                continue
            seen.setdefault(e[2], hop + 1)
            if e[2] in claimed:
                merged = True
                continue
            claimed.add(e[2])
            nexts.append((e, hop + 1, (*path, e[2])))
        if not nexts:
            endings.add((state[5], None if merged else "no_outgoing_activity", path))
        todo.extend(nexts)
    return seen, endings


@pytest.mark.parametrize("case,budget,hops", [(1, 5000, 8), (2, 25, 4), (4, 40, 8), (5, 1, 4)])
def test_equals_a_queue_walk(spark, case, budget, hops):
    same_as_queue_walk(spark, case, budget, hops)


def same_as_queue_walk(spark, case, budget, hops):
    r = random.Random(case)
    rows = [ev("s", "w0", "w1", 0, "0")]
    for i in range(140):
        rows.append(ev(f"e{i:03d}", f"w{r.randrange(14)}", f"w{r.randrange(14)}", r.randrange(60), r.choice(["", None, f"{r.randrange(50):03d}"])))
    stops = {"w5", "w9"}
    seen, endings = queue_walk(rows, "s", hops, budget, stops)
    t = run(spark, rows, [label(a, n=i) for i, a in enumerate(stops)], hops=hops, budget=budget, address="w0")
    assert refs(t) == seen
    assert {(r.address, r.boundary_reason, tuple(r.branch_path)) for r in t.endings.collect()} == endings


@pytest.mark.parametrize("case,budget,hops", [(7, 60, 8)])
def test_equals_a_queue_walk_through_buckets(spark, monkeypatch, case, budget, hops):
    """Nothing fits a broadcast and every wallet is hot."""
    from rivermark import scale

    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(scale, "HOT_ROWS", 3)
    same_as_queue_walk(spark, case, budget, hops)


def test_the_ledger_is_written_once_and_not_shuffled_again(spark, monkeypatch):
    from rivermark import scale

    rows = spark.range(2000).selectExpr("id % 40 AS w", "id AS t", "concat('e', id) AS ref", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 40 END AS h")
    rows = rows.selectExpr("h AS w", "t", "ref")
    other = spark.range(20).selectExpr("id AS w", "id * 3 AS x")
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(scale, "HOT_ROWS", 100)
    laid = scale.Laid(rows, ["w"], ["t"], "ref")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = laid.join(other)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert laid.any_hot and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted(joined.collect()) == sorted(rows.join(other, "w").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    deals = spark.table(laid.name).filter("w = 7").select("_deal").distinct().count()
    assert deals == laid.hot.filter("w = 7").first()._deals > 4
    laid.drop()
    assert not spark.catalog.tableExists(laid.name)


def test_many_traces_and_hot_cells_agree(spark, monkeypatch):
    from rivermark import scale
    from rivermark.plans.traces import traces

    def shape():
        t = traces(spark, "/root/testdata/sf0.001", 2)
        return (sorted(map(tuple, t.observed.select("trace_id", "event_reference", "hop_depth").collect())),
                sorted(map(str, t.endings.select("trace_id", "address", "boundary_reason", "branch_path").collect())))

    plain = shape()
    monkeypatch.setattr(scale, "HOT_ROWS", 3)
    assert shape() == plain


@pytest.mark.parametrize("address,t,state,linkage", [
    ("A", 10, "followed", "established"), ("Z", 10, "unavailable", "not_established"), ("A", END + 40, "unavailable", "not_established"),
])
def test_seed_lookup_stays_in_window_and_wallet(spark, address, t, state, linkage):
    got = run(spark, [ev("s", "A", "B", t), ev("x", "B", "C", t + 1)], address=address)
    row = got.header.first()
    assert (row.state, row.case_flow_linkage) == (state, linkage)
    assert bool(refs(got)) == (state == "followed")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_many_seeds_are_not_copied(spark, monkeypatch):
    from rivermark import scale

    rows = events(spark, [ev(f"e{k}", "A", "B", k) for k in range(1, 9)])
    seeds = rows.selectExpr("concat('q', event_reference) AS trace_id", "network_key", "token_contract", "from_address AS seed_address",
                            "CASE WHEN event_reference <> 'e3' THEN event_reference END AS seed_event_reference")
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    got = tr.locate_seeds(seeds, tr.prepare(rows), F.timestamp_seconds(F.lit(END)))
    assert "_salt" not in _plan(got)[0]
    assert {r.trace_id: r.state for r in got.collect()} == {f"qe{k}": "discovery" if k == 3 else "followed" for k in range(1, 9)}


def test_the_outlook_moves_the_events_once(spark):
    from rivermark.operators.labels import claims_by_address

    slim = tr.prepare(events(spark, [ev("s", "A", "B", 10), ev("x", "B", "C", 20), ev("y", "B", "D", 10), ev("z", "C", "A", 30, ex="failed")])).localCheckpoint()
    folded = claims_by_address(claims(spark, [])).localCheckpoint()
    told = tr._with_outlook(slim, folded, True, F.timestamp_seconds(F.lit(END)), True, False)
    assert _plan(told)[1].count("Exchange hashpartitioning(network_key") == 1
    seen = {r.event_reference: (r.looked, r.follow) for r in told.collect()}
    slow = tr._with_outlook(slim, folded, True, F.timestamp_seconds(F.lit(END)), False, False)
    assert seen == {r.event_reference: (r.looked, r.follow) for r in slow.collect()}
    assert seen["s"] == (2, 2) and seen["x"] == (1, 0) and seen["z"] == (None, None)


def test_a_walk_keeps_no_copies_of_its_rows(spark, tmp_path):
    """States past the budget are read where the events of their level were written."""
    rows = [ev("s", "A", "B", 10)] + [ev(f"x{k}", "B", f"C{k}", 20 + k) for k in range(50)]
    got = run(spark, rows, budget=3)
    late = got.endings.filter("boundary_reason = 'event_limit'")
    assert late.count() == 50
    assert "FileScan parquet" in _plan(late)[1] and "Scan ExistingRDD" not in _plan(late)[1]


def test_rows_of_one_identity_are_the_only_ones_grouped(spark):
    rows = [ev("s", "A", "B", 10), ev("x", "B", "C", 20), ev("x", "B", "D", 20), ev("y", "B", "D", 30), ev("y", "B", "D", 30), ev(None, "B", "E", 40), ev(None, "B", "E", 50)]
    for some in (rows, rows[:2]):
        table = events(spark, some)
        assert sorted(map(str, tr.prepared(table).collect())) == sorted(map(str, tr.prepare(table).collect()))
    # Without copies nothing is moved once the events are written.
    assert "Exchange" not in tr.prepared(events(spark, rows[:2]))._jdf.queryExecution().toString()


def test_departures_are_not_moved_to_their_arrivals(spark):
    """Spans and the common order of arrivals and departures name the same parents, claims and ties."""
    r = random.Random(11)
    rows = [ev(f"e{i:03d}", f"w{r.randrange(6)}", f"w{r.randrange(6)}", r.randrange(30), r.choice(["", None, f"{r.randrange(30):03d}"]),
               ex=r.choice(["success", "success", "unknown"])) for i in range(90)]
    cutoff = F.timestamp_seconds(F.lit(END))
    edges = tr.prepare(events(spark, rows)).localCheckpoint()
    laid = scale.Laid(edges, ["network_key", "token_contract", "from_address"], ["block_time"], "event_reference", True)
    kind = "trace_id string, network_key string, token_contract string, address string, t long, at_seq string, place long, total long, branch_path array<string>"
    state = lambda k: (f"t{k % 3}", "n", "a", f"w{r.randrange(6)}", r.randrange(25), f"{r.randrange(30):03d}", k, 0, [f"p{k}"])
    live = spark.createDataFrame([state(k) for k in range(40)], kind).withColumn("at", F.timestamp_seconds("t")).drop("t").localCheckpoint()
    claimed = tr._claimed(spark.createDataFrame([state(k) for k in range(9)], kind).withColumn("at", F.timestamp_seconds("t")), None)

    def told(rows):
        fresh = F.col("spendable") & F.col("parent").isNotNull() & ~F.col("taken")
        kept = rows.filter(fresh | F.col("unverified") | F.col("tied"))
        return sorted(map(str, kept.select("trace_id", "event_reference", F.when(fresh, F.col("parent.place")), "tied", "unverified").collect()))

    touch = tr._touched(live, laid, cutoff, False, claimed).filter("unverified OR (spendable AND (unordered OR NOT taken))")
    spans = tr._followed(live, laid, cutoff, False, claimed)
    assert told(spans) == told(tr._continued(live, touch, True, False)) == told(tr._followed(live, laid, cutoff, True, claimed))
    assert len(told(spans)) > 100
    laid.drop()


def test_a_crowded_wallet_is_walked_in_one_order(spark, monkeypatch):
    monkeypatch.setattr(tr, "CROWD", 0)
    same_as_queue_walk(spark, 2, 25, 4)


def test_states_past_the_budget_are_not_joined(spark):
    """Only expanded states meet the parents that go on, and every other ending is one read of its level."""
    rows = [ev("s", "A", "B", 10)] + [ev(f"x{k}", "B", f"C{k}", 20 + k) for k in range(6)] + [ev("y", "C0", "D", 90)]
    got = run(spark, rows, budget=7, hops=4)
    plan = _plan(got.endings)[0]
    joins = plan.count("Join LeftOuter")
    assert 0 < joins <= 2 and "LeftAnti" not in plan
    assert {(a, r) for a, _, r, _ in ends(got)} == {("C1", "event_limit"), ("C2", "event_limit"), ("C3", "event_limit"), ("C4", "event_limit"), ("C5", "event_limit"), ("D", "event_limit")}


def test_a_digest_moves_its_values_once(spark):
    from rivermark.operators.patterns import digest_of

    import hashlib

    rows = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "a"), ("m", None), ("m", "c")], "k string, v string")
    out = digest_of(rows, ["k"], "v")
    assert _plan(out)[1].count("Exchange hashpartitioning") == 2
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    of = lambda vs: sha("|".join(sha(v) for v in sorted(vs, key=lambda v: sha(v)[:3])))
    got = {r.k: (r.n, r.digest) for r in out.collect()}
    assert got["k"] == (2, of(["a", "b"])) and got["m"] == (2, sha(sha("") + "|" + sha("c")))


def test_events_off_the_paths_are_left_behind(spark):
    from rivermark.operators.attribution import path_check

    got = run(spark, [ev("s", "A", "B", 10), ev("x", "B", "C", 20), ev("y", "C", "D", 30)], [label("D")])
    checked = path_check(got.endings, got.observed, got.header)
    assert "LeftSemi" in _plan(checked)[0] and "branch_path" not in str([l for l in _plan(checked)[0].splitlines() if "min(struct" in l])
    assert [(r.address, r.path_problem) for r in checked.collect()] == [("D", None)]


def test_only_levels_stay_written(spark):
    folder = scale.shared_folder(spark).removeprefix("file:")
    before, tables, passing = set(os.listdir(folder)), {t.name for t in spark.catalog.listTables()}, []
    rows = [ev("s", "A", "B", 1), ev("x", "B", "C", 2), ev("y", "C", "D", 3), ev("y", "C", "D", 3), ev("z", "D", "E", 4), ev("u", "D", "E", 5, ex="unknown")]
    ledger = tr.written(events(spark, rows), passing=passing)
    seeds = spark.createDataFrame([("t", "n", "a", "A", "s")], "trace_id string, network_key string, token_contract string, seed_address string, seed_event_reference string")
    t = tr.trace(seeds, ledger, claims(spark, []), F.timestamp_seconds(F.lit(END)), passing=passing)
    assert refs(t) == {"s": 0, "x": 1, "y": 2, "z": 3} and ("execution_or_finality_unverified", "u") in codes(t)
    left = [f for f in set(os.listdir(folder)) - before if f.startswith(("staged-", "rivermark_"))]
    full = [f for f in left if any(n.endswith(".parquet") for n in os.listdir(f"{folder}/{f}"))]
    held = [set(spark.read.parquet(f"{folder}/{f}").columns) for f in full]
    # What departures were found and who was expanded at each level; no events, outlook or claims.
    assert held and all("hop_depth" in c or "place" in c for c in held)
    assert {t.name for t in spark.catalog.listTables()} - tables <= set(left)


def test_departures_that_are_only_counted_are_not_laid_out(spark, monkeypatch):
    laid = []

    class Seen(tr.Laid):
        def __init__(self, df, *more):
            laid.append(sorted(r.event_reference for r in df.collect()))
            super().__init__(df, *more)

    monkeypatch.setattr(tr, "Laid", Seen)
    rows = [
        ev("s", "A", "B", 1), ev("x", "B", "C", 2), ev("ap", "B", "C", 2, kind="approval"), ev("gone", "B", "C", 4, conf="removed"),
        ev("zero", "B", "C", 5, amount="0"), ev("bad", "B", "C", 5, amount=None), ev("unk", "B", "C", 6, ex="unknown"),
    ]
    t = run(spark, rows)
    assert laid == [["s", "unk", "x"]] and refs(t) == {"s": 0, "x": 1}
    assert t.header.first().events_examined == 6
    # A seed is found among all events, and an address looks at all of them.
    assert run(spark, rows, ref="ap", address="B").header.first().state == "rejected"
    assert run(spark, rows, ref=None, address="B").header.first().events_examined == 6


def test_claims_of_traces_that_ended_go(spark):
    kind = "trace_id string, address string, t long, at_seq string"
    at = lambda rows: spark.createDataFrame(rows, kind).withColumn("at", F.timestamp_seconds("t"))
    alive = spark.createDataFrame([("t1",), ("t3",)], "trace_id string")
    first = tr._claimed(at([("t1", "a", 5, "x"), ("t2", "a", 4, "x"), ("t1", "a", 3, "y")]), None, None, alive, True)
    assert [(r.trace_id, r.timed_seq) for r in first.collect()] == [("t1", "x")]
    later = tr._claimed(at([("t1", "a", 1, "z"), ("t3", "b", 2, "z")]), first, None, alive.filter("trace_id = 't3'"), False)
    assert [(r.trace_id, r.address) for r in later.collect()] == [("t3", "b")]


def test_states_and_claims_meet_where_they_lie(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    kind = "trace_id string, network_key string, token_contract string, address string, t long, at_seq string, place long, total long, branch_path array<string>"
    rows = spark.createDataFrame([(f"t{k % 3}", "n", "a", "w", k, "", k, 0, [f"p{k}"]) for k in range(9)], kind).withColumn("at", F.timestamp_seconds("t"))
    live = scale.staged_by(tr._by_trace(rows), ["trace_id"])
    claimed = tr._claimed(live, None)
    with scale.by_some_keys(spark):
        spans = tr._spans(live, claimed)
        assert "Exchange" not in _plan(spans)[1] and "Bucketed: true" in _plan(spans)[1]
        # One order serves the spans and the claims they meet.
        assert spans.count() == 12
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_endings_of_a_large_level_are_written_once(spark, monkeypatch):
    """Reading endings joins the expanded states of small levels only, and both forms tell the same."""
    rows = [ev("s", "A", "B", 10)] + [ev(f"x{k}", "B", f"C{k}", 20 + k) for k in range(6)] + [ev("y", "C0", "D", 90), ev("z", "D", "E", 95)]
    labels = [label("C3"), label("C1", kind="deposit_candidate", state="unreviewed", n=2)]
    plain = run(spark, rows, labels)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    large = run(spark, rows, labels)
    assert ends(large) == ends(plain) and plain.endings.count() == large.endings.count()
    assert "Join" in _plan(plain.endings)[0] and "Join" not in _plan(large.endings)[0]


def test_saved_tables_that_many_queries_read_are_made_once(spark):
    from rivermark.plans import traces

    made = []
    t = traces.Saved(tr.Trace(*[spark.range(1)] * 4))
    for _ in range(2):
        out = t.once("state", lambda: made.append(1) or spark.range(3))
    assert made == [1] and out.count() == 3 and "FileScan parquet" in _plan(out)[1]


def test_checked_endings_are_read_once(spark):
    from rivermark.operators.attribution import path_check

    got = run(spark, [ev("s", "A", "B", 10), ev("x", "B", "C", 20)], [label("C")])
    scans = _plan(path_check(got.endings, got.observed, got.header))[0]
    asked = [line for line in scans.splitlines() if "Relation" in line and "boundary_reason" in line]
    # They and their steps come from what was written; no level is read again for them.
    assert asked and "service_boundary" not in scans


def test_only_edges_and_endings_of_seeds_are_grouped(spark):
    from rivermark.operators import flow

    got = run(spark, [ev("s", "A", "B", 10), ev("x", "B", "C", 20)], [label("B", kind="deposit_candidate", state="unreviewed")], budget=1, hops=1)
    missing = flow.derived_seed_edges(got.header, flow.flow_edges(got.observed.filter("hop_depth > 0")), got.endings)
    plan = _plan(missing)[0].splitlines()
    at = lambda word: [len(line) - len(line.lstrip(" :+-")) for line in plan if word in line]
    # What is kept lies below the grouping that follows.
    assert len(at("LeftSemi")) >= 2 and all(any(a < s for a in at("Aggregate [trace_id")) for s in at("LeftSemi"))
    assert [(r.event_reference, r.from_address, r.to_address) for r in missing.collect()] == [("s", "A", "B")]
