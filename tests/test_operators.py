"""Cases the registered queries do not reach."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rivermark.operators import forest, monitor, patterns, resources, transfers
from rivermark.operators.registry_review import invalid_reviewer
from rivermark.sources import bundles, events
from rivermark.streaming import watch


def test_conflicting_copies_drop_the_event(spark):
    cols = "g string, event_reference string, from_address string, to_address string, amount_base_units string, block_time long, token_contract string, tx_hash string, execution_status string, confirmation_state string"
    ok = ("success", "confirmed")
    rows = [("g", "a", "x", "y", "5", 1, "t", "h", *ok), ("g", "a", "x", "y", "5", 1, "t", "h", *ok), ("g", "b", "x", "y", "5", 1, "t", "h", *ok),
            ("g", "b", "x", "y", "6", 1, "t", "h", *ok), ("g", "c", "x", "y", "0", 1, "t", "h", *ok), ("g", None, "x", "y", "5", 1, "t", "h", *ok),
            ("g", "d", "x", None, "5", 1, "t", "h", *ok), ("g", "e", "x", "y", "5", 1, "t", "h", "unknown", "confirmed")]
    df = spark.createDataFrame(rows, cols)
    assert [r.event_reference for r in transfers.verified_events(df, ["g"]).collect()] == ["a"]
    got = {r.reason: r.n for r in transfers.excluded_event_counts(df, ["g"]).collect()}
    assert got == {"duplicate_event": 1, "conflicting_event_identity": 1, "non_positive_or_inexact_amount": 1,
                   "missing_event_identity": 1, "missing_participant": 1, "execution_or_finality_unverified": 1}


def test_triage_counts_each_rule_once(spark):
    df = spark.createDataFrame([("t", "fan_in"), ("t", "fan_in"), ("t", "rapid_forwarding"), ("u", "cyclic_topology")], "t string, rule string")
    got = {r.t: (r.score, r.priority) for r in patterns.triage_score(df, ["t"]).collect()}
    assert got == {"t": (35, "medium"), "u": (5, "low")}


def test_self_loop_is_a_cycle(spark):
    df = spark.createDataFrame([("a", "x", "x"), ("b", "x", "y"), ("c", "x", "y"), ("c", "y", "z"), ("c", "z", "x"), ("c", "q", "x")], "g string, from_address string, to_address string")
    got = {r.g: r.has_directed_cycle for r in patterns.cyclic_topology(df, ["g"]).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_forest_isolates_a_planted_outlier_and_ignores_partitioning(spark):
    rows = [(f"r{i}", float(i % 10), float(i % 7)) for i in range(300)] + [("odd", 500.0, -400.0)]
    df = spark.createDataFrame(rows, "id string, x double, y double")

    def ranked(parts):
        d = df.repartition(parts)
        s = forest.cut(forest.sample(d, "id", 20, 3))
        splits = forest.grow(s, ["x", "y"], 3)
        return splits, forest.rank(forest.score(d, splits, s, ["x", "y"]), "id").select("id", "score", "rank", "is_outlier")

    s1, r1 = ranked(2)
    s2, r2 = ranked(5)
    first = r1.filter("rank = 1").first()
    assert first.id == "odd" and first.is_outlier
    assert sorted(r[0] for r in r1.select("rank").collect()) == list(range(1, 302))
    assert s1.exceptAll(s2).count() == 0
    assert {r.id: r["rank"] for r in r1.collect()} == {r.id: r["rank"] for r in r2.collect()}


def test_unknown_delegation_is_null(spark):
    rows = [("current_state", 100, None), ("current_state", 10, None), ("historical_operation", 0, 40), ("historical_operation", 0, 60)]
    df = spark.createDataFrame(rows, "basis string, observed_at long, operation_time long")
    assert [r.active for r in resources.active_at(df, F.lit(50)).collect()] == [None, True, True, False]


def test_reviewer_words(spark):
    rows = [("Aiyana Botha", False), ("the Assistant", True), ("AI", True), ("gpt-4", True), ("  ", True), (None, True), ("R. Modeller", False)]
    df = spark.createDataFrame(rows, "n string, want boolean")
    assert all(r.want == r.got for r in df.select("want", invalid_reviewer(F.col("n")).alias("got")).collect())


def test_fixture_and_scan(spark, tmp_path):
    doc = {"data_mode": "SYNTHETIC", "network": "tron", "events": [
        {"event_reference": "r1", "tx_hash": "h", "asset": {"token_contract": "c", "decimals": 6}, "from_address": "a", "to_address": "b",
         "amount_base_units": "7", "block_height": 5, "index_in_block": 1, "event_index": 2, "block_time": "2026-01-01T00:00:00Z"},
        {"event_reference": "r2", "tx_hash": "h", "asset": {"token_contract": "c", "decimals": 6}, "from_address": "b", "to_address": "c", "amount_base_units": "7"}]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    rows = {r.event_reference: r for r in events.read_fixture(spark, str(tmp_path)).collect()}
    assert rows["r1"].chain_sequence == "000000000005:000001:000002" and rows["r1"].execution_status == "success"
    assert rows["r2"].chain_sequence is None and rows["r2"].ordering_ambiguous
    at = lambda s: F.lit(dt.datetime(2026, 1, s, tzinfo=dt.UTC))
    got = events.transfer_scan(events.read_fixture(spark, str(tmp_path)), "b", "both", at(2), at(3))
    assert [r.event_reference for r in got.collect()] == ["r2"]
    doc["data_mode"] = "LIVE"
    (tmp_path / "f.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="LIVE"):
        events.read_fixture(spark, str(tmp_path)).collect()


def test_export_and_integrity(spark, tmp_path):
    df = spark.createDataFrame([("=1+1",), ("ok",), ("\tx",), (" -2",), (None,)], "c string")
    safe = [r.c for r in bundles.export_rows_safe(df).collect()]
    assert safe == ["'=1+1", "ok", "'\tx", "' -2", ""]
    path = tmp_path / "run1"
    manifest = bundles.export(spark, df.coalesce(1), str(path)).withColumn("run_id", F.lit("run1")).collect()
    frame = spark.createDataFrame(manifest)
    files = lambda: bundles.read_files(spark, str(path)).filter(F.col("file").endswith(".csv"))
    assert bundles.integrity(bundles.verify_manifests(frame, files())).first().intact
    stale = frame.withColumn("expected", F.lit("other"))
    assert bundles.verify_manifests(stale, files()).first().status == "mismatch"
    lost = frame.withColumn("file", F.lit("lost.csv"))
    assert sorted(r.status for r in bundles.verify_manifests(lost, files()).collect()) == ["missing", "unlisted"]


def test_stream_reread_retraction_and_restart(spark, tmp_path):
    schema = ("network_key string, token_contract string, event_reference string, event_kind string, from_address string, to_address string,"
              " amount_base_units string, execution_status string, confirmation_state string, block_time timestamp, poll_time timestamp")
    t = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    row = lambda ref, ex, conf, p: ("n", "a", ref, "transfer", "w", "x", "5", ex, conf, t(0), t(p))
    watches = spark.createDataFrame([("v", "w", "n", "a", t(0))], "watch_id string, watch_address string, watch_network string, watch_contract string, baseline timestamp")
    polls = [[row("e1", "unknown", "provisional", 1), row("e2", "success", "confirmed", 1), row("e3", "failed", "confirmed", 1)],
             [row("e1", "success", "provisional", 2), row("e2", "success", "confirmed", 2)],
             [row("e1", "success", "confirmed", 3), row("e2", "success", "removed", 3)],
             [row("e2", "success", "removed", 4)]]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in polls:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        path = watch.run_once(stream, watches, out)
    got = sorted((r.event_reference, r.poll_time.second, r.change, r.state, r.confirmation_state) for r in watch.changes(spark, path).collect())
    assert got == [
        ("e1", 1, "opened", "active", "provisional"), ("e1", 2, "status_changed", "active", "provisional"), ("e1", 3, "status_changed", "active", "confirmed"),
        ("e2", 1, "opened", "active", "confirmed"), ("e2", 3, "retracted", "retracted", "removed"),
    ]
    batch = spark.read.schema(schema).parquet(src)
    states = monitor.alert_states(monitor.watched(batch, watches))
    assert sorted((r.event_reference, r.poll_time.second, r.change) for r in states.collect()) == [g[:3] for g in got]


def test_stream_over_many_batches_equals_a_replay(spark, tmp_path, monkeypatch):
    """Random histories in five polls, two micro-batches each, one poll too late, with full copies in between."""
    import random

    monkeypatch.setattr(watch, "COMPACT", 4)
    schema = ("network_key string, token_contract string, event_reference string, event_kind string, from_address string, to_address string,"
              " amount_base_units string, execution_status string, confirmation_state string, block_time timestamp, poll_time timestamp")
    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    r = random.Random(5)
    watches = spark.createDataFrame([(f"v{k}", f"w{k % 3}", "n", "a", t(0)) for k in range(4)], "watch_id string, watch_address string, watch_network string, watch_contract string, baseline timestamp")
    polls = [[("n", r.choice("aab"), f"e{k}", "transfer", f"w{k % 5}", f"w{k * 7 % 5}", "5", r.choice(["unknown", "success", "success", "failed", "reverted"]),
               r.choice(["unknown", "provisional", "confirmed", "confirmed", "removed"]), t(1), t(p * 100)) for k in range(60) if r.random() < 0.7] for p in range(5)]
    order = [0, 1, 3, 2, 4]  # at an overlap of 50 s the poll in place four is late
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for p in order:
        spark.createDataFrame(polls[p], schema).repartition(2).write.mode("append").parquet(src)
    path = watch.run_once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), watches, out, 50)
    late = [row for row in polls[2]]
    whole = spark.createDataFrame([row for p in order if p != 2 for row in polls[p]], schema)
    want = monitor.alert_history(monitor.watched(whole, watches)).filter("change IS NOT NULL")
    key = lambda df: sorted((x.watch_id, x.event_reference, x.poll_time, x.change, x.state, x.execution_status, x.confirmation_state) for x in df.collect())
    assert len(list((tmp_path / "out" / "state").iterdir())) == 10 and key(watch.changes(spark, path)) == key(want)
    counts = {}
    for row in late:
        for k in range(4):
            counts[f"v{k}"] = counts.get(f"v{k}", 0) + (f"w{k % 3}" in row[4:6])
    assert {x.watch_id: x.late for x in watch.late(spark, path).collect()} == {k: n for k, n in counts.items() if n}


def test_whole_words_and_whole_hooks(spark):
    """A foreign domain behind high digits is no match, and hook bytes count to the last one."""
    from rivermark.operators import bridge
    from rivermark.sources.chainlogs import hex_number, word

    data = spark.createDataFrame([("0x" + "f" * 10 + "0" * 53 + "6",), ("0x" + "0" * 63 + "6",)], "d string")
    assert [r[0] for r in data.select(hex_number(word(F.col("d")))).collect()] == [None, 6]
    fixed = "0" * (2 * 376)
    pair = spark.createDataFrame([(fixed + "a" * 1_000_001 + "b", fixed + "a" * 1_000_001 + "c")], "x string, y string")
    assert not pair.select(bridge.immutable(F.col("x")) == bridge.immutable(F.col("y"))).first()[0]


def test_provider_cap_keeps_whole_providers(spark):
    from rivermark.operators import resources

    held = [("s1", "energy"), ("s1", "bandwidth"), ("s1", None), ("s2", "energy"), ("s3", "energy")]
    rows = spark.createDataFrame([(s, "w", r) for s, r in held], "sponsor string, receiver string, resource string")
    who = spark.createDataFrame([("w",)], "candidate_address string")
    for cap, n, cut in ((1, 3, True), (2, 4, True), (3, 5, False)):
        got = resources.resource_current_rows(rows, who, cap).collect()
        assert len(got) == n and all(r.truncated_by_provider_limit == cut for r in got)


def test_star_schema_keeps_unequal_events(spark):
    from rivermark.sources import bundles

    names = "network_key string, event_reference string, tx_hash string, token_contract string, from_address string, to_address string, amount_base_units string, ordering_ambiguous boolean, event_index long"
    rows = [("n", f"r{k}", "t", "c", "a", "b", "1", False, k) for k in range(50)] + [("n", "r1", "t", "c", "a", "b", "2", False, 1)]
    star = bundles.star_schema(spark.createDataFrame(rows, names))
    facts = star["events"].collect()
    assert len(facts) == 50 and {len(r.event_key) for r in facts} == {64}
    assert [r.amount_base_units for r in facts].count("2") == 0


def test_neighbourhood_of_a_hub_counts_without_pairs(spark, monkeypatch):
    """Many payers and candidates around one wallet: running counts equal a plain count, in small cells too."""
    from rivermark import scale
    from rivermark.operators import attribution as att

    monkeypatch.setattr(scale, "HOT_ROWS", 5)
    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    names = ("network_key string, event_reference string, from_address string, to_address string, amount_base_units string, block_time timestamp,"
             " event_kind string, execution_status string, confirmation_state string, ordering_ambiguous boolean, event_index int, token_contract string")
    rows = [("n", f"p{k}", f"payer{k % 90}", "hub", "1", t(k * 61 % 20000), "transfer", "success", "confirmed", False, 1, "a") for k in range(300)]
    rows += [("n", f"s{k}", "hub", f"anchor{k % 3}", "1", t(k * 900), "transfer", "success", "confirmed", False, 1, "a") for k in range(20)]
    rows.append(("n", "s1", "hub", "anchor9", "1", t(3), "transfer", "success", "confirmed", False, 1, "a"))  # a copy that differs
    anchors = spark.createDataFrame([("n", f"anchor{k}", "X", None, None) for k in range(3)], "network_key string, address string, entity_name string, valid_from timestamp, valid_to timestamp")
    got, _ = att.neighbourhood(spark.createDataFrame(rows, names), anchors, F.lit(t(0)), F.lit(t(50000)), F.lit(True))
    firsts = {}
    for r in rows[:300]:
        firsts[r[2]] = min(firsts.get(r[2], r[5]), r[5])
    want = {}
    for a in range(3):
        last = max(t(k * 900) for k in range(20) if k % 3 == a)
        want[f"anchor{a}"] = sum(f < last for f in firsts.values())
    assert {r.anchor_address: r.distinct_senders for r in got.collect()} == want


def test_snapshot_digest_does_not_depend_on_partitions(spark, monkeypatch):
    from rivermark.operators import dataset as ds

    rows = spark.range(3000).selectExpr("concat('w', id % 700) AS wallet_id", "id * 10 AS window_start", "id * 10 + 10 AS window_end", "'v' AS feature_version")
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit("v").alias(c) for c in ds.KEY])
    one = ds.snapshot_hash(rows.coalesce(1)).first().snapshot_sha256
    assert one == ds.snapshot_hash(rows.repartition(7).unionByName(rows.limit(100))).first().snapshot_sha256
    assert one != ds.snapshot_hash(rows.filter("window_start > 0")).first().snapshot_sha256
    monkeypatch.setattr(ds, "FAN", 4)  # several levels
    assert ds.snapshot_hash(rows).first().snapshot_sha256 == ds.snapshot_hash(rows.repartition(9)).first().snapshot_sha256
    assert len(ds.snapshot_hash(rows.limit(0)).first().snapshot_sha256) == 64
