"""Wallet-window dataset, splits, forest and readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermark.operators import behaviour as beh
from rivermark.operators import dataset as ds
from rivermark.operators import forest as fo
from rivermark.operators.transfers import graph_features
from rivermark.plans.base import LEDGER, OBS, SPARSE, sql
from rivermark.plans.patterns import thin
from rivermark.registry import query
from rivermark.sources import tables as src

WEEK = 604_800
_WORTHY, _CONF, _NEG = ("cat0",), ("cat1",), ("cat2",)

FEATURES = {
    "observed_incoming_transfer_count": "incoming_count", "observed_outgoing_transfer_count": "outgoing_count",
    "distinct_incoming_counterparty_count": "incoming_counterparties", "distinct_outgoing_counterparty_count": "outgoing_counterparties",
    "observed_incoming_amount_base_units": "incoming_units", "observed_outgoing_amount_base_units": "outgoing_units",
    "outgoing_counterparties_with_repeat_count": "with_repeat", "repeated_forwarding_count": "repeated_forwarding_count",
    "ordering_ambiguous_observation_count": "ambiguous_order", "event_index_missing_count": "missing_index", "block_number_missing_count": "missing_block",
}


def windows(spark, sf):
    """Weekly evidence rows per user, with the behaviour features of each week."""
    week = F.expr(f"event_id * 0 + ({src.epoch_seconds('ts')}) div {WEEK}")
    stamp = src.table(spark, sf, "events").select("event_id", week.alias("week"))
    rows = src.observations(spark, sf).join(stamp, "event_id").withColumn("candidate_address", F.concat_ws("@", "candidate_address", "week"))
    wide = beh.behaviour_counts(rows).join(beh.repeat_counterparties(rows), "candidate_address", "left").join(beh.uncertainty_counts(rows), "candidate_address")
    part = F.split("candidate_address", "@")
    user = F.substring(part[0], 2, 20).cast("long")
    wide = wide.select(
        "*", F.lit("n0").alias("network"), part[0].alias("address"), (part[1].cast("long") * WEEK).alias("window_start"), ((part[1].cast("long") + 1) * WEEK).alias("window_end"),
        F.when(user % 4 == 3, "SYNTHETIC").otherwise("LIVE").alias("data_mode"), F.when(user % 5 != 0, F.concat(F.lit("cat"), user % 4)).alias("control_category"), F.lit("r1").alias("run_id"),
    )
    return ds.wallet_windows(wide, FEATURES)


_WIN = f"""ow AS (SELECT o.*, CAST(floor(epoch(e.ts)) AS BIGINT)//{WEEK} AS wk FROM obs o JOIN events e USING (event_id)),
cpw AS (SELECT user_id, wk, counterparty_address AS cp, count(*) AS n FROM ow WHERE direction='outgoing' AND counterparty_address IS NOT NULL GROUP BY 1,2,3),
win AS (SELECT substring(sha256('n0:u' || user_id),1,16) AS wallet_id, user_id, wk*{WEEK} AS window_start, (wk+1)*{WEEK} AS window_end,
 CASE WHEN user_id%4=3 THEN 'SYNTHETIC' ELSE 'LIVE' END AS data_mode, CASE WHEN user_id%5<>0 THEN 'cat' || (user_id%4) END AS control_category,
 CAST(count(*) FILTER (WHERE direction='incoming') AS DOUBLE) AS f_in, CAST(count(*) FILTER (WHERE direction='outgoing') AS DOUBLE) AS f_out,
 CAST(count(DISTINCT counterparty_address) FILTER (WHERE direction='incoming') AS DOUBLE) AS f_din, CAST(count(DISTINCT counterparty_address) FILTER (WHERE direction='outgoing') AS DOUBLE) AS f_dout,
 CAST(coalesce(sum(amount) FILTER (WHERE direction='incoming'),0) AS DOUBLE) AS f_ain, CAST(coalesce(sum(amount) FILTER (WHERE direction='outgoing'),0) AS DOUBLE) AS f_aout,
 any_value(rp) AS f_rep, any_value(mx) AS f_fwd, CAST(count(*) FILTER (WHERE ordering_ambiguous) AS DOUBLE) AS f_amb, CAST(count(*) FILTER (WHERE event_index IS NULL) AS DOUBLE) AS f_idx, CAST(count(*) FILTER (WHERE block_number IS NULL) AS DOUBLE) AS f_blk
 FROM ow LEFT JOIN (SELECT user_id, wk, CAST(count(*) FILTER (WHERE n>1) AS DOUBLE) AS rp, CAST(max(n) AS DOUBLE) AS mx FROM cpw GROUP BY 1,2) c USING (user_id, wk) GROUP BY user_id, wk)"""
_COLS = dict(zip(FEATURES, ["f_in", "f_out", "f_din", "f_dout", "f_ain", "f_aout", "f_rep", "f_fwd", "f_amb", "f_idx", "f_blk"], strict=True))
WIN = (OBS, _WIN)
_LONG = " UNION ALL ".join(f"SELECT wallet_id, window_start, window_end, user_id, 'behavioral_{n}' AS feature, {c} AS v FROM win" for n, c in _COLS.items())


@query("wallet_ids", "SELECT c_custkey AS k, substring(sha256('n0:w' || c_custkey),1,16) AS wallet_id FROM customer")
def _(spark, sf):
    return src.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), ds.wallet_id(F.lit("n0"), F.concat(F.lit("w"), "c_custkey")).alias("wallet_id"))


@query("wallet_windows", sql(*WIN, body=f"SELECT wallet_id, window_start, feature, v AS value, v IS NULL AS missing FROM ({_LONG})"))
def _(spark, sf):
    w = windows(spark, sf)
    pairs = w.select("wallet_id", "window_start", F.explode("features").alias("feature", "value"), "missingness")
    return pairs.select("wallet_id", "window_start", "feature", "value", F.col("missingness")[F.col("feature")].alias("missing"))


@query("feature_table", sql(*WIN, body="SELECT wallet_id, window_start, window_end, " + ", ".join(f"{c} AS behavioral_{n}" for n, c in sorted(_COLS.items())) + " FROM win"))
def _(spark, sf):
    return ds.feature_table(windows(spark, sf), ["behavioral_" + n for n in FEATURES])


_SPLIT = """gr AS (SELECT wallet_id, row_number() OVER (ORDER BY sha256('7:' || wallet_id)) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT wallet_id FROM win)),
sp AS (SELECT w.*, CASE WHEN p <= round_even(n*0.3, 0) THEN 'eval' ELSE 'train' END AS side FROM win w JOIN gr USING (wallet_id))"""


@query("split_by_wallet", sql(*WIN, _SPLIT, body="SELECT wallet_id, window_start, side FROM sp"))
def _(spark, sf):
    return ds.split_by_wallet(windows(spark, sf), 0.3, 7).select("wallet_id", "window_start", "side")


CUT = 1_705_276_800


@query("split_by_time", sql(*WIN, body=f"SELECT wallet_id, window_start, CASE WHEN window_start < {CUT} THEN 'train' ELSE 'eval' END AS side FROM win"))
def _(spark, sf):
    return ds.split_by_time(windows(spark, sf), F.lit(CUT)).select("wallet_id", "window_start", "side")


def _mixed(spark, sf):
    """A careless split: sides by a digest of wallet and window."""
    w = windows(spark, sf)
    h = F.substring(F.sha2(F.concat_ws(":", "wallet_id", "window_start"), 256), 1, 1)
    return w.withColumn("side", F.when(h < "8", "train").otherwise("eval"))


_MIX = "mix AS (SELECT *, CASE WHEN substring(sha256(wallet_id || ':' || window_start),1,1) < '8' THEN 'train' ELSE 'eval' END AS side FROM win)"


@query("time_leakage", sql(*WIN, _MIX, body="SELECT t.wallet_id, t.window_start, f.first_eval FROM mix t JOIN (SELECT wallet_id, min(window_start) AS first_eval FROM mix WHERE side='eval' GROUP BY 1) f USING (wallet_id) WHERE t.side='train' AND t.window_start >= f.first_eval"))
def _(spark, sf):
    return ds.time_leakage(_mixed(spark, sf))


@query("split_violations", sql(*WIN, _MIX, body="""
SELECT * FROM (SELECT 'wallet_held_out' AS kind, 'shared_wallet' AS code, count(*) AS n FROM (SELECT wallet_id FROM mix GROUP BY 1 HAVING count(DISTINCT side)=2)
UNION ALL SELECT 'wallet_held_out', 'synthetic_in_evaluation', count(*) FROM mix WHERE side='eval' AND data_mode='SYNTHETIC'
UNION ALL SELECT 'future_window', 'synthetic_in_evaluation', count(*) FROM mix WHERE side='eval' AND data_mode='SYNTHETIC'
UNION ALL SELECT 'group_held_out', 'synthetic_in_evaluation', count(*) FROM mix WHERE side='eval' AND data_mode='SYNTHETIC'
UNION ALL SELECT 'group_held_out', 'shared_group', count(*) FROM (SELECT control_category FROM mix GROUP BY 1 HAVING count(DISTINCT side)=2)
UNION ALL SELECT 'synthetic_pipeline_demonstration', 'not_synthetic', count(*) FROM mix WHERE side='eval' AND data_mode<>'SYNTHETIC'
UNION ALL SELECT 'future_window', 'backward_leakage', count(*) FROM (SELECT wallet_id, max(window_end) FILTER (WHERE side='train') AS t, min(window_start) FILTER (WHERE side='eval') AS e FROM mix GROUP BY 1) WHERE e <= t) WHERE n > 0"""))
def _(spark, sf):
    rows = _mixed(spark, sf)
    kinds = ("wallet_held_out", "future_window", "group_held_out", "synthetic_pipeline_demonstration")
    found = [ds.split_violations(rows, k, "control_category" if k == "group_held_out" else "wallet_id").select(F.lit(k).alias("kind"), "code", "n") for k in kinds]
    return reduce(DataFrame.unionByName, found)


@query("experiment_kind", sql(*WIN, _MIX, body="SELECT CASE WHEN sum(r)=0 THEN 'synthetic_pipeline_demonstration' WHEN sum(s)=0 THEN 'wallet_held_out' ELSE 'refused' END AS kind FROM (SELECT wallet_id, count(*) FILTER (WHERE side='eval' AND data_mode<>'SYNTHETIC') AS r, CASE WHEN count(DISTINCT side)=2 THEN 1 ELSE 0 END AS s FROM mix GROUP BY 1)"))
def _(spark, sf):
    return ds.experiment_kind(_mixed(spark, sf))


@query("train_overlap", sql(*WIN, _MIX, body="SELECT wallet_id, window_start FROM mix WHERE side='train' AND data_mode='LIVE'"))
def _(spark, sf):
    rows = _mixed(spark, sf)
    return ds.train_overlap(rows.filter("side = 'train'"), rows.filter("data_mode = 'LIVE'")).select("wallet_id", "window_start")


_REG = """reg AS (SELECT 'u' || c_custkey AS address, c_custkey, CASE c_custkey%3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'unreviewed' ELSE 'rejected' END AS review_state, substring(sha256('n0:u' || c_custkey),1,16) AS wallet_id FROM customer)"""


def _registry(spark, sf):
    return src.table(spark, sf, "customer").selectExpr(
        "'n0' AS network", "concat('u', c_custkey) AS address", "CASE c_custkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'unreviewed' ELSE 'rejected' END AS review_state", "concat('cat', c_custkey % 4) AS control_category"
    )


@query("materialize_dataset", sql(*WIN, _REG, body="""
SELECT w.wallet_id, w.window_start, 'cat' || (r.c_custkey%4) AS control_category, NULL AS reason FROM win w JOIN reg r USING (wallet_id) WHERE r.review_state='accepted'
UNION ALL SELECT wallet_id, NULL, NULL, 'missing_evidence' FROM reg WHERE review_state='accepted' AND wallet_id NOT IN (SELECT wallet_id FROM win)"""))
def _(spark, sf):
    rows = windows(spark, sf)
    kept, skipped = ds.materialize(_registry(spark, sf), rows.unionByName(rows.withColumn("run_id", F.lit("r2"))))
    return kept.select("wallet_id", "window_start", "control_category", F.lit(None).cast("string").alias("reason")).unionByName(
        skipped.select(ds.wallet_id(F.col("network"), F.col("address")).alias("wallet_id"), F.lit(None).cast("long").alias("window_start"), F.lit(None).cast("string").alias("control_category"), "reason")
    )


_TREE = f"""k AS MATERIALIZED (SELECT DISTINCT sha256(wallet_id || '|' || window_start || '|' || window_end || '|{ds.FEATURE_VERSION}') AS k FROM win),
deep AS (SELECT CASE WHEN count(*) <= {ds.FAN} THEN 0 WHEN count(*) <= {ds.FAN ** 2} THEN 1 WHEN count(*) <= {ds.FAN ** 3} THEN 2 ELSE 3 END AS deep FROM k),
l0 AS (SELECT substring(k, 1, 2 * deep) AS p, sha256(string_agg(k, '|' ORDER BY k)) AS d FROM k, deep GROUP BY 1),
l1 AS (SELECT substring(p, 1, greatest(length(p) - 2, 0)) AS p, CASE WHEN max(length(p)) = 0 THEN max(d) ELSE sha256(string_agg(d, '|' ORDER BY p)) END AS d FROM l0 GROUP BY 1),
l2 AS (SELECT substring(p, 1, greatest(length(p) - 2, 0)) AS p, CASE WHEN max(length(p)) = 0 THEN max(d) ELSE sha256(string_agg(d, '|' ORDER BY p)) END AS d FROM l1 GROUP BY 1),
l3 AS (SELECT substring(p, 1, greatest(length(p) - 2, 0)) AS p, CASE WHEN max(length(p)) = 0 THEN max(d) ELSE sha256(string_agg(d, '|' ORDER BY p)) END AS d FROM l2 GROUP BY 1)"""


@query("dataset_snapshot", sql(*WIN, _TREE, body="SELECT d AS snapshot_sha256 FROM l3"))
def _(spark, sf):
    return ds.snapshot_hash(windows(spark, sf))


_MAT = f"mat AS (SELECT wallet_id, window_start, window_end, user_id, feature, CASE WHEN v IS NULL THEN NULL WHEN v > 0 THEN ln(1+v) ELSE 0.0::DOUBLE END AS x FROM ({_LONG}))"
_MED = """med AS (SELECT feature, median(x) AS m FROM mat WHERE x IS NOT NULL GROUP BY 1)"""
_ABSENT = [n for n in ds.FEATURES if n.removeprefix("behavioral_") not in FEATURES]


@query("feature_matrix", sql(*WIN, _MAT, body="SELECT wallet_id, window_start, feature, round(x, 9) AS x FROM mat UNION ALL SELECT wallet_id, window_start, unnest([" + ",".join(f"'{n}'" for n in _ABSENT) + "]), NULL FROM win"))
def _(spark, sf):
    return ds.feature_matrix(windows(spark, sf)).select("wallet_id", "window_start", "feature", F.round("x", 9).alias("x"))


@query("impute_median", sql(*WIN, _MAT, _MED, body="SELECT feature, round(m, 9) AS median, false AS constant FROM med UNION ALL SELECT unnest([" + ",".join(f"'{n}'" for n in _ABSENT) + "]), 0.0, true"))
def _(spark, sf):
    return ds.train_medians(ds.feature_matrix(windows(spark, sf))).select("feature", F.round("median", 9).alias("median"), "constant")


_FEATS = ["x_in", "x_out", "x_din", "x_ain"]


def _points(spark, sf):
    """Integer-valued points, so that both engines split at the same place."""
    f = F.col("features")
    return windows(spark, sf).select(
        F.concat_ws(":", "wallet_id", "window_start").alias("id"), "control_category",
        f["behavioral_observed_incoming_transfer_count"].alias("x_in"), f["behavioral_observed_outgoing_transfer_count"].alias("x_out"),
        f["behavioral_distinct_incoming_counterparty_count"].alias("x_din"), f["behavioral_observed_incoming_amount_base_units"].alias("x_ain"),
    )


TREES, LEVELS = 6, 4


def _grown_sql() -> str:
    ctes = [f"""pt AS (SELECT wallet_id || ':' || window_start AS id, f_in AS x_in, f_out AS x_out, f_din AS x_din, f_ain AS x_ain FROM win),
s0 AS (SELECT tree, CAST(1 AS BIGINT) AS node, x_in, x_out, x_din, x_ain FROM pt, (SELECT unnest(range({TREES})) AS tree) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY sha256('11:' || tree || ':' || id)) <= 64)"""]
    unit = "CAST(CAST('0x' || substring(sha256('11:' || tree || ':' || node || ':split'),1,12) AS BIGINT) AS DOUBLE)/281474976710656.0"
    for i in range(LEVELS):
        opts = " UNION ALL ".join(f"SELECT tree, node, '{c}' AS feature, count(*) AS size, min({c}) AS lo, max({c}) AS hi, sha256('11:' || tree || ':' || node || ':{c}') AS h FROM s{i} GROUP BY 1,2" for c in _FEATS)
        ctes.append(f"l{i} AS (SELECT tree, node, size, feature, lo + {unit} * (hi - lo) AS split FROM ({opts}) WHERE hi > lo QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY h) = 1)")
        x = "CASE feature " + " ".join(f"WHEN '{c}' THEN {c}" for c in _FEATS) + " END"
        ctes.append(f"s{i + 1} AS (SELECT tree, node*2 + CASE WHEN {x} >= split THEN 1 ELSE 0 END AS node, {', '.join(_FEATS)} FROM s{i} JOIN l{i} USING (tree, node))")
    return sql(*WIN, *ctes, body=" UNION ALL ".join(f"SELECT CAST(tree AS BIGINT) AS tree, node, size, feature, round(split, 6) AS split FROM l{i}" for i in range(LEVELS)))


@query("iforest_splits", _grown_sql())
def _(spark, sf):
    drawn = fo.sample(_points(spark, sf), "id", TREES, 11, 64)
    return fo.grow(drawn, _FEATS, 11, LEVELS).select(F.col("tree").cast("long").alias("tree"), "node", "size", "feature", F.round("split", 6).alias("split"))


#: The reference's forest: so many trees, each of up to ``fo.SAMPLE`` rows and ``fo.DEPTH`` levels.
FOREST = 128


def _model_points(spark, sf):
    """One row per window with all allow-listed features, gaps filled with the median of the train wallets."""
    rows = fo.cut(ds.split_by_wallet(windows(spark, sf), 0.3, 7))
    medians = ds.train_medians(ds.feature_matrix(rows.filter("side = 'train'")))
    full = ds.impute(ds.feature_matrix(rows), medians)
    wide = full.groupBy("wallet_id", "window_start").agg(*[F.max(F.when(F.col("feature") == n, F.col("x"))).alias(n) for n in ds.FEATURES])
    known = rows.select("wallet_id", "window_start", "side", "control_category")
    return wide.join(known, ["wallet_id", "window_start"]).withColumn("id", F.concat_ws(":", "wallet_id", "window_start"))


def _drawn(points, trees):
    """The rows each tree grows from. Only train wallets are drawn, and only keys are dealt to all trees."""
    keys = fo.cut(fo.sample(points.filter("side = 'train'").select("id"), "id", trees, 11))
    return fo.cut(points.join(F.broadcast(keys), "id"))


def _ranked(spark, sf, trees=FOREST, side=None):
    """All windows by score, or those of one side."""
    points, names = fo.cut(_model_points(spark, sf)), list(ds.FEATURES)
    drawn = _drawn(points, trees)
    wanted = points if side is None else points.filter(F.col("side") == side)
    return fo.rank(fo.score(wanted, fo.grow(drawn, names, 11), drawn, names), "id")


@query("anomaly_rank")
def _(spark, sf):
    """Windows of the evaluation wallets; those that the trees grew from are not ranked."""
    return _ranked(spark, sf, side="eval").select("id", F.round("score", 9).alias("score"), "rank", "is_outlier")


@query("precision_at_k", sql(*WIN, body="""
, r AS (SELECT control_category AS c, row_number() OVER (ORDER BY -f_ain, wallet_id || ':' || window_start) <= 50 AS top FROM win), t AS (SELECT count(*) FILTER (WHERE c IN ('cat0','cat1','cat2')) AS labeled, count(*) FILTER (WHERE c IS NULL) AS unlabeled,
 count(*) FILTER (WHERE c NOT IN ('cat0','cat1','cat2')) AS outside, count(*) FILTER (WHERE c='cat0') AS worthy, count(*) FILTER (WHERE c='cat1') AS confounders, count(*) FILTER (WHERE top AND c IN ('cat0','cat1','cat2')) AS labeled_top, count(*) FILTER (WHERE top AND c='cat0') AS worthy_top, count(*) FILTER (WHERE top AND c='cat1') AS confounders_top FROM r)
SELECT *, worthy_top::DOUBLE/nullif(labeled_top,0) AS precision, worthy::DOUBLE/nullif(labeled,0) AS baseline, confounders_top::DOUBLE/nullif(labeled_top,0) AS confounder_fraction FROM t""".lstrip()))
def _(spark, sf):
    # A fixed score stands in for the model: the largest incoming amounts first.
    scored = _points(spark, sf).withColumn("score", -F.col("x_ain"))
    return fo.precision_at_k(fo.rank(scored, "id"), 50, _WORTHY, _CONF, _NEG)


@query("anomaly_precision_at_k")
def _(spark, sf):
    # Windows the model was grown from must not judge it.
    return fo.precision_at_k(_ranked(spark, sf, side="eval"), 50, _WORTHY, _CONF, _NEG)


@query("readiness_units", sql(*WIN, _REG, body="""
, w AS (SELECT wallet_id, count(*) AS n FROM win GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS windows, count(*) AS wallets, count(*) FILTER (WHERE n>1) AS wallets_with_many, max(n) AS most, (SELECT count(*) FROM reg) AS records,
 (SELECT count(*) FROM reg WHERE review_state='accepted') AS accepted, (SELECT count(*) FROM reg WHERE review_state='unreviewed') AS unreviewed, max(n)::DOUBLE/sum(n)::DOUBLE AS largest_share, 'READY' AS status FROM w""".lstrip()))
def _(spark, sf):
    return ds.readiness_units(windows(spark, sf), _registry(spark, sf))


@query("corpus_concentration", sql(*WIN, body="SELECT wallet_id, count(*) AS windows, min(window_start) AS earliest, max(window_end) AS latest, min(control_category) AS control_category FROM win GROUP BY 1"))
def _(spark, sf):
    return ds.corpus_concentration(windows(spark, sf))


@query("category_coverage", sql(*WIN, body="SELECT coalesce(control_category,'unknown') AS control_category, count(*) AS windows, count(DISTINCT wallet_id) AS wallets FROM win GROUP BY 1 UNION ALL SELECT 'cat9', 0, 0"))
def _(spark, sf):
    return ds.category_coverage(windows(spark, sf), ("cat0", "cat1", "cat2", "cat3", "cat9"))


@query("feature_missingness", sql(*WIN, body=f"SELECT feature, count(*) AS rows, CAST(count(*) FILTER (WHERE v IS NULL) AS DOUBLE)/count(*) AS missing_rate FROM ({_LONG}) GROUP BY 1"))
def _(spark, sf):
    return ds.feature_missingness(windows(spark, sf))


def _cohort(spark, sf):
    """Hourly graphs as saved runs of their first sender."""
    events = thin(spark, sf)
    first = F.min_by(F.struct("from_address", "token_contract"), F.struct("block_time", "event_reference"))
    runs = events.groupBy("trace_id").agg(first.alias("s"), F.min(F.unix_seconds("block_time")).alias("created_at"), F.count(F.lit(1)).alias("n")).selectExpr(
        "trace_id", "s.from_address AS seed_address", "'n0' AS network_key", "s.token_contract AS token_contract", "created_at", "CASE WHEN created_at % 9 = 0 THEN 'SYNTHETIC' ELSE 'LIVE' END AS data_mode",
        "sha2(trace_id, 256) AS trace_sha256", "CASE WHEN created_at % 7 = 0 THEN 'changed' ELSE sha2(trace_id, 256) END AS stored_sha256", "CASE WHEN n % 5 = 0 THEN 'partial' ELSE 'complete_within_scope' END AS coverage_status",
    )
    runs = runs.withColumn("token_contract", F.when(F.col("token_contract") < "a5", "a0").otherwise(F.col("token_contract")))
    return ds.cohort_eligibility(runs, graph_features(events, ["trace_id"]), "n0", "a0", "LIVE")


_COH = f"""ru AS (SELECT trace_id, arg_min(from_address,(t,event_reference)) AS seed_address, arg_min(token_contract,(t,event_reference)) AS tc, min(t) AS created_at, count(*) AS n FROM sparse GROUP BY 1),
own AS (SELECT *, CASE WHEN tc >= 'a5' OR created_at%9=0 THEN 'different_network_asset_or_mode' WHEN created_at%7=0 THEN 'integrity_failure' WHEN n%5=0 THEN 'incomplete_coverage' END AS o FROM ru),
fst AS (SELECT seed_address, arg_min(trace_id,(created_at,trace_id)) AS ft FROM own WHERE o IS NULL GROUP BY 1),
coh AS (SELECT own.*, coalesce(o, CASE WHEN ft <> trace_id THEN 'repeated_seed_wallet' END) AS reason FROM own LEFT JOIN fst USING (seed_address))"""


@query("cohort_eligibility", sql(LEDGER, SPARSE, _COH, body="SELECT trace_id, seed_address, reason FROM coh"))
def _(spark, sf):
    return _cohort(spark, sf).select("trace_id", "seed_address", "reason")


@query("cohort_split", sql(LEDGER, SPARSE, _COH, body="""
, e AS (SELECT *, row_number() OVER (ORDER BY created_at, trace_id) AS position, count(*) OVER () AS m FROM coh WHERE reason IS NULL), c AS (SELECT max(created_at) AS edge FROM e WHERE position = CAST(floor(m*0.8) AS BIGINT))
SELECT trace_id, position, CASE WHEN m < 25 THEN 'insufficient_data' WHEN position <= floor(m*0.8) THEN 'train' WHEN created_at > edge THEN 'scored' ELSE 'tied_at_cut' END AS side FROM e, c""".lstrip()))
def _(spark, sf):
    return ds.cohort_split(_cohort(spark, sf).filter("reason IS NULL")).select("trace_id", "position", "side")


@query("cohort_rank")
def _(spark, sf):
    names = ["log_verified_transfers", "log_distinct_addresses", "log_max_in_degree", "log_max_out_degree", "repeated_pair_fraction", "self_transfer_fraction"]
    placed = fo.cut(ds.cohort_split(_cohort(spark, sf).filter("reason IS NULL")).select("trace_id", "side", *names))
    drawn = fo.cut(fo.sample(placed.filter("side = 'train'"), "trace_id", 64, 42))
    scored = fo.score(placed.filter("side = 'scored'"), fo.grow(drawn, names, 42), drawn, names)
    return fo.rank(scored, "trace_id").select("trace_id", F.round("score", 9).alias("score"), "rank")


