"""Wallet-window rows, leak-safe splits, feature matrix and readiness counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.functions.predicates import first_reason, reasons
from rivermark.operators.casework import latency_percentiles
from rivermark.scale import cut, position_in

# Definition versions, name parts that must not appear, the feature allow-list.
FEATURE_VERSION = "v1-2026-09-20"
DISALLOWED = ("address", "complaint", "case_id", "outcome", "service_name", "review_state")
FEATURES = {
    "behavioral_observed_incoming_transfer_count": "log1p",
    "behavioral_observed_outgoing_transfer_count": "log1p",
    "behavioral_distinct_incoming_counterparty_count": "log1p",
    "behavioral_distinct_outgoing_counterparty_count": "log1p",
    "behavioral_observed_incoming_amount_base_units": "log1p",
    "behavioral_observed_outgoing_amount_base_units": "log1p",
    "behavioral_outgoing_concentration_toward_accepted_anchor": "identity",
    "behavioral_outgoing_concentration_max_by_count": "identity",
    "behavioral_outgoing_concentration_max_by_amount": "identity",
    "behavioral_outgoing_counterparties_with_repeat_count": "log1p",
    "behavioral_repeated_forwarding_count": "log1p",
    "behavioral_receipt_to_outflow_observation_count": "log1p",
    "behavioral_receipt_to_outflow_ambiguous_count": "log1p",
    "behavioral_receipt_to_outflow_min_gap_seconds": "log1p",
    "behavioral_receipt_to_outflow_median_gap_seconds": "log1p",
    "behavioral_post_outflow_residue_base_units": "signed_log1p",
    "behavioral_ordering_ambiguous_observation_count": "log1p",
    "behavioral_event_index_missing_count": "log1p",
    "behavioral_block_number_missing_count": "log1p",
}
KEY = ["wallet_id", "window_start", "window_end", "feature_definition_version"]


def wallet_id(network: Column, address: Column) -> Column:
    """Pseudonymous id: the address itself never leaves this function."""
    return F.substring(F.sha2(F.concat_ws(":", network, address), 256), 1, 16)


def wallet_windows(wide: DataFrame, features: dict[str, str], prefix: str = "behavioral_") -> DataFrame:
    """Feature and missingness maps per wallet window. ``features`` maps names to columns."""
    names = [prefix + n for n in features]
    for n in names:
        if any(part in n for part in DISALLOWED):
            raise ValueError(f"feature {n} is not allowed in a wallet-window row")
    pairs = [(n, F.col(c).cast("double")) for n, c in zip(names, features.values(), strict=True)]
    return wide.select(
        wallet_id(F.col("network"), F.col("address")).alias("wallet_id"), "network", "window_start", "window_end",
        F.create_map(*[x for n, v in pairs for x in (F.lit(n), v)]).alias("features"),
        F.create_map(*[x for n, v in pairs for x in (F.lit(n), v.isNull())]).alias("missingness"),
        "data_mode", "control_category", F.lit(FEATURE_VERSION).alias("feature_definition_version"), "run_id",
    )


def dedupe_rows(rows: DataFrame) -> DataFrame:
    """One row per wallet, window and definition: the one of the smallest run."""
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.min_by(F.struct(*rest), "run_id").alias("r")).select(*KEY, "r.*")


def split_by_wallet(rows: DataFrame, fraction: float, seed: int, group: str = "wallet_id") -> DataFrame:
    """Whole groups to train or eval by the order of a seeded digest."""
    groups = rows.select(group).distinct().withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), group), 256))
    ranked = position_in(groups.withColumn("_cell", F.substring("_h", 1, 3)), [], [F.col("_h")], ["_cell"], "_pos")
    count = groups.agg(F.bround(F.count(F.lit(1)) * F.lit(fraction)).cast("long")).scalar()
    side = ranked.select(group, F.when(F.col("_pos") <= count, "eval").otherwise("train").alias("side"))
    return rows.join(side, group)


def split_by_time(rows: DataFrame, cutoff: Column) -> DataFrame:
    return rows.withColumn("side", F.when(F.col("window_start") < cutoff, "train").otherwise("eval"))


def time_leakage(rows: DataFrame) -> DataFrame:
    """Train windows that start at or after an eval window of the same wallet."""
    first = rows.filter("side = 'eval'").groupBy("wallet_id").agg(F.min("window_start").alias("first_eval"))
    return rows.filter("side = 'train'").join(first, "wallet_id").filter("window_start >= first_eval").select("wallet_id", "window_start", "first_eval")


def train_overlap(train: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Rows of the second set that the first one was fitted on."""
    return evaluated.join(train.select(*KEY).distinct(), KEY, "left_semi")


def split_violations(rows: DataFrame, kind: str, group: str = "wallet_id") -> DataFrame:
    """What breaks a declared experiment kind, as code and count. Empty means sound."""
    both = lambda *c: rows.groupBy(*c).agg(
        F.max((F.col("side") == "train").cast("int")).alias("t"), F.max((F.col("side") == "eval").cast("int")).alias("e")
    ).filter("t = 1 AND e = 1")
    code = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("code"), "n")
    found = [code(both(*KEY), "rows_on_both_sides")]
    synthetic = rows.filter("side = 'eval'")
    if kind == "synthetic_pipeline_demonstration":
        found.append(code(synthetic.filter("data_mode <> 'SYNTHETIC'"), "not_synthetic"))
    else:
        found.append(code(synthetic.filter("data_mode = 'SYNTHETIC'"), "synthetic_in_evaluation"))
    if kind == "wallet_held_out":
        found.append(code(both("wallet_id"), "shared_wallet"))
    if kind == "group_held_out":
        found.append(code(both(group), "shared_group"))
    if kind == "future_window":
        sides = rows.groupBy("wallet_id").agg(
            F.max(F.when(F.col("side") == "train", F.col("window_end"))).alias("t"), F.min(F.when(F.col("side") == "eval", F.col("window_start"))).alias("e")
        )
        found.append(code(sides.filter("t IS NOT NULL AND e IS NOT NULL AND e <= t"), "backward_leakage"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.filter("n > 0")


def experiment_kind(rows: DataFrame) -> DataFrame:
    """Kind inferred when none is declared; shared wallets are refused."""
    w = rows.groupBy("wallet_id").agg(
        F.max((F.col("side") == "train").cast("int")).alias("t"), F.max((F.col("side") == "eval").cast("int")).alias("e"),
        F.sum(((F.col("side") == "eval") & (F.col("data_mode") != "SYNTHETIC")).cast("int")).alias("real"),
    )
    return w.agg(F.sum("real").alias("real"), F.sum((F.col("t") * F.col("e")).cast("int")).alias("shared")).select(
        F.when(F.col("real") == 0, "synthetic_pipeline_demonstration").when(F.col("shared") == 0, "wallet_held_out").otherwise("refused").alias("kind")
    )


def feature_table(rows: DataFrame, names: list[str]) -> DataFrame:
    """Wide table with a stable column order; absent features are NULL."""
    return rows.select(*KEY[:3], *[F.col("features")[n].alias(n) for n in sorted(names)])


def feature_matrix(rows: DataFrame) -> DataFrame:
    """Allow-listed features, transformed, as one row per feature."""
    value = F.col("value")
    log = F.when(value > 0, F.log1p(value)).otherwise(F.lit(0.0))
    signed = F.signum(value) * F.log1p(F.abs(value))
    kinds = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("transform")) for n, k in FEATURES.items()])
    long = rows.withColumn("f", F.explode(kinds)).withColumn("value", F.col("features")[F.col("f.name")])
    x = F.when(value.isNull(), None).when(F.col("f.transform") == "log1p", log).when(F.col("f.transform") == "signed_log1p", signed).otherwise(value)
    return long.select("wallet_id", "window_start", "window_end", F.col("f.name").alias("feature"), x.alias("x"))


def train_medians(matrix: DataFrame) -> DataFrame:
    """Exact median of each feature over training rows; features never seen become 0."""
    seen = latency_percentiles(matrix.filter("x IS NOT NULL"), ["feature"], "x", 1).select("feature", "median")
    every = matrix.select("feature").distinct()
    return every.join(seen, "feature", "left").select("feature", F.coalesce("median", F.lit(0.0)).alias("median"), F.col("median").isNull().alias("constant"))


def impute(matrix: DataFrame, medians: DataFrame) -> DataFrame:
    """Fill gaps with the training median and say so. One row per feature is broadcast: 19 rows."""
    return matrix.join(F.broadcast(medians), "feature").select(
        "wallet_id", "window_start", "window_end", "feature", F.coalesce("x", "median").alias("x"), F.col("x").isNull().alias("imputed")
    )


def materialize(registry: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of accepted wallets, and the accepted wallets without any, with the reason."""
    ok = registry.filter("review_state = 'accepted'").select(
        "network", "address", "control_category", wallet_id(F.col("network"), F.col("address")).alias("wallet_id")
    )
    kept = dedupe_rows(rows.drop("control_category").join(ok.select("wallet_id", "control_category"), "wallet_id"))
    skipped = ok.join(rows.select("wallet_id").distinct(), "wallet_id", "left_anti").select("network", "address", F.lit("missing_evidence").alias("reason"))
    return kept, skipped


#: Digests that are joined to one at each level of the snapshot tree.
FAN = 256


def snapshot_hash(rows: DataFrame) -> DataFrame:
    """One digest of the row keys, built as a tree of digests.

    The digest of a key says where it belongs: two more hex digits at each level, with as
    many levels as keep about ``FAN`` keys in a group. Every group is sorted and
    digested, then ``FAN`` groups at a time, up to the root. The number of keys decides on the
    levels, so partitioning does not matter, and no list grows with the table.
    """
    key = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in KEY]), 256)
    level = cut(rows.select(key.alias("d")).distinct())
    n, depth = level.count(), 0
    while n > FAN ** (depth + 1):
        depth += 1
    level = level.select("d", F.substring("d", 1, 2 * depth).alias("p"), F.col("d").alias("at"))
    for k in range(depth, -1, -1):
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), "|")
        level = level.groupBy("p").agg(F.sha2(joined, 256).alias("d")).select("d", F.substring("p", 1, max(2 * k - 2, 0)).alias("p"), F.col("p").alias("at"))
    return level.select(F.col("d").alias("snapshot_sha256")) if n else rows.groupBy().agg(F.sha2(F.lit(""), 256).alias("snapshot_sha256"))


def readiness_units(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Windows, wallets and records kept apart, with a status that follows from them."""
    w = rows.groupBy("wallet_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("windows"), F.count(F.lit(1)).alias("wallets"), F.sum((F.col("n") > 1).cast("long")).alias("wallets_with_many"), F.max("n").alias("most")
    )
    state = lambda s: F.sum((F.col("review_state") == s).cast("long"))
    r = registry.agg(F.count(F.lit(1)).alias("records"), state("accepted").alias("accepted"), state("unreviewed").alias("unreviewed"))
    one = w.withColumn("_k", F.lit(1)).join(r.withColumn("_k", F.lit(1)), "_k").drop("_k")
    gaps = reasons((F.col("accepted") == 0, "no_accepted_records"), (F.col("windows") == 0, "no_windows"), (F.col("wallets") < 2, "no_split_possible"))
    return one.select("*", (F.col("most") / F.col("windows")).alias("largest_share"), F.when(F.size(gaps) == 0, "READY").otherwise("NOT_READY").alias("status"))


def corpus_concentration(rows: DataFrame) -> DataFrame:
    return rows.groupBy("wallet_id").agg(
        F.count(F.lit(1)).alias("windows"), F.min("window_start").alias("earliest"), F.max("window_end").alias("latest"), F.min("control_category").alias("control_category")
    )


def category_coverage(rows: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Windows and wallets per category; categories without any appear with zero."""
    known = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in categories])).alias("control_category"))
    seen = rows.groupBy(F.coalesce("control_category", F.lit("unknown")).alias("control_category")).agg(
        F.count(F.lit(1)).alias("windows"), F.countDistinct("wallet_id").alias("wallets")
    )
    return known.join(seen, "control_category", "full").select("control_category", F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("wallets", F.lit(0)).alias("wallets"))


def feature_missingness(rows: DataFrame) -> DataFrame:
    flags = rows.select(F.explode("missingness").alias("feature", "missing"))
    return flags.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("missing").cast("double")).alias("missing_rate"))


def cohort_eligibility(runs: DataFrame, features: DataFrame, network: str, contract: str, mode: str) -> DataFrame:
    """Why a saved run cannot join the cohort; eligible runs after the first of a seed are repeats."""
    j = runs.join(features, "trace_id", "left")
    own = first_reason(
        ((F.col("network_key") != network) | (F.col("token_contract") != contract) | (F.col("data_mode") != mode), "different_network_asset_or_mode"),
        (F.col("trace_sha256") != F.col("stored_sha256"), "integrity_failure"),
        (F.col("coverage_status") != "complete_within_scope", "incomplete_coverage"),
        (F.col("log_verified_transfers").isNull() | F.col("seed_address").isNull(), "insufficient_verified_data"),
    )
    marked = j.withColumn("own", own)
    first = marked.filter("own IS NULL").groupBy("seed_address").agg(F.min(F.struct("created_at", "trace_id")).alias("first"))
    out = marked.join(first, "seed_address", "left")
    later = F.col("own").isNull() & (F.col("first.trace_id") != F.col("trace_id"))
    return out.withColumn("reason", F.coalesce("own", F.when(later, "repeated_seed_wallet"))).drop("own", "first")


def cohort_split(eligible: DataFrame, minimum: int = 25) -> DataFrame:
    """Earlier 80 % train, later 20 % scored; runs saved at the cut's own time are left out."""
    rows = eligible.withColumn("_day", F.floor(F.col("created_at") / 86_400)).withColumn("_pre", F.substring(F.sha2("trace_id", 256), 1, 0))
    placed = position_in(rows, [], [F.col("created_at"), F.col("trace_id")], ["_day", "_pre"])
    n = eligible.agg(F.count(F.lit(1))).scalar()
    cut = F.floor(n * F.lit(0.8))
    edge = placed.filter(F.col("position") == cut).agg(F.max("created_at")).scalar()
    side = F.when(n < minimum, "insufficient_data").when(F.col("position") <= cut, "train").when(F.col("created_at") > edge, "scored").otherwise("tied_at_cut")
    return placed.withColumn("side", side).drop("_day", "_pre")
