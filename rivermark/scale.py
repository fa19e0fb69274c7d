"""Helpers that keep the jobs even when one key holds a large share of the rows.

Three problems come up again and again: a per-key window over a hot key is one
task, a join on a hot key is one task, and an iterative job drags its lineage
along. Each has one answer here.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more rows than this is split into ordered cells before a window.
HOT_ROWS = 1_000_000
#: At most this many keys can be called hot, whatever the table size.
MAX_HOT_KEYS = 10_000
#: Largest dimension that is broadcast, in rows and bytes; above it the salted join is used.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000
SALTS = 32
#: Hashes by which ``none_hot`` counts.
HASHES = 65_536


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on; all can be changed by the caller."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Split skewed join partitions even if an aggregate above needs a new shuffle.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # What an execution shuffled goes when it ends, not when the driver happens to collect garbage.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _checkpoint_ready(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="rivermark-")
    sc.setCheckpointDir(configured)


def shared_folder(spark: SparkSession) -> str:
    """The folder of intermediate tables that the driver and all executors see."""
    _checkpoint_ready(spark)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    _checkpoint_ready(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def by_some_keys(spark: SparkSession) -> contextlib.AbstractContextManager:
    """Joins planned meanwhile take sides that lie by some of the join's keys as they lie."""
    return _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def _options(lone: tuple[str, ...]) -> dict[str, str]:
    # A dictionary of values that hardly repeat is built in vain, and they hardly gain by strong compression.
    light = {"parquet.compression.codec.zstd.level": "1"} if lone else {}
    return {"compression": "zstd"} | light | {f"parquet.enable.dictionary#{c}": "false" for c in lone}


def _bucketed(df: DataFrame, name: str, path: str, n: int, keys: list[str], lone: tuple[str, ...] = ()) -> None:
    """Write ``df``, of which every part holds one bucket, in the order of its rows."""
    # Else rows are sorted by a bucket number that is worked out again for each comparison.
    with _set(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", "2"):
        df.write.options(**_options(lone)).option("path", path).bucketBy(n, *keys).saveAsTable(name)


def staged(df: DataFrame, passing: list[Callable] | None = None, lone: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, for wide rows that are read by column.

    ``passing`` gets a call that removes the files again, for tables that are read only for a while;
    ``lone`` names columns whose values hardly repeat.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.options(**_options(lone)).parquet(path)
    if passing is not None:
        passing.append(lambda: _remove(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, keys: list[str], passing: list[Callable] | None = None, lone: tuple[str, ...] = ()) -> DataFrame:
    """``staged`` in buckets of ``keys``, by which ``df`` is dealt into as many parts as shuffles have.

    Grouping, windows and joins by these keys then move no rows of the table.
    """
    spark = df.sparkSession
    name = f"rivermark_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _bucketed(df, name, path, n, keys, lone)
    if passing is not None:
        passing.append(lambda: _remove(spark, path, name))
    return spark.table(name)


def _remove(spark: SparkSession, path: str, name: str | None = None) -> None:
    if name is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def passed(tables: list[Callable]) -> None:
    """Remove the tables that nothing reads any more; the list is empty afterwards."""
    while tables:
        tables.pop()()


def none_hot(df: DataFrame, keys: list[str]) -> bool:
    """Whether no key can have more than ``HOT_ROWS`` rows.

    Rows are counted by a hash of the key, which needs no shuffle of the keys; a count is at
    least that of each key in it, so a False may be too careful and a True never is.
    """
    counts = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(HASHES)).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    return (counts.agg(F.max("_n")).first()[0] or 0) <= HOT_ROWS


def fits(dim: DataFrame) -> bool:
    """Whether a frame is small enough to broadcast, by its rows and the bytes of its values."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in dim.columns]))))
    rows, held = dim.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), size).first()
    return rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES


def dim_join(
    fact: DataFrame, dim: DataFrame, keys: list[str], how: str, spread: list[str], small: bool | None = None
) -> DataFrame:
    """Join a fact to a dimension that may have hot keys on the fact side.

    The dimension is measured unless ``small`` says what was found before. Small ones are
    broadcast, so the fact is not shuffled at all. For larger ones both sides are shuffled once;
    where a hash of the keys is large enough to hold a hot one, the dimension is copied once per
    salt and the fact rows of one key are spread over the salts by a hash of ``spread``. A caller
    that knows that no key is hot passes no ``spread``.
    """
    if fits(dim) if small is None else small:
        return fact.join(F.broadcast(dim), keys, how)
    if not spread or none_hot(fact, keys):
        return fact.join(dim, keys, how)
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS).cast("long")))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


class Laid:
    """A table written once in buckets of some keys, sorted inside them, for many joins.

    A key with more than ``HOT_ROWS`` rows is dealt over several buckets by a hash of
    ``spread``; at most ``MAX_HOT_KEYS`` keys can be that large. ``join`` brings only the other
    side to the buckets, so the table itself is shuffled once, when it is written.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], spread: str, calm: bool = False, lone: tuple[str, ...] = ()):
        """``calm`` spares counting the keys where the caller knows that none is large; ``lone`` as for ``staged``."""
        spark = df.sparkSession
        _checkpoint_ready(spark)
        self.spark, self.keys, self.name = spark, keys, f"rivermark_{uuid.uuid4().hex}"
        self.path = f"{spark.sparkContext.getCheckpointDir()}/{self.name}"
        self.any_hot = False
        if not calm:
            counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            # A floor that grows with the table keeps the number of hot keys below MAX_HOT_KEYS.
            floor = df.agg(F.count(F.lit(1)) / F.lit(MAX_HOT_KEYS)).scalar()
            hot = counts.filter(F.col("_n") > F.greatest(F.lit(HOT_ROWS).cast("double"), floor))
            self.hot = cut(hot.select(*keys, F.ceil(F.col("_n") / F.lit(HOT_ROWS)).cast("int").alias("_deals")))
            self.any_hot = not self.hot.isEmpty()
        deal = F.lit(0)
        if self.any_hot:
            df = df.join(F.broadcast(self.hot), keys, "left")
            deal = F.pmod(F.xxhash64(spread), F.coalesce("_deals", F.lit(1)).cast("long")).cast("int")
        df = df.withColumn("_deal", deal).drop("_deals")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # One file per bucket: the rows are dealt to tasks as they are dealt to buckets. The last key
        # is compared first, as it tells most rows apart.
        dealt = df.repartition(n, *keys, "_deal").sortWithinPartitions(*reversed(keys), *order)
        _bucketed(dealt, self.name, self.path, n, [*keys, "_deal"], lone)
        self.df = spark.table(self.name).drop("_deal")

    def join(self, other: DataFrame, small: bool | None = None, only: str = "true") -> DataFrame:
        """Inner join on the keys; a small side is broadcast, a larger one goes to the buckets.

        ``only`` says which rows of the table can matter; the others meet nothing.
        """
        if fits(other) if small is None else small:
            return self.df.filter(only).join(F.broadcast(other), self.keys)
        deals = F.array(F.lit(0))
        if self.any_hot:
            other = other.join(F.broadcast(self.hot), self.keys, "left")
            deals = F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1)
        # The table is streamed past the other side, so it is not sorted again for each join.
        dealt = other.withColumn("_deal", F.explode(deals)).drop("_deals").hint("shuffle_hash")
        return self.spark.table(self.name).filter(only).join(dealt, [*self.keys, "_deal"]).drop("_deal")

    def drop(self) -> None:
        """Remove the table and its files."""
        _remove(self.spark, self.path, self.name)


def with_cells(
    df: DataFrame, keys: list[str], position: Column, width: int, hot_rows: int | None = None
) -> DataFrame:
    """Add ``_hot`` and ``_cell``.

    ``position`` is a number that grows with the sort order. Rows of a hot key
    get ``floor(position / width)`` as cell, all other rows cell 0. Cells of a
    key follow each other in sort order, so a window per cell plus one carried
    row per cell equals a window over the whole key.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    floor = F.greatest(
        F.lit(hot_rows).cast("double"),
        df.agg(F.count(F.lit(1)) / F.lit(MAX_HOT_KEYS)).scalar(),
    )
    # No more than MAX_HOT_KEYS keys can pass the floor, so this side is bounded.
    hot = counts.filter(F.col("_n") > floor).select(*keys, F.lit(True).alias("_hot"))
    cell = F.coalesce(F.floor(position / F.lit(width)), F.lit(-1)).cast("long")
    return (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn("_hot", F.coalesce("_hot", F.lit(False)))
        .withColumn("_cell", F.when(F.col("_hot"), cell).otherwise(F.lit(0).cast("long")))
    )


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], fields: list[str], out: str = "prev"
) -> DataFrame:
    """``lag(struct(fields))`` per key in ``order``, for a frame from ``with_cells``."""
    value = F.struct(*fields)
    w = Window.partitionBy(*keys, "_cell").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    local = df.withColumn("_lag", F.lag(value).over(w))
    ends = (
        df.filter("_hot").groupBy(*keys, "_cell").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    )
    across = Window.partitionBy(*keys).orderBy("_cell")
    carry = ends.select(*keys, "_cell", F.lag("_end").over(across).alias("_carry"))
    return (
        local.join(carry, [*keys, "_cell"], "left")
        .withColumn(out, F.coalesce("_lag", "_carry"))
        .drop("_lag", "_carry")
    )


def nearest_before(
    df: DataFrame, keys: list[str], at: str, flag: Column, value: Column, out: str = "before"
) -> DataFrame:
    """Largest ``value`` among rows with ``flag`` and a strictly smaller ``at``.

    ``value`` must start with ``at`` (a struct), so the largest is the nearest.
    Needs cells made from ``at`` by ``with_cells``.
    """
    marked = df.withColumn("_mark", F.when(flag, value))
    w = (
        Window.partitionBy(*keys, "_cell")
        .orderBy(at)
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    local = marked.withColumn("_near", F.max("_mark").over(w))
    ends = marked.filter("_hot").groupBy(*keys, "_cell").agg(F.max("_mark").alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_cell", F.max("_end").over(across).alias("_carry"))
    return (
        local.join(carry, [*keys, "_cell"], "left")
        .withColumn(out, F.coalesce("_near", "_carry"))
        .drop("_near", "_carry", "_mark")
    )


def position_in(
    df: DataFrame, keys: list[str], order: list[Column], cell: list[str], out: str = "position"
) -> DataFrame:
    """Exact 1-based position per key, computed cell by cell.

    ``cell`` columns must not decrease along ``order``. Only one count per cell
    meets in a single place. ``keys`` may be empty for a global position.
    """
    w = Window.partitionBy(*keys, *cell).orderBy(*order)
    sizes = df.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(*cell)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *keys, *cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        df.withColumn("_rn", F.row_number().over(w))
        .join(offsets, [*keys, *cell])
        .withColumn(out, (F.col("_rn") + F.col("_offset")).cast("long"))
        .drop("_rn", "_offset")
    )


def running_total(cells: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Cumulative sum per key in ``order``, cell by cell, for a frame from ``with_cells``."""
    w = Window.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.groupBy(*keys, "_cell").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_cell", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return (
        cells.withColumn("_upto", F.sum(value).over(w))
        .join(offsets, [*keys, "_cell"])
        .withColumn("upto", F.col("_upto") + F.col("_before"))
        .drop("_upto", "_before")
    )


def running_before(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple]
) -> DataFrame:
    """Aggregates over all rows of the key that come strictly earlier in ``order``.

    ``values`` maps an output name to ``(function, column)``, the function being
    ``F.min``, ``F.max`` or ``F.sum``. Needs a frame from ``with_cells``.
    """
    w = (
        Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    across = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[fn(c).over(w).alias(f"_l_{n}") for n, (fn, c) in values.items()])
    ends = df.filter("_hot").groupBy(*keys, "_cell").agg(
        *[fn(c).alias(f"_e_{n}") for n, (fn, c) in values.items()]
    )
    carry = ends.select(
        *keys, "_cell", *[fn(f"_e_{n}").over(across).alias(f"_c_{n}") for n, (fn, _) in values.items()]
    )
    out = local.join(carry, [*keys, "_cell"], "left")
    for n, (fn, _) in values.items():
        here, there = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if fn is F.sum:
            both = F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
        else:
            both = F.least(here, there) if fn is F.min else F.greatest(here, there)
        out = out.withColumn(n, both)
    return out.drop(*[f"_{p}_{n}" for n in values for p in "lc"])


def one_cell(df: DataFrame) -> DataFrame:
    """Mark a frame known to be small: no key is hot, one cell per key."""
    return df.withColumn("_hot", F.lit(False)).withColumn("_cell", F.lit(0).cast("long"))
