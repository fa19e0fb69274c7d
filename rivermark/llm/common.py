"""What several of the text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivermark.scale import _checkpoint_ready

#: Characters that end a word: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column in which null reads as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for an empty text."""
    return F.array_remove(F.split(text, f"[{SPACES}]+", -1), "")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and go on from the files.

    Unlike ``checkpoint()`` the copy is columnar and compressed, so later reads take
    only the columns they use.
    """
    spark = df.sparkSession
    _checkpoint_ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rivermark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Copies:
    """Staged copies of one job, each removed once what was made from it is written too, all if a write fails."""

    def __init__(self, spark: SparkSession):
        _checkpoint_ready(spark)
        self.spark, self.paths = spark, {}
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/rivermark-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df``; an earlier copy of that name stays until ``drop``."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        self.paths.setdefault(name, []).append(path)
        try:
            df.write.parquet(path)
        except Exception:
            for held in list(self.paths):
                self.drop(held)
            raise
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str, keep: int = 0) -> None:
        """Remove the copies of that name but the ``keep`` newest."""
        paths = self.paths.get(name, [])
        for path in paths[: len(paths) - keep]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths[name] = paths[len(paths) - keep :]


#: Bytes of UTF-8 that belong to a term: letters, digits and everything outside ASCII.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


def blocks(items: DataFrame, size: str, limit: int):
    """Rows of ``items`` in lists whose ``size`` column adds up to ``limit`` at most.

    A row above the limit is a list of its own. One partition at a time comes to the
    driver, so a long list of queries is never held whole.
    """
    block, held = [], 0
    for row in items.toLocalIterator():
        if block and held + row[size] > limit:
            yield block
            block, held = [], 0
        block.append(row)
        held += row[size]
    if block:
        yield block
