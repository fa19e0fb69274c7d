"""Reviewed label files: what loads, what was withdrawn, what is refused and why.

Files are CSV with a header. Every column is read as text beside the raw line of rows that
do not fit the header, so a bad row becomes a refusal with its reasons and never fails
the load or turns into a claim.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivermark.functions.predicates import _is, reasons
from rivermark.operators.labels import WITHDRAWN, is_control, label_problems
from rivermark.operators.patterns import digest_of
from rivermark.scale import cut

# Columns a label file must have.
COLUMNS = ("network", "address", "entity_name", "entity_type", "assertion_type", "address_role", "review_state",
           "source_reference", "retrieval_date", "methodology", "label_set_version")
DATES = ("valid_from", "valid_to", "last_verified_at")


@dataclass
class LabelFiles:
    """``claims`` to use, ``withdrawn`` ones, ``rejects`` with ``problems``, and ``files`` with digests and counts."""

    claims: DataFrame
    withdrawn: DataFrame
    rejects: DataFrame
    files: DataFrame


def read_label_files(spark: SparkSession, path: str) -> LabelFiles:
    reader = spark.read.option("recursiveFileLookup", "true").option("header", True)
    header = reader.csv(path).columns
    if missing := [c for c in COLUMNS if c not in header]:
        raise ValueError(f"label files lack the columns {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_raw"]])
    rows = reader.schema(schema).option("columnNameOfCorruptRecord", "_raw").option("mode", "PERMISSIVE").csv(path)
    # The copy keeps the raw line: asked alone, that column is not filled.
    rows = cut(rows.withColumn("file", F.col("_metadata.file_path")))
    trimmed = rows.select("file", "_raw", *[F.trim(c).alias("network_key" if c == "network" else c) for c in header])
    dated = trimmed
    for c in DATES:
        dated = dated.withColumn(f"_{c}", F.try_to_timestamp(c)) if c in header else dated.withColumn(c, F.lit(None).cast("string")).withColumn(f"_{c}", F.lit(None).cast("timestamp"))
    wrong = [((F.coalesce(F.col(c), F.lit("")) != "") & F.col(f"_{c}").isNull(), f"bad_{c}") for c in DATES]
    told = label_problems(dated).withColumn("problems", F.when(F.col("_raw").isNotNull(), F.array(F.lit("malformed_row"))).otherwise(
        F.concat("problems", reasons((F.coalesce(F.col("methodology") == "", F.lit(True)), "missing_methodology"), *wrong))
    ))
    told = told.withColumns({c: F.col(f"_{c}") for c in DATES}).drop(*[f"_{c}" for c in DATES])
    good, out = F.size("problems") == 0, _is("review_state", *WITHDRAWN)
    count = lambda c: F.sum(c.cast("long"))
    counts = told.groupBy("file").agg(count(good & ~out).alias("rows_loaded"), count(good & out).alias("rows_withdrawn"), count(~good).alias("rows_rejected"))
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))
    return LabelFiles(
        told.filter(good & ~out).drop("_raw", "problems"),
        told.filter(good & out).drop("_raw", "problems"),
        told.filter(~good).select("file", "source_reference", "_raw", "problems"),
        content.join(counts, "file", "left").na.fill(0),
    )


def snapshot(found: LabelFiles) -> DataFrame:
    """Counts and a fingerprint of the claims that were read, whatever the files are called."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
                              ("network_key", "address", "entity_name", "entity_type", "assertion_type", "address_role", "review_state", "source_reference")])
    digest = digest_of(found.claims.select(F.lit(1).alias("_k"), line.alias("line")), ["_k"], "line").select("_k", F.col("digest").alias("claims_sha256"))
    total = found.files.agg(*[F.sum(c).alias(c) for c in ("rows_loaded", "rows_withdrawn", "rows_rejected")]).withColumn("_k", F.lit(1))
    accepted = found.claims.agg(F.sum(is_control().cast("long")).alias("accepted_service_claims")).withColumn("_k", F.lit(1))
    return total.join(accepted, "_k").join(digest, "_k", "left").drop("_k")
