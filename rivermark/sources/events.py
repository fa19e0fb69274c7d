"""Transfer events from fixture documents and account histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivermark.functions.predicates import first_reason
from rivermark.scale import cut

EVENT = (
    "event_reference STRING, tx_hash STRING, event_kind STRING,"
    " asset STRUCT<token_contract: STRING, decimals: INT, display_symbol: STRING>,"
    " from_address STRING, to_address STRING, amount_base_units STRING, execution_status STRING,"
    " confirmation_state STRING, block_height BIGINT, index_in_block INT, event_index INT,"
    " block_hash STRING, parent_block_hash STRING, block_time TIMESTAMP, ordering_ambiguous BOOLEAN"
)


def _fixture_schema(*more: T.StructField) -> T.StructType:
    return T.StructType(
        [
            T.StructField("data_mode", T.StringType()),
            T.StructField("network", T.StringType()),
            T.StructField("capture_time", T.TimestampType()),
            T.StructField("events", T.ArrayType(T.StructType.fromDDL(EVENT))),
            *more,
        ]
    )


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Events of fixture documents, with the documented defaults. LIVE documents are refused."""
    docs = spark.read.schema(_fixture_schema()).json(path, multiLine=True)
    live = F.coalesce(F.col("data_mode"), F.lit("SYNTHETIC")) == "LIVE"
    checked = F.when(live, F.raise_error(F.lit("a fixture must not declare data_mode=LIVE"))).otherwise(F.col("data_mode"))
    return fixture_rows(docs.withColumn("data_mode", checked))


def read_fixtures(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Events of many documents, one per file or line, and the refused documents with a reason.

    Events come with their position in the chain; rows of one network are in order by it.
    """
    schema = _fixture_schema(T.StructField("_raw", T.StringType()))
    docs = cut(spark.read.schema(schema).option("columnNameOfCorruptRecord", "_raw").json(path, multiLine=not lines))
    reason = first_reason(
        (F.col("_raw").isNotNull(), "malformed_document"),
        (F.coalesce(F.col("data_mode") == "LIVE", F.lit(False)), "live_data_in_a_fixture"),
        (F.col("network").isNull() | F.col("events").isNull(), "missing_network_or_events"),
    )
    told = docs.withColumn("reason", reason)
    return fixture_rows(told.filter("reason IS NULL")), told.filter("reason IS NOT NULL").select("reason", "_raw")


def fixture_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select("network", "data_mode", F.explode("events").alias("e"))
    return rows.select("network", "data_mode", "e.*").select(
        F.col("network").alias("network_key"), F.coalesce("data_mode", F.lit("SYNTHETIC")).alias("data_mode"),
        F.col("asset.token_contract").alias("token_contract"), F.col("asset.decimals").alias("decimals"),
        "event_reference", "tx_hash", F.coalesce("event_kind", F.lit("transfer")).alias("event_kind"),
        "from_address", "to_address", "amount_base_units",
        F.coalesce("execution_status", F.lit("success")).alias("execution_status"),
        F.coalesce("confirmation_state", F.lit("confirmed")).alias("confirmation_state"),
        "block_height", "index_in_block", "event_index", "block_time",
        (F.coalesce("ordering_ambiguous", F.lit(False)) | F.col("event_index").isNull()).alias("ordering_ambiguous"),
        sequence(F.col("block_height"), F.col("index_in_block"), F.col("event_index")).alias("chain_sequence"),
    )


def sequence(height: Column, tx_index: Column, log_index: Column) -> Column:
    """Sortable position text; NULL when any part is unknown."""
    return F.when(
        height.isNotNull() & tx_index.isNotNull() & log_index.isNotNull(),
        F.format_string("%012d:%06d:%06d", height, tx_index, log_index),
    )


def transfer_scan(
    events: DataFrame, address: str, direction: str, start: Column, cutoff: Column, contract: Column | None = None
) -> DataFrame:
    """Filter a transfer table the way a provider query would. Unknown times pass."""
    sent, got = F.col("from_address") == address, F.col("to_address") == address
    side = {"outgoing": sent, "incoming": got, "both": sent | got}[direction]
    out = events.filter(side)
    if contract is not None:
        out = out.filter(F.col("token_contract") == contract)
    return out.filter(
        F.coalesce(F.col("block_time") <= cutoff, F.lit(True)) & F.coalesce(F.col("block_time") >= start, F.lit(True))
    )


def event_search(events: DataFrame, order: str, after: Column, limit: int) -> DataFrame:
    """One page in key order; a further page exists when ``has_more``."""
    # An ordered limit keeps n rows per task, so only n per task meet at the end.
    page = events.filter(F.col(order) > after).orderBy(order).limit(limit + 1)
    numbered = page.withColumn("_n", F.row_number().over(Window.orderBy(order)))
    more = F.max("_n").over(Window.partitionBy()) > limit
    return numbered.withColumn("has_more", more).filter(F.col("_n") <= limit).drop("_n")


# History row types.
KINDS = {"Transfer": "transfer", "Approval": "approval"}


def content_key(sender: Column, recipient: Column, value: Column) -> Column:
    return F.concat_ws("|", F.lower(sender), F.lower(recipient), value)


def normalize_history(rows: DataFrame, indices: DataFrame | None = None) -> DataFrame:
    """History rows to transfers. History proves inclusion, not execution.

    ``indices`` holds ``tx_hash, content_key, event_index`` for transactions whose
    events could be told apart. Without an index the reference is a content hash.
    """
    key = content_key(F.col("from"), F.col("to"), F.col("value"))
    keyed = rows.withColumn("content_key", key).withColumnRenamed("transaction_id", "tx_hash")
    joined = (
        keyed.join(indices, ["tx_hash", "content_key"], "left")
        if indices is not None
        else keyed.withColumn("event_index", F.lit(None).cast("bigint"))
    )
    kind = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in KINDS.items()], F.lit("unknown"))
    digest = F.substring(F.sha2("content_key", 256), 1, 16)
    return joined.select(
        F.when(F.col("event_index").isNull(), F.concat_ws(":", F.lit("tron"), "tx_hash", F.lit("unindexed"), digest))
        .otherwise(F.concat_ws(":", F.lit("tron"), "tx_hash", F.col("event_index").cast("string")))
        .alias("event_reference"),
        "tx_hash", kind.alias("event_kind"), F.col("token_info.address").alias("token_contract"),
        F.col("token_info.decimals").alias("decimals"), F.col("from").alias("from_address"),
        F.col("to").alias("to_address"), F.col("value").alias("amount_base_units"),
        F.lit("unknown").alias("execution_status"), F.lit("confirmed").alias("confirmation_state"),
        F.timestamp_millis("block_timestamp").alias("block_time"), "event_index",
        F.col("event_index").isNull().alias("ordering_ambiguous"),
    )


def resolve_event_index(event_rows: DataFrame, contract: Column) -> DataFrame:
    """Index per content key; a transaction with a repeated key stays ambiguous as a whole."""
    usable = event_rows.filter(
        (F.col("event_name") == "Transfer") & (F.col("contract_address") == contract)
        & F.col("event_index").isNotNull() & F.col("from").isNotNull() & F.col("to").isNotNull() & F.col("value").isNotNull()
    ).withColumn("content_key", content_key(F.col("from"), F.col("to"), F.col("value")))
    per_key = usable.groupBy("tx_hash", "content_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_index").alias("event_index")
    )
    clear = per_key.groupBy("tx_hash").agg(F.max("n").alias("most")).filter("most = 1").select("tx_hash")
    return per_key.join(clear, "tx_hash", "left_semi").select("tx_hash", "content_key", "event_index")


def reconcile_events(transfers: DataFrame, event_rows: DataFrame) -> DataFrame:
    """Does a transaction's event detail describe the transfer? Near misses do not count."""
    detail = event_rows.filter("event_name = 'Transfer'")
    exact = detail.select(
        "tx_hash", F.col("contract_address").alias("token_contract"),
        content_key(F.col("from"), F.col("to"), F.col("value")).alias("content_key"),
    ).distinct().withColumn("hit", F.lit(True))
    known = detail.select("tx_hash").distinct().withColumn("known", F.lit(True))
    keyed = transfers.withColumn("content_key", content_key(F.col("from_address"), F.col("to_address"), F.col("amount_base_units")))
    joined = keyed.join(exact, ["tx_hash", "token_contract", "content_key"], "left").join(known, "tx_hash", "left")
    matched = F.coalesce("hit", F.lit(False))
    reason = first_reason((matched, "agrees"), (F.col("known").isNull(), "no_event_detail"), (F.lit(True), "no_matching_event"))
    return joined.select("event_reference", matched.alias("matched"), reason.alias("reason"))


def classify_receipts(receipts: DataFrame) -> DataFrame:
    """Execution and confirmation of receipts; only the exact success word is success."""
    raw = F.col("result")
    return receipts.select(
        "tx_hash",
        F.when(raw.isNull(), "unknown").when(raw == "SUCCESS", "success").when(raw == "REVERT", "reverted")
        .otherwise("failed").alias("execution_status"),
        F.when(F.col("solidified"), "confirmed").otherwise("provisional").alias("confirmation_state"),
    )


def verify_execution(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """Set both status axes from one receipt per transaction; missing means unknown."""
    dim = receipts.select("tx_hash", F.col("execution_status").alias("_e"), F.col("confirmation_state").alias("_c")).withColumn("_r", F.lit(True))
    j = events.join(dim, "tx_hash", "left")
    reason = first_reason((F.col("_r").isNull(), "receipt_unavailable"), (F.col("_e") == "unknown", "result_not_stated"))
    return (
        j.withColumn("unverified", reason)
        .withColumn("execution_status", F.coalesce("_e", F.lit("unknown")))
        .withColumn("confirmation_state", F.coalesce("_c", F.lit("unknown")))
        .drop("_e", "_c", "_r")
    )


def receipt_gate(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """Verify everything but removed events: no receipt brings a removed log back."""
    gone = F.coalesce(F.col("confirmation_state") == "removed", F.lit(False))
    kept = events.filter(gone).withColumn("unverified", F.lit(None).cast("string"))
    return verify_execution(events.filter(~gone), receipts).unionByName(kept)


ACCOUNT_ROW = (
    "txID STRING, blockNumber BIGINT, block_timestamp BIGINT, raw_data STRUCT<contract: ARRAY<STRUCT<type: STRING,"
    " parameter: STRUCT<value: MAP<STRING, STRING>>>>>, ret ARRAY<STRUCT<contractRet: STRING>>"
)


def parse_account_history(rows: DataFrame, column: str = "body") -> DataFrame:
    """First contract of each account transaction, from its JSON text."""
    r = rows.withColumn("r", F.from_json(column, ACCOUNT_ROW))
    contract = F.get("r.raw_data.contract", F.lit(0))
    return r.select(
        F.col("r.txID").alias("tx_id"), F.col("r.blockNumber").alias("block_number"),
        F.timestamp_millis("r.block_timestamp").alias("block_time"),
        contract["type"].alias("contract_type"), contract["parameter"]["value"].alias("contract_value"),
        F.get("r.ret", F.lit(0))["contractRet"].alias("execution_result"),
    )


DELEGATION_INDEX = "account STRING, fromAccounts ARRAY<STRING>, toAccounts ARRAY<STRING>"
DELEGATION_DETAIL = (
    "delegatedResource ARRAY<STRUCT<from: STRING, to: STRING, frozen_balance_for_energy: BIGINT,"
    " frozen_balance_for_bandwidth: BIGINT, expire_time_for_energy: BIGINT, expire_time_for_bandwidth: BIGINT>>"
)


def parse_delegation_index(rows: DataFrame, column: str = "body") -> DataFrame:
    """Who delegates to whom, from the account index. No resource, amount or time is stated."""
    r = rows.select(F.from_json(column, DELEGATION_INDEX).alias("r")).filter("trim(r.account) <> ''")
    inward = F.transform(F.coalesce("r.fromAccounts", F.array().cast("array<string>")),
                         lambda s: F.struct(s.alias("sponsor"), F.trim("r.account").alias("receiver")))
    outward = F.transform(F.coalesce("r.toAccounts", F.array().cast("array<string>")),
                          lambda t: F.struct(F.trim("r.account").alias("sponsor"), t.alias("receiver")))
    return r.select(F.explode(F.concat(inward, outward)).alias("d")).select(
        "d.*", F.lit(None).cast("string").alias("resource"), F.lit(None).cast("bigint").alias("balance"),
        F.lit(None).cast("timestamp").alias("lock_expires_at"),
    )


def parse_delegation_detail(rows: DataFrame, column: str = "body") -> DataFrame:
    """One row per resource with a positive balance; expiry 0 means no lock."""
    r = rows.select(F.explode(F.from_json(column, DELEGATION_DETAIL)["delegatedResource"]).alias("d"))
    both = F.array(*[
        F.struct(
            F.lit(n).alias("resource"), F.col(f"d.frozen_balance_for_{n}").alias("balance"),
            F.timestamp_millis(F.nullif(F.col(f"d.expire_time_for_{n}"), F.lit(0))).alias("lock_expires_at"),
        )
        for n in ("energy", "bandwidth")
    ])
    named = r.filter("trim(d.from) <> '' AND trim(d.to) <> ''")
    return named.select(F.trim("d.from").alias("sponsor"), F.trim("d.to").alias("receiver"), F.explode(both).alias("x")).filter(
        "x.balance > 0"
    ).select("sponsor", "receiver", "x.*")
