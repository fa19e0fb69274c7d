"""Token logs, blocks and receipts of EVM chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.functions import amounts
from rivermark.functions.predicates import first_reason
from rivermark.scale import HOT_ROWS, dim_join, running_before, with_cells

# Fixed value: the first topic of a token transfer.
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
ZERO_TOPIC = "0x" + "0" * 64


#: A hex number of any length whose value fits a BIGINT.
HEX_NUMBER = r"^(0[xX])?0*([0-7][0-9a-fA-F]{15}|[0-9a-fA-F]{1,15})\z"


def hex_number(c: Column) -> Column:
    """Hex text of any length to BIGINT; NULL when it is no number or above the range."""
    return F.when(c.rlike(HEX_NUMBER), F.conv(F.regexp_extract(c, HEX_NUMBER, 2), 16, 10).cast("bigint"))


def word(data: Column, index: int = 0) -> Column:
    """The 64 hex digits of one 32-byte word of ``0x`` data."""
    return F.substring(data, 3 + 64 * index, 64)


def decode_transfer_logs(logs: DataFrame, contract: Column) -> DataFrame:
    """Strict token transfer decode; whatever does not fit the exact shape is left out.

    All shape tests look at the raw fields, so each decoded value is computed once
    and only for logs that stay.
    """
    topic = lambda i: F.get("topics", F.lit(i))
    plain = lambda c: c.rlike(r"^0x0{24}[0-9a-fA-F]{40}\z")
    shaped = logs.filter(
        (F.size("topics") == 3) & (F.lower(topic(0)) == TRANSFER_TOPIC) & plain(topic(1)) & plain(topic(2))
        & F.col("data").rlike(r"^0x[0-9a-fA-F]{64}\z") & (F.col("transactionHash") != "")
        & F.col("logIndex").rlike(HEX_NUMBER) & (F.lower("address") == contract)
    )
    low = lambda i: F.lower(F.concat(F.lit("0x"), F.substring(topic(i), 27, 40)))
    out = shaped.select(
        "chain_id", F.lower("address").alias("token_contract"), F.col("transactionHash").alias("tx_hash"),
        hex_number(F.col("logIndex")).alias("event_index"), hex_number(F.col("blockNumber")).alias("block_height"),
        hex_number(F.col("transactionIndex")).alias("index_in_block"),
        low(1).alias("from_address"), low(2).alias("to_address"),
        amounts.from_hex(word(F.col("data"))).alias("amount_base_units"),
        F.when(F.coalesce("removed", F.lit(False)), "removed").otherwise("unknown").alias("confirmation_state"),
    )
    return out.select(
        F.concat_ws(":", F.lit("eip155"), "chain_id", "tx_hash", F.col("event_index").cast("string")).alias("event_reference"),
        "*", F.lit("transfer").alias("event_kind"), F.lit("unknown").alias("execution_status"),
        (F.col("block_height").isNull() | F.col("index_in_block").isNull()).alias("ordering_ambiguous"),
    )


def union_dedupe_logs(incoming: DataFrame, outgoing: DataFrame, blocks: DataFrame) -> DataFrame:
    """Both directions as one set of events, with block time; of unequal copies the smallest row stays."""
    both = incoming.unionByName(outgoing)
    events = both.groupBy("event_reference").agg(F.min(F.struct(*both.columns)).alias("r")).select("r.*")
    return events.join(blocks.select("chain_id", "block_height", "block_time"), ["chain_id", "block_height"], "left")


def block_ranges(windows: DataFrame, blocks: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Block bounds of time windows.

    The end is the last block at or before the cutoff, the start the last block
    strictly before the start. Windows and blocks of a network are put in one
    time order and a running maximum answers all windows in a single pass.
    """
    low = windows.select("network_key", "window_id", F.unix_seconds("start").alias("at"), F.lit(0).alias("kind"))
    high = windows.select("network_key", "window_id", F.unix_seconds("cutoff").alias("at"), F.lit(2).alias("kind"))
    marks = low.unionByName(high).filter("at IS NOT NULL").withColumn("height", F.lit(None).cast("bigint"))
    points = blocks.select(
        "network_key", F.lit(None).cast("string").alias("window_id"), F.unix_seconds("block_time").alias("at"),
        F.lit(1).alias("kind"), F.col("block_height").alias("height"),
    )
    line = with_cells(marks.unionByName(points), ["network_key"], F.col("at"), 86_400, hot_rows)
    seen = running_before(line, ["network_key"], ["at", "kind"], {"upto": (F.max, F.col("height"))})
    bound = lambda k, n: seen.filter(F.col("kind") == k).select("window_id", F.coalesce("upto", F.lit(0)).cast("long").alias(n))
    head = blocks.groupBy("network_key").agg(F.max("block_time").alias("head_time"))
    out = (
        windows.join(bound(0, "from_block"), "window_id", "left").join(bound(2, "to_block"), "window_id", "left")
        .join(head, "network_key", "left")
    )
    truncated = first_reason(
        (F.col("cutoff") > F.col("head_time"), "cutoff_after_head"), (F.col("start") > F.col("head_time"), "start_after_head")
    )
    return out.select(
        "window_id", "network_key",
        F.least(F.coalesce("from_block", F.lit(0)), "to_block").cast("long").alias("from_block"), "to_block", truncated.alias("truncated_reason"),
    )


def receipt_finality(receipts: DataFrame, tags: DataFrame) -> DataFrame:
    """Finality from the network's reported heights, never from confirmation depth."""
    j = dim_join(receipts, tags, ["network_key"], "left", ["tx_hash"])
    h, final, safe = F.col("block_height"), F.col("finalized"), F.col("safe")
    detail = (
        F.when(h.isNull(), "unknown").when(h <= final, "finalized").when(h <= safe, "safe")
        .when(final.isNotNull() | safe.isNotNull(), "head_unfinalized").otherwise("unknown")
    )
    status = hex_number(F.col("status"))
    return j.select(
        "tx_hash",
        F.when(status.isNull(), "unknown").when(status == 1, "success").otherwise("reverted").alias("execution_status"),
        detail.alias("finality"),
        F.when(detail == "finalized", "confirmed").when(detail == "unknown", "unknown").otherwise("provisional").alias("confirmation_state"),
    )


def verify_token_metadata(assets: DataFrame, captured: DataFrame) -> DataFrame:
    """Configured assets against what the chain reported about their contract."""
    j = assets.join(captured.select("network_key", "token_contract", "code", F.col("decimals").alias("seen")), ["network_key", "token_contract"], "left")
    code = F.coalesce(F.length("code") > 2, F.lit(False))
    problem = first_reason((~code, "no_contract_code"), (~F.col("seen").eqNullSafe(F.col("decimals")), "decimals_differ"))
    return j.select("network_key", "token_contract", "decimals", F.col("seen").alias("observed_decimals"), problem.alias("problem"))
