"""Burn-and-mint transfers between two chains: decode, match, reconcile, link."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.functions import amounts
from rivermark.functions.predicates import first_reason
from rivermark.sources.chainlogs import TRANSFER_TOPIC, ZERO_TOPIC, hex_number, word

# Contracts and log topics of the protocol.
CONTRACTS = {
    "TokenMessengerV2": "0x28b5a0e9c621a5badaa536219b3a228c8168cf5d",
    "TokenMessengerWithFees": "0x71f54f818671cd0d7ea140da213e5c8b5c92a408",
    "MessageTransmitterV2": "0x81d40f21f12a8f0e3252bccb954d722d4c464b64",
}
USDC = {
    "ethereum": "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48",
    "base": "0x833589fcd6edb6e08f4c7c32d4f71b54bda02913",
}
CHAIN_IDS = {"ethereum": 1, "base": 8453}
DEPOSIT_FOR_BURN = "0x0c8c1cbdc5190613ebd485511d4e2812cfa45eecb79d845893331fedad5130a5"
MESSAGE_SENT = "0x8c5261668696ce22758910d05bab8f186d6eb247ceac2af2e82c7dc17669b036"
MESSAGE_RECEIVED = "0xff48c13eda96b1cceacc6b9edeedc9e9db9d6226afbc30146b720c19d3addb1c"
MINT_TOPICS = (
    "0x50c55e915134d457debfa58eb6f4342956f8b0616d51a89a3659360178e1ab63",
    "0x1b2a7ff080b8cb6ff436ce0372e399692bbfb6d4ae5766fd8d58a7b8cc6142e6",
)
LOG = "address STRING, topics ARRAY<STRING>, data STRING, logIndex STRING"
#: Byte offset and length of message fields; the body starts at byte 148.
HEADER = {"version": (0, 4), "source_domain": (4, 4), "destination_domain": (8, 4), "nonce": (12, 32), "sender": (44, 32),
          "recipient": (76, 32), "destination_caller": (108, 32), "min_finality": (140, 4), "finality_executed": (144, 4)}
BODY = {"body_version": (148, 4), "burn_token": (152, 32), "mint_recipient": (184, 32), "amount": (216, 32),
        "message_sender": (248, 32), "max_fee": (280, 32), "fee_executed": (312, 32), "expiration": (344, 32)}
#: Bytes the attestation may not change, as (start, end); the rest of a message is open.
IMMUTABLE = ((0, 12), (44, 144), (148, 312))


def part(message: Column, start: int, length: int) -> Column:
    """Bytes of a message given as hex without prefix."""
    return F.substring(message, 1 + 2 * start, 2 * length)


def decode_message(message: Column) -> Column:
    """Header and burn body of a message; NULL when it is too short."""
    fields = {**HEADER, **BODY}
    addresses, numbers = ("burn_token", "mint_recipient", "message_sender"), ("amount", "max_fee", "fee_executed")

    def value(name: str) -> Column:
        start, length = fields[name]
        raw = part(message, start, length)
        if name in addresses:
            return F.lower(F.concat(F.lit("0x"), F.substring(raw, 25, 40)))
        if name in numbers:
            return amounts.from_hex(raw)
        return hex_number(raw) if length == 4 else F.lower(raw)

    return F.when(F.length(message) >= 2 * 376, F.struct(*[value(n).alias(n) for n in fields]))


def immutable(message: Column) -> Column:
    """The protected bytes of a message, including whatever follows the fixed body."""
    return F.concat(*[part(message, a, b - a) for a, b in IMMUTABLE], F.substr(message, F.lit(1 + 2 * 376)))


def _topic(log: Column, i: int) -> Column:
    return F.lower(F.get(log["topics"], F.lit(i)))


def _logs(contracts: list[str], topics: list[str]) -> Column:
    return F.filter(
        "logs", lambda x: F.lower(x["address"]).isin(*contracts) & F.coalesce(_topic(x, 0).isin(*topics), F.lit(False))
    )


def _address_word(raw: Column) -> Column:
    return F.lower(F.concat(F.lit("0x"), F.substring(raw, 25, 40)))


def burns(receipts: DataFrame, network: str = "ethereum") -> DataFrame:
    """Source messages: the i-th message of a transaction belongs to its i-th burn.

    The logs of a receipt travel with it, so pairing needs no shuffle.
    """
    sent = _logs([CONTRACTS["MessageTransmitterV2"]], [MESSAGE_SENT])
    burned = _logs([CONTRACTS["TokenMessengerV2"], CONTRACTS["TokenMessengerWithFees"]], [DEPOSIT_FOR_BURN])
    ok = receipts.filter(F.col("status").isNull() | (hex_number(F.col("status")) == 1))
    paired = ok.withColumn("s", sent).withColumn("b", burned).withColumn(
        "p", F.slice(F.arrays_zip("s", "b"), F.lit(1), F.least(F.size("s"), F.size("b")))
    )
    rows = paired.select("tx_hash", "block_number", F.size("s").alias("messages"), F.size("b").alias("deposits"), F.posexplode("p").alias("pos", "x"))
    data = F.col("x.b.data")
    length = hex_number(word(F.col("x.s.data"), 1))
    rows = rows.withColumn("message", F.substring(F.col("x.s.data"), F.lit(131), (length * 2).cast("int")))
    fits = (F.length("message") >= 2 * 376) & (F.size("x.b.topics") >= 4) & (F.length(data) >= 2 + 64 * 6)
    ref = lambda log: F.concat_ws(":", F.lit(f"eip155:{CHAIN_IDS[network]}"), "tx_hash", hex_number(log["logIndex"]).cast("string"))
    return rows.filter(fits).select(
        "tx_hash", "pos", "block_number", "messages", "deposits", "message",
        ref(F.col("x.b")).alias("burn_reference"), ref(F.col("x.s")).alias("message_reference"),
        _address_word(F.substring(_topic(F.col("x.b"), 1), 3, 64)).alias("burn_token"),
        _address_word(F.substring(_topic(F.col("x.b"), 2), 3, 64)).alias("depositor"),
        F.lower("x.b.address").alias("burn_contract"),
        amounts.from_hex(word(data, 0)).alias("amount"), _address_word(word(data, 1)).alias("mint_recipient"),
        hex_number(word(data, 2)).alias("destination_domain"), amounts.from_hex(word(data, 5)).alias("max_fee"),
    )


def receives(receipts: DataFrame, network: str = "base") -> DataFrame:
    """Destination messages by nonce, with the mint and the token transfer of their transaction."""
    got = _logs([CONTRACTS["MessageTransmitterV2"]], [MESSAGE_RECEIVED])
    mint = _logs([CONTRACTS["TokenMessengerV2"]], list(MINT_TOPICS))
    paid = F.filter(_logs([USDC[network]], [TRANSFER_TOPIC]), lambda x: (F.size(x["topics"]) >= 3) & (_topic(x, 1) == ZERO_TOPIC))
    rows = receipts.withColumn("g", F.filter(got, lambda x: F.size(x["topics"]) >= 3)).withColumn("m", mint).withColumn("u", paid)
    one = rows.select("tx_hash", "status", "block_number", F.size("g").alias("received"), F.size("m").alias("mints"), F.get("m", F.lit(0)).alias("m"),
                      F.get("u", F.lit(0)).alias("u"), F.explode("g").alias("x"))
    number = lambda log: F.when(F.length(log["data"]) >= 66, amounts.from_hex(word(log["data"], 0)))
    ref = lambda log: F.when(log.isNotNull(), F.concat_ws(":", F.lit(f"eip155:{CHAIN_IDS[network]}"), "tx_hash", hex_number(log["logIndex"]).cast("string")))
    return one.select(
        "tx_hash", F.when(hex_number(F.col("status")) == 1, "success").otherwise("reverted").alias("execution_status"), "block_number", "received", "mints",
        F.lpad(F.substring(_topic(F.col("x"), 2), 3, 64), 64, "0").alias("nonce"),
        hex_number(word(F.col("x.data"), 0)).alias("source_domain"),
        F.substring(F.col("x.data"), 3 + 64 * 4, 2 * 228).alias("body"),
        ref(F.col("x")).alias("receive_reference"), ref(F.col("m")).alias("mint_reference"),
        _address_word(F.substring(F.coalesce(_topic(F.col("m"), 1), _topic(F.col("u"), 2)), 3, 64)).alias("mint_recipient"),
        number(F.col("m")).alias("mint_amount"), number(F.col("u")).alias("transfer_amount"),
    )


MATCH = ["tx_hash", "destination_domain", "burn_token", "mint_recipient", "amount"]


def match_attestations(burned: DataFrame, attestations: DataFrame) -> DataFrame:
    """Attestation of each burn by domain, token, recipient and amount; two candidates are none."""
    start, length = BODY["fee_executed"]
    # Read here, before the shuffle, so the fee is decoded once per attestation.
    read = attestations.withColumn("fee", amounts.from_hex(part(F.col("attested"), start, length)))
    # All steps go by transaction, so burns and attestations are each moved once. A transaction
    # holds few messages; one without hash matches nothing.
    per = read.filter("tx_hash IS NOT NULL").repartition("tx_hash").groupBy(*MATCH).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("status", "attestation", "event_nonce", "attested", "fee")).alias("a")
    )
    seen = per.groupBy("tx_hash").agg(F.collect_list(F.struct(*MATCH[1:], "_n", "a")).alias("_seen"))
    own = F.filter("_seen", lambda x: reduce(Column.__and__, [x[c] == F.col(c) for c in MATCH[1:]]))
    j = burned.join(seen, "tx_hash", "left").withColumn("_own", F.get(own, F.lit(0)))
    j = j.withColumn("_any", F.col("_seen").isNotNull()).drop("_seen").select("*", "_own._n", "_own.a").drop("_own")
    status, seal = F.lower("a.status"), F.lower("a.attestation")
    said = F.when((status == "complete") & F.coalesce(seal != "pending", F.lit(False)), "API_REPORTED_COMPLETE").when(
        status.contains("pending") | F.coalesce(seal.contains("pending"), F.lit(False)), "PENDING"
    ).otherwise(F.upper("a.status"))
    verdict = F.when(~F.col("_any"), "NOT_FOUND").when(F.col("_n") > 1, "AMBIGUOUS").when(F.col("_n").isNull(), "NOT_MATCHED").otherwise(said)
    one = F.col("_n") == 1
    return j.withColumn("attestation_status", verdict).withColumn("nonce", F.when(one, F.lpad(F.lower("a.event_nonce"), 64, "0"))).withColumn(
        "attested", F.when(one, F.col("a.attested"))
    ).withColumn("fee", F.coalesce(F.when(one, F.col("a.fee")), F.lit("0"))).drop("_n", "_any", "a")


def discover_destination(matched: DataFrame, received: DataFrame, source_domain: int = 0) -> DataFrame:
    """Destination transaction per attested nonce: found, not found or ambiguous."""
    hits = received.filter(F.col("source_domain") == source_domain).groupBy("nonce").agg(
        # Whether there are several is all that is asked; counting them would move the rows twice.
        F.when(F.min("tx_hash") < F.max("tx_hash"), 2).otherwise(F.count("tx_hash").cast("boolean").cast("int")).alias("_n"),
        F.min_by(F.struct(*[F.col(c) for c in received.columns if c != "nonce"]), F.struct("tx_hash", "receive_reference")).alias("d"),
    )
    j = matched.join(hits, "nonce", "left")
    status = F.when(F.col("_n").isNull(), "NOT_FOUND").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("FOUND")
    return j.withColumn("discovery", status).withColumn("d", F.when(F.col("_n") == 1, F.col("d"))).drop("_n")


def reconcile(burn: Column, max_fee: Column, fee: Column, mint: Column, paid: Column) -> Column:
    """Burn less fee must equal what was minted and paid; unknown stays unknown."""
    known = F.struct(
        amounts.limbs(burn).alias("b"), amounts.limbs(max_fee).alias("m"), amounts.limbs(fee).alias("f"),
        mint.alias("mint"), paid.alias("paid"),
    )

    def verdict(v: Column) -> Column:
        expected = amounts.subtract(v["b"], v["f"])
        agree = amounts.let(
            expected, lambda e: F.coalesce(v["mint"] == e, F.lit(True)) & F.coalesce(v["paid"] == e, F.lit(True))
        )
        return (
            F.when((v["f"] > v["m"]) | (v["f"] > v["b"]), "MISMATCH")
            .when(v["mint"].isNull() & v["paid"].isNull(), "UNKNOWN")
            .when(~agree, "MISMATCH").otherwise("MATCHES_PROTOCOL_EXPECTATION")
        )

    return amounts.let(known, verdict)


def links(found: DataFrame) -> DataFrame:
    """Status of each burn's journey; the first rule that holds decides."""
    j = found.withColumn(
        "reconciliation", reconcile(F.col("amount"), F.col("max_fee"), F.col("fee"), F.col("d.mint_amount"), F.col("d.transfer_amount"))
    )
    a, e = F.col("attestation_status"), F.col("d.execution_status")
    there = F.col("d.tx_hash").isNotNull() & F.coalesce(e == "success", F.lit(False))
    status = first_reason(
        (a == "AMBIGUOUS", "AMBIGUOUS"), (F.coalesce(e == "reverted", F.lit(False)), "FAILED"), (F.col("reconciliation") == "MISMATCH", "FAILED"),
        (there & F.col("d.receive_reference").isNotNull() & (a == "API_REPORTED_COMPLETE"), "COMPLETE"), (there, "DESTINATION_RECEIVED"),
        (a.isin("API_REPORTED_COMPLETE", "PENDING"), "INCOMPLETE"), (F.lit(True), "MESSAGE_IDENTIFIED"),
    )
    return j.withColumn("linkage_status", status)


def strict_check(linked: DataFrame, blocks: DataFrame, finalized: Column) -> DataFrame:
    """First reason why a link is not strictly proven, or NULL.

    ``blocks`` gives the canonical time of source and destination heights.
    """
    at = lambda n: blocks.select(F.col("block_number").alias(f"{n}_block"), F.col("block_time").alias(f"{n}_time"))
    j = linked.withColumn("s_block", F.col("block_number")).withColumn("d_block", F.col("d.block_number"))
    # Decoded below the joins, so that each message is decoded once.
    j = j.withColumn("src", decode_message(F.col("message"))).withColumn("api", decode_message(F.col("attested")))
    s, a = F.col("src"), F.col("api")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    lim = amounts.limbs
    early = first_reason(
        ((F.col("messages") != 1) | (F.col("deposits") != 1), "more_than_one_message"),
        (no(F.col("block_number") <= finalized), "source_not_final"),
        (no((s["version"] == 1) & (s["body_version"] == 1)), "unsupported_version"),
        (no((s["source_domain"] == 0) & (s["destination_domain"] == F.col("destination_domain"))), "unsupported_domain"),
        (no((s["amount"] == F.col("amount")) & (s["mint_recipient"] == F.col("mint_recipient")) & (s["burn_token"] == F.col("burn_token"))
            & (s["message_sender"] == F.col("depositor")) & (s["max_fee"] == F.col("max_fee"))), "burn_fields_differ"),
        (no(F.col("attestation_status") == "API_REPORTED_COMPLETE"), "attestation_incomplete"),
        (no(immutable(F.col("attested")) == immutable(F.col("message"))), "immutable_bytes_differ"),
        (no((a["nonce"] == F.col("nonce")) & (a["nonce"] != "0" * 64)), "nonce_differs"),
        (no((a["finality_executed"] >= a["min_finality"]) & (lim(a["fee_executed"]) <= lim(a["max_fee"]))), "fee_or_finality_violated"),
        (no(F.col("discovery") == "FOUND"), "destination_not_unique"),
        (no(F.col("d.execution_status") == "success"), "destination_not_successful"),
        (no(F.col("d.block_number") <= finalized), "destination_not_final"),
    )
    late = first_reason(
        (no((F.col("d.received") == 1) & (F.col("d.mints") == 1)), "destination_not_single"),
        (no(F.col("d.mint_recipient") == F.col("mint_recipient")), "recipient_differs"),
        (no(F.lower("d.body") == F.lower(F.substring(F.col("attested"), 1 + 2 * 148, 2 * 228))), "body_differs"),
        (no(F.col("reconciliation") == "MATCHES_PROTOCOL_EXPECTATION"), "amount_differs"),
    )
    # All but the order of times is known before the times are, so messages are not moved for them.
    j = j.withColumn("_early", early).withColumn("_late", F.when(F.col("_early").isNull(), late)).drop("src", "api")
    j = j.join(at("s"), "s_block", "left").join(at("d"), "d_block", "left")
    reason = F.coalesce("_early", F.when(no(F.col("d_time") >= F.col("s_time")), "destination_before_source"), "_late")
    return j.withColumn("failure", reason).withColumn("matched", F.col("failure").isNull()).drop("_early", "_late")


def link_transfers(linked: DataFrame) -> DataFrame:
    """Each link as a burn row and a mint row."""
    rows = F.array(
        F.struct(F.lit("ethereum").alias("network"), F.lit("cctp_burn").alias("event_type"), F.col("tx_hash").alias("tx"), F.col("depositor").alias("from_address"),
                 F.lit(CONTRACTS["TokenMessengerV2"]).alias("to_address"), F.col("amount").alias("amount_base_units")),
        F.struct(F.lit("base").alias("network"), F.lit("cctp_mint").alias("event_type"), F.col("d.tx_hash").alias("tx"), F.lit("0x" + "0" * 40).alias("from_address"),
                 F.col("mint_recipient").alias("to_address"), F.col("d.mint_amount").alias("amount_base_units")),
    )
    return linked.select("burn_reference", F.explode(rows).alias("r")).select("burn_reference", "r.*")


def continuation_tasks(checked: DataFrame, existing: DataFrame) -> DataFrame:
    """One address-discovery task per proven link that has none yet."""
    fresh = checked.filter("matched").join(existing.select("burn_reference"), "burn_reference", "left_anti")
    return fresh.select(
        "burn_reference", F.lit("base").alias("network_key"), F.lit(USDC["base"]).alias("token_contract"), F.col("mint_recipient").alias("address"),
        F.lit("address_discovery").alias("mode"), F.lit(None).cast("string").alias("seed_event_reference"), F.col("d_time").alias("analysis_start"),
    )
