"""Address canonicalisation as column expressions.

A TRON address is 25 bytes: prefix 41, 20 bytes, 4 checksum bytes. Base 58 is
read and written over seven 32-bit limbs held as BIGINT, so nothing overflows
and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.functions.predicates import first_reason

# The base 58 alphabet and the network prefix.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
TRON_PREFIX = "41"
LIMBS = 7
WORD = 2**32


def _longs(*values: Column) -> Column:
    return F.array(*values).cast("array<bigint>")


def checksum(payload_hex: Column) -> Column:
    """First four bytes of the double SHA-256, as hex."""
    return F.substring(F.sha2(F.unhex(F.sha2(F.unhex(payload_hex), 256)), 256), 1, 8)


def base58_to_hex(text: Column) -> Column:
    """50 hex digits of a base 58 string, or NULL when it does not fit 25 bytes."""
    digits = F.transform(
        F.filter(F.split(text, ""), lambda c: c != ""),
        lambda c: (F.instr(F.lit(ALPHABET), c) - 1).cast("bigint"),
    )

    def times_58_plus(limbs: Column, digit: Column) -> Column:
        start = F.struct(_longs().alias("out"), digit.alias("carry"))

        def step(st: Column, limb: Column) -> Column:
            v = limb * 58 + st["carry"]
            return F.struct(
                F.concat(st["out"], _longs(v % WORD)).alias("out"),
                F.call_function("div", v, F.lit(WORD)).alias("carry"),
            )

        return F.aggregate(limbs, start, step, lambda st: st["out"])

    little = F.aggregate(digits, _longs(*[F.lit(0)] * LIMBS), times_58_plus)
    hexed = F.lower(F.array_join(F.transform(F.reverse(little), lambda v: F.lpad(F.hex(v), 8, "0")), ""))
    clean = F.forall(digits, lambda d: d >= 0) & (F.substring(hexed, 1, 6) == "000000")
    return F.when(clean, F.substring(hexed, 7, 50))


def hex_to_base58(hex50: Column) -> Column:
    """Base 58 text of 25 bytes that start with the TRON prefix (34 characters)."""
    big = F.transform(
        F.sequence(F.lit(0), F.lit(LIMBS - 1)),
        lambda i: F.conv(F.substring(F.concat(F.lit("000000"), hex50), i * 8 + F.lit(1), F.lit(8)), 16, 10).cast("bigint"),
    )

    def divide(st: Column, _: Column) -> Column:
        start = F.struct(_longs().alias("out"), F.lit(0).cast("bigint").alias("rem"))

        def step(s: Column, limb: Column) -> Column:
            cur = s["rem"] * WORD + limb
            return F.struct(
                F.concat(s["out"], _longs(F.call_function("div", cur, F.lit(58)))).alias("out"),
                (cur % 58).alias("rem"),
            )

        done = F.aggregate(st["limbs"], start, step)
        return F.struct(
            done["out"].alias("limbs"),
            F.concat(F.substring(F.lit(ALPHABET), (done["rem"] + 1).cast("int"), F.lit(1)), st["text"]).alias("text"),
        )

    first = F.struct(big.alias("limbs"), F.lit("").alias("text"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(34)), first, divide, lambda st: st["text"])


def _tron_shape(value: Column) -> tuple[Column, Column, Column, Column]:
    """Trimmed text, the same without ``0x``, whether that is hex, whether the text looks like base 58."""
    v = F.trim(value)
    bare = F.when(F.lower(v).startswith("0x"), F.substr(v, F.lit(3))).otherwise(v)
    return v, bare, bare.rlike(r"^[0-9a-fA-F]{42}\z"), v.startswith("T") & (F.length(v) == 34)


def tron_raw(value: Column) -> Column:
    """The decoded base 58 text of an address that has its shape."""
    v, _, is_hex, shaped = _tron_shape(value)
    return F.when(shaped & ~is_hex, base58_to_hex(v))


def canonical_tron(value: Column, raw: Column | None = None) -> tuple[Column, Column]:
    """``(41-hex key, reason)``; exactly one of the two is NULL.

    ``raw`` is a column with ``tron_raw`` where a caller keeps one, so that it is worked out once.
    """
    v, bare, is_hex, shaped = _tron_shape(value)
    raw = tron_raw(value) if raw is None else raw
    payload = F.substring(raw, 1, 42)
    reason = first_reason(
        (F.coalesce(v == "", F.lit(True)), "empty"),
        (is_hex & (F.substring(bare, 1, 2) != TRON_PREFIX), "wrong_prefix"),
        (~is_hex & ~shaped, "wrong_shape"),
        (~is_hex & raw.isNull(), "bad_alphabet"),
        (~is_hex & (checksum(payload) != F.substring(raw, 43, 8)), "bad_checksum"),
        (~is_hex & (F.substring(payload, 1, 2) != TRON_PREFIX), "wrong_prefix"),
    )
    return F.when(reason.isNull(), F.when(is_hex, F.lower(bare)).otherwise(payload)), reason


def canonical_evm(value: Column) -> tuple[Column, Column]:
    v = F.trim(value)
    good = F.coalesce(v.rlike(r"^0x[0-9a-fA-F]{40}\z"), F.lit(False))
    reason = first_reason((F.coalesce(v == "", F.lit(True)), "empty"), (~good, "wrong_shape"))
    return F.when(good, F.lower(v)), reason


def canonicalize(rows: DataFrame, network: str = "network_key", address: str = "address") -> DataFrame:
    """Distinct addresses with canonical key, format and reason; invalid ones are kept."""
    once = rows.select(network, address).distinct()
    tron = F.col(network) == "tron"
    # Columns that are read more than once are steps of their own, so decoding runs once a row.
    once = once.withColumn("_raw", F.when(tron, tron_raw(F.col(address))))
    tron_reason = canonical_tron(F.col(address), F.col("_raw"))[1]
    evm_reason = canonical_evm(F.col(address))[1]
    once = once.withColumn("reason", F.when(tron, tron_reason).otherwise(evm_reason))
    good = F.col("reason").isNull()
    hexed = F.when(F.col("_raw").isNull(), _tron_shape(F.col(address))[1]).otherwise(F.substring("_raw", 1, 42))
    out = once.withColumn("canonical", F.when(good, F.when(tron, F.lower(hexed)).otherwise(F.lower(F.trim(F.col(address))))))
    out = out.withColumn(
        "format", F.when(F.col("reason").isNotNull(), "invalid").when(tron, "tron_hex").otherwise("hex_lowercase")
    )
    return out.select(network, address, "canonical", "reason", "format")


def display_tron(key: Column) -> Column:
    """Base 58 form of a 41-hex key, for people."""
    return hex_to_base58(F.concat(key, checksum(key)))
