"""Exact amounts, addresses and predicates."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivermark.functions import addresses, amounts
from rivermark.functions.predicates import strictly_after

TOP = 2**256 - 1
EDGES = [0, 1, 9, 10**25, 10**26 - 1, 10**26, 10**52 - 1, 10**52, 2**64, 2**128, TOP - 1, TOP]


def column(spark, values):
    return spark.createDataFrame([(str(v),) for v in values], "a string")


def test_round_trip_and_hex(spark):
    df = column(spark, EDGES).select("a", amounts.render(amounts.limbs(F.col("a"))).alias("b"))
    assert all(r.a == r.b for r in df.collect())
    hexed = spark.createDataFrame([(f"{v:064x}", str(v)) for v in EDGES], "h string, a string")
    assert all(r.a == r.b for r in hexed.select("a", amounts.from_hex(F.col("h")).alias("b")).collect())
    assert hexed.limit(1).select(amounts.from_hex(F.lit("zz"))).first()[0] is None


def test_sum_is_exact_past_uint256(spark):
    df = column(spark, [TOP] * 1000 + [7]).repartition(5)
    assert df.agg(amounts.sum_units(F.col("a"))).first()[0] == str(TOP * 1000 + 7)


def test_is_amount_refuses_signs_floats_and_overflow(spark):
    rows = [("12", True), ("0", True), ("-1", False), ("1.0", False), ("", False), ("1e5", False), (str(TOP), True),
            (str(TOP + 1), False), ("٣", False), (None, False), ("12\n", False), ("0" * 90 + "5", True)]
    df = spark.createDataFrame(rows, "a string, ok boolean")
    assert all(r.ok == r.got for r in df.select("ok", amounts.is_amount(F.col("a")).alias("got")).collect())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, TOP), st.integers(0, TOP), st.integers(1, 105)), min_size=20, max_size=40))
def test_arithmetic_matches_integers(spark, triples):
    df = spark.createDataFrame([(str(a), str(b)) for a, b, _ in triples], "a string, b string")
    a, b = amounts.limbs(F.col("a")), amounts.limbs(F.col("b"))
    out = df.select(
        "a", "b", amounts.subtract(a, b).alias("d"), amounts.render(amounts.add(a, b)).alias("s"),
        amounts.render(amounts.scaled(a, 85)).alias("m"), (a < b).alias("lt"),
    )
    for r in out.collect():
        x, y = int(r.a), int(r.b)
        assert (int(r.d), int(r.s), int(r.m), r["lt"]) == (x - y, x + y, 85 * x, x < y)


def test_display(spark):
    rows = [("1500000", 6, "1.500000"), ("5", 6, "0.000005"), ("7", 0, "7"), (str(TOP), 18, f"{str(TOP)[:-18]}.{str(TOP)[-18:]}")]
    df = spark.createDataFrame(rows, "a string, d int, want string")
    back = amounts.from_display(F.col("want"), F.col("d"))
    for r in df.select("*", amounts.to_display(F.col("a"), F.col("d")).alias("got"), back.alias("back")).collect():
        assert (r.got, r.back) == (r.want, r.a)
    odd = spark.createDataFrame([("1.5", 0), ("1.50", 1), ("x", 2)], "a string, d int")
    assert [r[0] for r in odd.select(amounts.from_display(F.col("a"), F.col("d"))).collect()] == [None, "15", None]


def base58check(payload: bytes) -> str:
    raw = payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        out = addresses.ALPHABET[d] + out
    return out


def test_tron_addresses(spark):
    payloads = [b"\x41" + hashlib.sha256(bytes([i])).digest()[:20] for i in range(20)]
    rows = [("tron", base58check(p), p.hex()) for p in payloads]
    df = addresses.canonicalize(spark.createDataFrame(rows, "network_key string, address string, want string"))
    got = {r.address: r.canonical for r in df.collect()}
    assert got == {a: w for _, a, w in rows}
    shown = spark.createDataFrame([(w, a) for _, a, w in rows], "k string, a string")
    assert all(r.a == r.b for r in shown.select("a", addresses.display_tron(F.col("k")).alias("b")).collect())
    good = rows[0][1]
    bad = [(good[:-1] + ("1" if good[-1] != "1" else "2"), "bad_checksum"), (good[:-1] + "0", "bad_alphabet"),
           ("Tshort", "wrong_shape"), ("", "empty"), ("42" + "0" * 40, "wrong_prefix")]
    frame = spark.createDataFrame([("tron", a) for a, _ in bad], "network_key string, address string")
    assert {r.address: r.reason for r in addresses.canonicalize(frame).collect()} == dict(bad)


def test_strictly_after(spark):
    rows = [(2, "a", 1, "z", True), (1, "b", 1, "a", True), (1, "a", 1, "a", False), (1, None, 1, "a", False),
            (None, "b", 5, "a", True), (1, "z", 2, "a", False), (1, "a", None, None, True)]
    df = spark.createDataFrame(rows, "t long, s string, t0 long, s0 string, want boolean")
    got = df.select("want", strictly_after(F.col("t"), F.col("s"), F.col("t0"), F.col("s0")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_hex_numbers_of_any_length(spark):
    from rivermark.sources.chainlogs import hex_number

    rows = [("0x0000000000000000000001", 1), ("0X" + "0" * 64 + "ff", 255), ("7fffffffffffffff", 2**63 - 1), ("8000000000000000", None),
            ("f" * 64, None), ("0x", None), ("", None), (None, None), ("0x1g", None), ("0", 0), ("00", 0)]
    df = spark.createDataFrame(rows, "h string, n long")
    assert all(r.n == r.got for r in df.select("n", hex_number(F.col("h")).alias("got")).collect())


def test_an_address_is_decoded_once(spark):
    from rivermark.functions import addresses

    rows = spark.createDataFrame([("tron", "T" + "1" * 33), ("tron", "41" + "a" * 40), ("evm", "0x" + "A" * 40), ("tron", None)], "network_key string, address string")
    out = addresses.canonicalize(rows)
    # The decoder names its alphabet three times.
    assert out._jdf.queryExecution().optimizedPlan().toString().count(addresses.ALPHABET) == 3
    assert {(r.address, r.canonical, r.reason, r.format) for r in out.collect()} == {
        ("T" + "1" * 33, None, "bad_checksum", "invalid"), ("41" + "a" * 40, "41" + "a" * 40, None, "tron_hex"),
        ("0x" + "A" * 40, "0x" + "a" * 40, None, "hex_lowercase"), (None, None, "empty", "invalid"),
    }
