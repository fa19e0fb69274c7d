"""Exact unsigned 256-bit amounts.

An amount travels as a decimal string. For arithmetic it becomes three limbs of
26 digits, ``hi, mid, lo``, each ``DECIMAL(38,0)``, which leaves room to add
10^12 of them before one carry at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_DIGITS = 26
WIDTH = 3 * BASE_DIGITS
UINT256_MAX = str(2**256 - 1)
DEC = "decimal(38,0)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once instead of once per mention."""
    return F.transform(F.array(value), use)[0]


def is_amount(c: Column) -> Column:
    """Only ASCII digits, within uint256. Zero counts; NULL does not."""
    digits = F.coalesce(c.rlike(r"^[0-9]+\z"), F.lit(False))
    bare = F.regexp_replace(c, r"^0+(?=[0-9])", "")
    fits = (F.length(bare) < WIDTH) | (
        (F.length(bare) == WIDTH) & (bare <= F.lit(UINT256_MAX))
    )
    return digits & F.coalesce(fits, F.lit(False))


def limbs(c: Column) -> Column:
    """Decimal string to ``struct<hi, mid, lo>``; the string must pass ``is_amount``."""
    padded = F.lpad(F.regexp_replace(c, r"^0+(?=[0-9])", ""), WIDTH, "0")
    part = lambda i: F.substring(padded, 1 + i * BASE_DIGITS, BASE_DIGITS).cast(DEC)
    return F.when(
        c.isNotNull(), F.struct(part(0).alias("hi"), part(1).alias("mid"), part(2).alias("lo"))
    )


def _carry(hi: Column, mid: Column, lo: Column) -> Column:
    """Move everything above 26 digits one limb up. Inputs must not be negative."""
    base = F.lit("1" + "0" * BASE_DIGITS).cast(DEC)
    over = lambda v: F.call_function("div", v, base).cast("decimal(19,0)")
    mid2 = (mid + over(lo)).cast(DEC)
    return F.struct(
        (hi + over(mid2)).cast(DEC).alias("hi"),
        (mid2 % base).cast(DEC).alias("mid"),
        (lo % base).cast(DEC).alias("lo"),
    )


def render(v: Column) -> Column:
    """Limbs to the shortest decimal string."""
    text = F.concat(
        v["hi"].cast("string"),
        F.lpad(v["mid"].cast("string"), BASE_DIGITS, "0"),
        F.lpad(v["lo"].cast("string"), BASE_DIGITS, "0"),
    )
    return F.when(v.isNotNull(), F.regexp_replace(text, r"^0+(?=[0-9])", ""))


def sum_limbs(c: Column) -> Column:
    """Aggregate: exact sum of an amount string column, as carried limbs."""
    v = limbs(c)
    return _carry(F.sum(v["hi"]), F.sum(v["mid"]), F.sum(v["lo"]))


def sum_units(c: Column) -> Column:
    """Aggregate: exact sum of an amount string column, as a string."""
    return render(sum_limbs(c))


def scaled(v: Column, k: int) -> Column:
    """Limbs times a small constant."""
    m = F.lit(k).cast("decimal(6,0)")
    return _carry((v["hi"] * m).cast(DEC), (v["mid"] * m).cast(DEC), (v["lo"] * m).cast(DEC))


def add(a: Column, b: Column) -> Column:
    return _carry(*((a[p] + b[p]).cast(DEC) for p in ("hi", "mid", "lo")))


def subtract(a: Column, b: Column) -> Column:
    """``a - b`` as a signed decimal string."""
    base = F.lit("1" + "0" * BASE_DIGITS).cast(DEC)
    one = lambda c: F.when(c < 0, F.lit(1)).otherwise(F.lit(0)).cast("decimal(1,0)")

    def borrow(d: Column) -> Column:
        mid = (d["mid"] - one(d["lo"])).cast(DEC)
        return F.struct(
            (d["hi"] - one(mid)).cast(DEC).alias("hi"),
            (mid + one(mid) * base).cast(DEC).alias("mid"),
            (d["lo"] + one(d["lo"]) * base).cast(DEC).alias("lo"),
        )

    def signed(v: Column) -> Column:
        big, small = F.greatest(v["a"], v["b"]), F.least(v["a"], v["b"])
        parts = F.struct(*((big[p] - small[p]).cast(DEC).alias(p) for p in ("hi", "mid", "lo")))
        text = let(parts, lambda d: let(borrow(d), render))
        return F.when(v["a"] < v["b"], F.concat(F.lit("-"), text)).otherwise(text)

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(a.alias("a"), b.alias("b")), signed))


def approx(v: Column) -> Column:
    """Limbs as DOUBLE, for ratios and model inputs only."""
    return (
        v["hi"].cast("double") * F.lit(1e52)
        + v["mid"].cast("double") * F.lit(1e26)
        + v["lo"].cast("double")
    )


def from_hex(word: Column) -> Column:
    """64 hex digits to a decimal string.

    The word is eight 32-bit chunks times constant powers; each power is cut into limbs,
    so three sums of eight products and one carry give the number.
    """
    chunks = [F.conv(F.substring(word, 1 + 8 * i, 8), 16, 10).cast("decimal(10,0)") for i in range(8)]
    sums = []
    for place in (2, 1, 0):
        total = F.lit(0).cast(DEC)
        for i, chunk in enumerate(chunks):
            digits = 2 ** (32 * (7 - i)) // 10 ** (BASE_DIGITS * place) % 10**BASE_DIGITS
            if digits:
                total = (total + chunk * F.lit(str(digits)).cast("decimal(26,0)")).cast(DEC)
        sums.append(total)
    raw = F.struct(*(s.alias(p) for s, p in zip(sums, ("hi", "mid", "lo"))))
    small = F.conv(F.substring(word, 49, 16), 16, 10)
    large = let(raw, lambda v: let(_carry(v["hi"], v["mid"], v["lo"]), render))
    return F.when(
        word.rlike(r"^[0-9a-fA-F]{64}\z"),
        F.when(F.substring(word, 1, 48) == "0" * 48, small).otherwise(large),
    )


def to_display(units: Column, decimals: Column) -> Column:
    """Base units to an exact decimal string with all ``decimals`` places."""
    padded = F.lpad(units, 1 + WIDTH, "0")
    whole = F.regexp_replace(
        F.substring(padded, F.lit(1), F.lit(1 + WIDTH) - decimals), r"^0+(?=[0-9])", ""
    )
    tail = F.substring(padded, F.lit(2 + WIDTH) - decimals, decimals)
    return F.when(decimals > 0, F.concat_ws(".", whole, tail)).otherwise(whole)


def from_display(text: Column, decimals: Column) -> Column:
    """Inverse of ``to_display``; NULL when malformed or more precise than the asset."""
    halves = F.split(text, r"\.")
    tail = F.regexp_replace(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), "0+$", "")
    ok = text.rlike(r"^[0-9]+(\.[0-9]*)?\z") & (F.length(tail) <= decimals)
    joined = F.concat(halves[0], tail, F.repeat(F.lit("0"), decimals - F.length(tail)))
    return F.when(ok, F.regexp_replace(joined, r"^0+(?=[0-9])", ""))
