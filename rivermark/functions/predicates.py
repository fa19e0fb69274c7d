"""Row predicates over transfers and labels. All are plain boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivermark.functions import amounts


def _is(name: str, *values: str) -> Column:
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def positive(name: str = "amount_base_units") -> Column:
    c = F.col(name)
    return amounts.is_amount(c) & c.rlike("[1-9]")


def spendable() -> Column:
    """Only these carry value forward."""
    return (
        _is("event_kind", "transfer")
        & _is("execution_status", "success")
        & _is("confirmation_state", "confirmed")
        & positive()
    )


def fund_flow() -> Column:
    """Weaker test used for evidence rows: a transfer not known to be undone."""
    return (
        _is("event_kind", "transfer")
        & positive()
        & ~_is("execution_status", "failed", "reverted")
        & ~_is("confirmation_state", "removed")
    )


def covers(at: Column, start: Column, end: Column) -> Column:
    """Closed interval; a NULL bound is open."""
    return F.coalesce(at >= start, F.lit(True)) & F.coalesce(at <= end, F.lit(True))


def strictly_after(time: Column, seq: Column, time0: Column, seq0: Column) -> Column:
    """Later block time; on equal or unknown times the sequence text decides."""
    text = F.coalesce(seq, F.lit("")) > F.coalesce(seq0, F.lit(""))
    decided = time.isNotNull() & time0.isNotNull() & (time != time0)
    return F.when(decided, time > time0).otherwise(text)


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule whose condition holds names the reason; else NULL."""
    return F.coalesce(*(F.when(cond, F.lit(code)) for cond, code in rules))


def direction(address: Column) -> Column:
    sent = F.col("from_address") == address
    got = F.col("to_address") == address
    return F.when(sent & got, "self").when(sent, "outgoing").otherwise("incoming")


def reasons(*rules: tuple[Column, str]) -> Column:
    """All codes whose condition holds, in the order given."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(code)) for cond, code in rules)))
