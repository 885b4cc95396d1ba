"""Sums of money that do not depend on the order rows reach a task.

An amount is cut into whole units, millionths, and what finer digits leave, in
units of 10**-15, and each is summed as an integer.  The parts stay inside
code-generated hash aggregation and combine map-side, unlike a decimal cast per
row.  The noise by which a double misses an amount of six decimals is no digit
and is dropped, so sums of such amounts are exact.  What integers cannot hold
(NaN, infinity, 2**53 and beyond, digits finer than 10**-15, overflow) makes a
group inexact: it reports the plain double sum of its rows, and says so.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICRO = 1_000_000
_FINE = 1e15
# Above 2**53 a double no longer holds every whole number.
_EXACT_LIMIT = float(2**53)
# The largest error of a double, and of the few operations here, for its size.
_NOISE = 2.0**-51

UNITS, MILLIONTHS, REST, INEXACT, PLAIN = STATE = (
    "_units", "_millionths", "_rest", "_inexact", "_plain"
)


def sum_state(amount: Column, where: Column | None = None) -> list[Column]:
    """Aggregates that hold a partial sum, for sums built up in several levels."""
    value = amount if where is None else F.when(where, amount)
    small = F.abs(value) < F.lit(_EXACT_LIMIT)
    whole = F.when(small, F.floor(value))
    part = value - F.floor(value)
    millionths = F.rint(part * _MICRO)
    # Millionths carry no error worth a digit unless the amount has finer ones.
    off = part - millionths / _MICRO
    fine = F.abs(off) > F.greatest(F.abs(value), F.lit(1e-6)) * F.lit(_NOISE)
    rest = F.rint(off * F.lit(_FINE))
    lost = ~small | (fine & (F.abs(off - rest / F.lit(_FINE)) > F.abs(value) * F.lit(_NOISE)))
    return [
        F.try_sum(whole).alias(UNITS),
        F.try_sum(F.when(small, millionths.cast("long"))).alias(MILLIONTHS),
        F.try_sum(F.when(small & fine, rest.cast("long")).otherwise(F.when(small, F.lit(0)))).alias(REST),
        F.coalesce(F.bool_or(lost), F.lit(False)).alias(INEXACT),
        F.sum(value).alias(PLAIN),
    ]


def merge_state() -> list[Column]:
    """Aggregates that merge partial sums held in the state columns."""
    gone = [F.col(c).isNull() for c in (UNITS, MILLIONTHS, REST)]
    lost = F.col(INEXACT) | ((gone[0] | gone[1] | gone[2]) & F.col(PLAIN).isNotNull())
    return [
        F.try_sum(UNITS).alias(UNITS),
        F.try_sum(MILLIONTHS).alias(MILLIONTHS),
        F.try_sum(REST).alias(REST),
        F.bool_or(lost).alias(INEXACT),
        F.sum(PLAIN).alias(PLAIN),
    ]


def state_value(
    units: Column, millionths: Column, rest: Column, inexact: Column, plain: Column
) -> Column:
    """The sum a state stands for, as a double."""
    exact = (
        (
            units.cast("decimal(20,0)") * F.lit(Decimal(_MICRO))
            + millionths.cast("decimal(20,0)")
        ) * F.lit(Decimal("0.000001"))
    ).cast("double") + rest / F.lit(_FINE)
    return F.when(inexact, plain).otherwise(F.coalesce(exact, plain))


def exact_sum(amount: Column, where: Column | None = None) -> Column:
    """Sum doubles as a double, exact to 15 decimals; NULL for no rows."""
    return state_value(*sum_state(amount, where))


def is_inexact(amount: Column, where: Column | None = None) -> Column:
    """Whether ``exact_sum`` of the same rows falls back to a plain double sum."""
    return sum_state(amount, where)[3]
