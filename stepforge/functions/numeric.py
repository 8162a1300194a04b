"""Arithmetic with IEEE results where Spark's ANSI mode would raise or give null."""

import math

import pandas as pd

from pyspark.sql import Column, functions as F

INF, NAN = float("inf"), float("nan")
#: The end of a last segment in integrals: 0 * MAX is 0, where 0 * infinity would be NaN.
MAX = 1.7976931348623157e308


def ieee_divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def floor_divide(a: Column, b: Column, integer: bool) -> Column:
    """Towards minus infinity. Whole numbers divided by zero give 0; others give IEEE results."""
    if integer:
        safe = F.when(b == 0, F.lit(1)).otherwise(b)
        return F.when(b == 0, F.lit(0)).otherwise(_floor_div(a, safe)).cast("bigint")
    q = ieee_divide(a, b)
    return F.when(F.isnan(q) | (F.abs(q) == INF), q).otherwise(F.floor(q).cast("double"))


def _floor_div(a: Column, b: Column) -> Column:
    r = a % b
    return ((a - r) / b).cast("bigint") - F.when((r != 0) & ((r < 0) != (b < 0)), 1).otherwise(0)


def truncating_divide(a: Column, b: Column) -> Column:
    """Towards zero, as whole-number step functions divide; division by zero is null."""
    safe = F.when(b == 0, F.lit(None)).otherwise(b)
    return ((a - a % safe) / safe).cast("bigint")


def ieee_power(v: Column, p: float) -> Column:
    return v * v if p == 2 else F.pow(v, F.lit(float(p)))


def exact_power(v: Column, p: float) -> Column:
    """As ieee_power, to the last digit what the C library gives, as SQL engines do: Spark's own pow differs there for many values."""
    if p == 2:
        return v * v

    @F.pandas_udf("double")
    def power(x: pd.Series) -> pd.Series:
        return x.astype(float).map(lambda a: _power(a, float(p)))

    return power(v.cast("double"))


def _power(a: float, p: float) -> float:
    try:
        return math.pow(a, p)
    except OverflowError:
        return -INF if a < 0 and p % 2 == 1 else INF
    except ValueError:  # a root of a negative number, or 0 to a negative power
        return NAN if a else math.copysign(INF, a) if p % 2 == 1 else INF


def same_value(a: Column, b: Column) -> Column:
    """Equality in which NaN equals nothing, itself included."""
    return (a == b) & ~F.isnan(a.cast("double"))


def round_scaled(v: Column, digits: int) -> Column:
    """v times a power of ten, rounded half away from zero, over that power: what SQL engines that round doubles as doubles give.
    Spark's round takes the shortest decimal text instead, which is another one now and then where half a unit is left."""
    unit = F.lit(10.0**digits)
    scaled = F.abs(v) * unit
    rest = scaled % F.lit(1.0)
    out = (scaled - rest + F.when(rest >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))) / unit * F.signum(v)
    return F.when(F.isnan(out) | (F.abs(out) == INF), v).otherwise(out)
