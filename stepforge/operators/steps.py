"""Step functions as rows: points (keys, t, v), one per breakpoint, and segments (keys, l, r, v), one per constant piece.

A function is v on [t, next t), its last value holds to infinity. keys name the columns that tell functions apart.
"""

import math

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DecimalType

from stepforge.functions.numeric import INF, MAX, exact_power, ieee_divide, ieee_power, same_value, truncating_divide

#: Points of a running sum, and of a group's fold, that one task takes; times that are broadcast at most.
ROWS_A_RANGE, FOLD_POINTS, MOST_TIMES = 500_000, 2_000_000, 1_000_000

OPS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": ieee_divide,
    "max": F.greatest, "min": F.least,
}
INT_OPS = OPS | {"/": truncating_divide}


# ---- segments, clipping, compaction (E5, part of P1) -------------------------------------------------------------------

def segments(points: DataFrame, keys: Sequence[str], end: float = MAX) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("t")
    return points.select(*keys, F.col("t").alias("l"), F.lead("t").over(w).alias("r"), "v").withColumn("r", F.coalesce("r", F.lit(end))).select(*keys, "l", "r", "v")


def iterate_segments(points: DataFrame, keys: Sequence[str], a: float = 0.0, b: float = MAX) -> DataFrame:
    """Constant pieces within [a, b); before its first point a function has its first value."""
    w = Window.partitionBy(*keys).orderBy("l")
    s = segments(points, keys).withColumn("l", F.when(F.row_number().over(w) == 1, F.least("l", F.lit(a))).otherwise(F.col("l")))
    return clip(s, a, b)


def clip(pieces: DataFrame, a: float = 0.0, b: float = MAX) -> DataFrame:
    if a == 0.0 and b == MAX:
        return pieces
    return pieces.where((F.col("r") > a) & (F.col("l") < b) & F.lit(a < b)).withColumns({"l": F.greatest("l", F.lit(float(a))), "r": F.when(F.col("r") >= MAX, F.lit(float(b))).otherwise(F.least("r", F.lit(float(b))))})


def compact(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Without breakpoints that keep the value before them; the first one stays."""
    before = F.lag("v").over(Window.partitionBy(*keys).orderBy("t"))
    return points.withColumn("__b", before).where(F.col("__b").isNull() | ~same_value(F.col("v"), F.col("__b"))).drop("__b")


# ---- evaluation (E1-E3) ------------------------------------------------------------------------------------------------

def evaluate(points: DataFrame, keys: Sequence[str], t: float) -> DataFrame:
    """Each function's value at one time."""
    if t < 0:
        raise ValueError("functions have no values before 0")
    return points.where(F.col("t") <= t).groupBy(*keys).agg(F.max_by("v", "t").alias("v"))


def evaluate_at(points: DataFrame, keys: Sequence[str], times: DataFrame, time_col: str = "time") -> DataFrame:
    """Each function at each row of times (whose other columns come along): keys, columns of times, v."""
    lowest, n = times.agg(F.min(time_col), F.count(time_col)).first()
    if lowest is not None and lowest < 0:
        raise ValueError("functions have no values before 0")
    s = segments(points, keys, INF)
    last, width = _buckets(s)
    number = lambda c: F.floor(F.least(c, F.lit(last)) / F.lit(width)).cast("bigint")
    listed = s.withColumn("__k", F.explode(F.sequence(number(F.col("l")), number(F.col("r")))))
    asked = times.withColumn("__k", number(F.col(time_col)))
    # counted: a list of times goes to every task up to a bound, a longer one is dealt by bucket
    asked = F.broadcast(asked) if n <= MOST_TIMES else asked.hint("shuffle_hash")
    return listed.join(asked, "__k").where((F.col("l") <= F.col(time_col)) & (F.col(time_col) < F.col("r"))).select(*keys, *times.columns, "v")


def _buckets(s: DataFrame) -> tuple[float, float]:
    """(last breakpoint, width of a bucket of time) for segments: as wide as the mean segment, a million buckets at most."""
    last, mean_ = s.agg(F.max("l"), F.avg(F.when(F.col("r") < MAX, F.col("r") - F.col("l")))).first()
    return last or 0.0, max(mean_ or 0.0, (last or 0.0) / 1_000_000) or 1.0


# ---- rectangles and algebra (E4, P1-P8) --------------------------------------------------------------------------------

def merged(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two functions on the union of their breakpoints: keys, t, fv, gv from rows (keys, side 0 or 1, t, v)."""
    at = pairs.groupBy(*keys, "t").agg(F.max(F.when(F.col("side") == 0, F.struct("v"))).alias("f"), F.max(F.when(F.col("side") == 1, F.struct("v"))).alias("g"))
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return at.select(*keys, "t", F.last("f", ignorenulls=True).over(w)["v"].alias("fv"), F.last("g", ignorenulls=True).over(w)["v"].alias("gv"))


def _sides(f: DataFrame, g: DataFrame, keys: Sequence[str]) -> DataFrame:
    return f.select(*keys, F.lit(0).alias("side"), "t", "v").union(g.select(*keys, F.lit(1).alias("side"), "t", "v"))


def rectangles(f: DataFrame, g: DataFrame, keys: Sequence[str], a: float = 0.0, b: float = INF) -> DataFrame:
    """Largest pieces of [a, b) on which f and g are both constant: keys, l, r, fv, gv; functions meet by equal keys."""
    m = merged(_sides(f, g, keys), keys)
    w = Window.partitionBy(*keys).orderBy("t")
    r = m.select(*keys, F.col("t").alias("l"), F.coalesce(F.lead("t").over(w), F.lit(MAX)).alias("r"), "fv", "gv")
    r = clip(r, a, MAX if b == INF else b)
    return r.withColumn("r", F.when(F.col("r") >= MAX, F.lit(INF)).otherwise(F.col("r"))) if b == INF else r


def combine(f: DataFrame, g: DataFrame, keys: Sequence[str], op, integer: bool = False) -> DataFrame:
    """op (a name of OPS or a function of two columns) on each piece, without breakpoints that change nothing."""
    fn = (INT_OPS if integer else OPS)[op] if isinstance(op, str) else op
    out = merged(_sides(f, g, keys), keys).select(*keys, "t", fn(F.col("fv"), F.col("gv")).alias("v"))
    return compact(out, keys)


def map_values(points: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """Scalar arithmetic: breakpoints stay as they are."""
    return points.withColumn("v", fn(F.col("v")))


def scalar(points: DataFrame, op: str, c: float, reverse: bool = False, integer: bool = False) -> DataFrame:
    fn = (INT_OPS if integer else OPS)[op]
    return map_values(points, lambda v: fn(F.lit(c), v) if reverse else fn(v, F.lit(c)))


def negate(points: DataFrame) -> DataFrame:
    return map_values(points, lambda v: -v)


def power(points: DataFrame, p: float) -> DataFrame:
    return map_values(points, lambda v: exact_power(v, p))


def fold(points: DataFrame, keys: Sequence[str], member: str, op: Callable[[list[Column]], Column] | str, zero: bool = True) -> DataFrame:
    """Many functions to one for each group: at each breakpoint of a group, op over the members' values in force.

    op is "sum", "max", "min" or "mean", or a function from the column of values to an aggregate: the one place for user-defined
    aggregates. zero: the zero function takes part, as in a left fold that begins with it."""
    if op in ("max", "min"):
        most = points.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if most <= FOLD_POINTS:
            return compact(_tournaments(points, keys, member, op, zero), keys)
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}[op] if isinstance(op, str) else op
    s = segments(points, [*keys, member])
    times = points.select(*keys, "t").distinct()
    last, width = _buckets(s)
    number = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    listed = s.withColumn("__k", F.explode(F.sequence(number(F.col("l")), number(F.least("r", F.lit(last))))))
    asked = times.withColumn("__k", number(F.col("t"))).hint("shuffle_hash")
    rows = listed.drop(member).join(asked, [*keys, "__k"]).where("l <= t and t < r").select(*keys, "t", "v")
    if zero:
        rows = rows.union(times.select(*keys, "t", F.lit(0.0)))
    return compact(rows.groupBy(*keys, "t").agg(fn("v").alias("v")), keys)


def _tournaments(points: DataFrame, keys: Sequence[str], member: str, op: str, zero: bool) -> DataFrame:
    """The greatest or least of each group's functions, merged two by two: linear in the points times log members."""
    pick, none = (np.maximum, -np.inf) if op == "max" else (np.fmin, np.inf)

    def at(f, t):
        k = np.searchsorted(f[0], t, "right") - 1
        return np.where(k < 0, none, f[1][k])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([member, "t"], kind="stable")
        m, t, v = pdf[member].to_numpy(), pdf["t"].to_numpy(float), pdf["v"].to_numpy(float)
        cuts = np.flatnonzero(m[1:] != m[:-1]) + 1
        fs = list(zip(np.split(t, cuts), np.split(v, cuts), strict=True))
        while len(fs) > 1:
            left = fs[2 * (len(fs) // 2) :]
            for f, g in zip(fs[0::2], fs[1::2], strict=False):
                both = np.union1d(f[0], g[0])
                left.append((both, pick(at(f, both), at(g, both))))
            fs = left
        t, v = fs[0]
        out = {k: [pdf[k].iloc[0]] * len(t) for k in keys}
        return pd.DataFrame({**out, "t": t, "v": pick(v, 0.0) if zero else v})

    schema = ", ".join([*(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys), "t double", "v double"])
    rows = points.select(*keys, member, F.col("t").cast("double"), F.col("v").cast("double"))
    return rows.groupBy(*keys).applyInPandas(one, schema)


def ranged(rows: DataFrame, keys: Sequence[str], order: str, total: int) -> DataFrame | None:
    """rows with __part, the number of a range of order, ranges in order; None where each group fits one task. Rows without
    keys are one group, which is always cut."""
    ranges = max(-(-total // ROWS_A_RANGE), 1 if keys else 4)
    if ranges <= 1:
        return None
    cuts = sorted(set(rows.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    part = sum((F.when(F.col(order) >= c, 1).otherwise(0) for c in cuts), F.lit(0)) if len(cuts) < 64 else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order)))
    return rows.withColumn("__part", part)


def running_sum(rows: DataFrame, keys: Sequence[str], order: str, value: str, out: str, total_rows: int | None = None) -> DataFrame:
    """rows with the sum of value up to and including each row, one row for each (keys, order). Long groups are cut into
    ranges of order: sums before a range come from a prefix sum over ranges, so that no task holds a whole group."""
    cut = ranged(rows, keys, order, rows.count() if total_rows is None else total_rows)
    if cut is None:
        return rows.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    # one row a range and group; without keys, the ranges are one group
    before = Window.partitionBy(*(keys or [F.col("__part") < 0])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "__part").agg(F.sum(value).alias("__s"))
    kind = totals.schema["__s"].dataType
    if isinstance(kind, DecimalType):  # sums keep their scale: one digit fewer before the point for each addition
        kind = DecimalType(kind.precision - 1, kind.scale)
    totals = totals.withColumn("__earlier", F.coalesce(F.sum("__s").over(before), F.lit(0)).cast(kind)).drop("__s")
    own = Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(totals, [*keys, "__part"])
    return joined.withColumn(out, F.col("__earlier") + F.sum(value).over(own).cast(kind)).drop("__part", "__earlier")


# ---- reductions (R1, R2) -----------------------------------------------------------------------------------------------

def mean(points: DataFrame, keys: Sequence[str], member: str, members: int | Column, exact: bool | None = None) -> DataFrame:
    """Pointwise mean of each group's members; members without points are zero functions and count.

    Values are scaled by a power of two, so that the largest is below 2^26, and added as DECIMAL(38,20): jumps telescope
    without error, so one running sum over the breakpoints does it, in time linear in the points. What is below 1e-28 of the
    largest value counts as nothing, and 1e10 members fit. Values that aren't finite (exact=False) are looked up for
    each member and breakpoint."""
    worst = points.agg(F.max(F.when(F.isnan("v"), F.lit(INF)).otherwise(F.abs("v")))).first()[0] or 0.0
    if exact is False or worst == INF:
        total = fold(points, keys, member, "sum")
        return total.withColumn("v", F.col("v") / members)
    scale = 2.0 ** min(1000, 26 - math.frexp(worst)[1]) if worst else 1.0
    w = Window.partitionBy(*keys, member).orderBy("t")
    d = (F.col("v").cast("double") * F.lit(scale)).cast("decimal(28,20)")
    jumps = points.select(*keys, "t", d.alias("d"), F.lag(d).over(w).alias("p")).select(*keys, "t", (F.col("d") - F.coalesce("p", F.lit(0).cast("decimal(28,20)"))).alias("j"))
    rows = jumps.groupBy(*keys, "t").agg(F.sum("j").alias("j"))
    n, first = rows.agg(F.count("*"), F.min("t")).first()
    sums = running_sum(rows, keys, "t", "j", "s", n)
    # the value before a breakpoint is the sum without its jump: no look back at other rows
    v = lambda c: c.cast("double") / F.lit(scale)
    total = sums.select(*keys, "t", v(F.col("s")).alias("v"), v(F.col("s") - F.col("j")).alias("__b"))
    if keys:
        begin = rows.groupBy(*keys).agg(F.min("t").alias("__t0"))
        total = total.join(begin, [*keys])
    else:
        total = total.withColumn("__t0", F.lit(first))
    return total.where((F.col("t") == F.col("__t0")) | (F.col("v") != F.col("__b"))).select(*keys, "t", (F.col("v") / members).alias("v"))


def max_time(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.max("t").alias("x"))


# ---- norms (N1-N3) -----------------------------------------------------------------------------------------------------

def lp_norm(points: DataFrame, keys: Sequence[str], p: float = 1.0) -> DataFrame:
    if not p >= 1:
        raise ValueError("p must be at least 1")
    w, v = F.col("r") - F.col("l"), F.abs("v")
    part = w * (v if p == 1 else ieee_power(v, p))
    total = segments(points, keys).groupBy(*keys).agg(F.sum(part).alias("x"))
    return total if p == 1 else total.withColumn("x", F.sqrt("x") if p == 2 else F.pow("x", F.lit(1.0 / p)))


def l2_norm(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lp_norm(points, keys, 2.0)


def linfinity_norm(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.max(F.abs("v")).alias("x"))
