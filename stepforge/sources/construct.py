"""Tensors from Python and NumPy values, serial content and tables."""

from __future__ import annotations

import math

from collections.abc import Sequence

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stepforge import dtypes
from stepforge.dtypes import dtype as as_dtype
from stepforge.sources.storage import shared_root
from stepforge.tensor import Tensor, axes, cells, flat_index, unflatten


def pcf_points(data, d=None) -> list[tuple]:
    """Breakpoints of one function from rows (t, v): the first row's t must be 0; others may come in any order; no rows: zero."""
    rows = data.tolist() if hasattr(data, "tolist") else [tuple(r) for r in data]
    if not rows:
        return [(0, 0)]
    if any(len(r) != 2 for r in rows):
        raise ValueError("a function is an n x 2 array of times and values")
    if rows[0][0] != 0:
        raise ValueError("the first breakpoint must be at 0")
    return sorted((tuple(r) for r in rows), key=lambda r: r[0])


def _dtype_of_array(a) -> str:
    kind = np.asarray(a).dtype
    return {"float32": "pcf32", "float64": "pcf64", "int32": "pcf32i", "int64": "pcf64i"}.get(kind.name, "pcf64")


def _sql_number(v) -> str:
    v = float(v) if isinstance(v, (float, np.floating)) else v
    if isinstance(v, float) and not math.isfinite(v):
        return f"double('{v}')"
    return repr(v) + ("D" if isinstance(v, float) else "")


def element(value, d) -> Column:
    """One element as a literal column."""
    d = as_dtype(d)
    if d.family in ("pcf", "ipcf", "barcode"):
        names = ("birth", "death") if d.family == "barcode" else ("t", "v")
        rows = pcf_points(value) if d.family != "barcode" else barcode_rows(value)
        items = ", ".join(f"named_struct('{names[0]}', {_sql_number(a)}, '{names[1]}', {_sql_number(b)})" for a, b in rows)
        return F.expr(f"array({items})").cast(d.spark)
    if d.family == "pcloud":
        return F.array(*[F.array(*map(F.lit, map(float, p))) for p in np.asarray(value).tolist()]).cast(d.spark)
    return F.lit(value).cast(d.spark)


def barcode_rows(value) -> list[tuple]:
    a = np.asarray(value, float)
    if a.size == 0:
        return []
    if a.ndim != 2 or a.shape[1] != 2:
        raise ValueError("a barcode is an n x 2 array of births and deaths")
    return [tuple(r) for r in a.tolist()]


def zeros(spark: SparkSession, shape: Sequence[int], dtype="pcf32") -> Tensor:
    d = as_dtype(dtype)
    return Tensor(cells(spark, shape).withColumn("x", F.expr(dtypes.ZERO[d.family]).cast(d.spark)), shape, d)


def _nested(data, leaf) -> tuple[tuple[int, ...], list]:
    """Shape and flat elements of a nested list whose leaves satisfy leaf; unequal lengths raise ValueError."""
    if leaf(data):
        return (), [data]
    parts = [_nested(x, leaf) for x in data]
    shapes = {s for s, _ in parts}
    if len(shapes) > 1:
        raise ValueError("nested lists must have equal lengths")
    return (len(parts), *(shapes.pop() if shapes else ())), [x for _, items in parts for x in items]


def _frame(spark: SparkSession, shape: Sequence[int], values: list, d) -> Tensor:
    idx = np.stack(np.unravel_index(np.arange(len(values)), shape), 1).tolist() if len(shape) and len(values) else [[]] * len(values)
    schema = ", ".join([*[f"{a} bigint" for a in axes(len(shape))], f"x {d.spark}"])
    return Tensor(spark.createDataFrame([(*i, v) for i, v in zip(idx, values, strict=True)], schema), shape, d)


def from_elements(spark: SparkSession, shape: Sequence[int], elements: list, dtype) -> Tensor:
    """From elements in row-major order, each as a row of its Spark type."""
    return _frame(spark, tuple(shape), elements, as_dtype(dtype))


def _typed(rows, d):
    cast = int if d.numpy.startswith("int") else float
    return [(cast(a), cast(b)) for a, b in rows]


def pcf_tensor(spark: SparkSession, data, dtype=None) -> Tensor:
    """From a nested list of n x 2 arrays (or lists of pairs)."""

    def leaf(x):
        if hasattr(x, "ndim"):
            return x.ndim == 2 and x.shape[1] == 2
        return isinstance(x, list) and all(isinstance(r, (tuple, list)) and len(r) == 2 and all(isinstance(v, (int, float)) for v in r) for r in x) and bool(x)

    shape, items = _nested(data, leaf)
    d = as_dtype(dtype or (_dtype_of_array(items[0]) if items and hasattr(items[0], "dtype") else "pcf64"))
    return _frame(spark, shape, [_typed(pcf_points(x), d) for x in items], d)


def pcf(spark: SparkSession, data, dtype=None) -> Tensor:
    """One function, as a tensor without axes."""
    d = as_dtype(dtype or (_dtype_of_array(data) if hasattr(data, "dtype") else "pcf64"))
    return _frame(spark, (), [_typed(pcf_points(data), d)], d)


def barcode_tensor(spark: SparkSession, data, dtype="barcode64") -> Tensor:
    shape, items = _nested(data, lambda x: hasattr(x, "ndim") or isinstance(x, list) and all(isinstance(r, tuple) for r in x))
    return _frame(spark, shape, [barcode_rows(x) for x in items], as_dtype(dtype))


def point_clouds(spark: SparkSession, data, dtype="pcloud64") -> Tensor:
    """From a nested list of n x d arrays; clouds may have different numbers of points."""
    shape, items = _nested(data, lambda x: hasattr(x, "ndim"))
    return _frame(spark, shape, [np.asarray(x, float).tolist() for x in items], as_dtype(dtype))


def from_numpy(spark: SparkSession, data, dtype=None) -> Tensor:
    """Float, whole-number or boolean tensor from an array or nested list of numbers."""
    a = np.asarray(data)
    if a.dtype == object:
        raise TypeError("arrays of objects have no dtype here")
    d = as_dtype(dtype or a.dtype)
    return _frame(spark, a.shape, a.astype(d.numpy).ravel().tolist(), d)


def from_serial_content(content: DataFrame, enumeration: DataFrame, shape: Sequence[int], dtype="pcf64") -> Tensor:
    """content (row, t, v) and enumeration (i0..ik, start, stop): each cell is the rows start <= row < stop of content.

    Cells list the blocks of rows they touch, so rows meet cells by equality of block."""
    d = as_dtype(dtype)
    if d.family != "pcf":
        raise TypeError("serial content makes float step functions")
    if not enumeration.where(F.col("start") >= F.col("stop")).isEmpty():
        raise ValueError("start must come before stop")
    block = 4096
    e = enumeration.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    c = content.withColumn("__b", F.floor(F.col("row") / block))
    keys = axes(len(shape))
    rows = e.join(c, "__b").where((F.col("row") >= F.col("start")) & (F.col("row") < F.col("stop")))
    x = F.array_sort(F.collect_list(F.struct("t", "v"))).cast(d.spark)
    return Tensor(rows.groupBy(*keys).agg(x.alias("x")), shape, d)


def mapping_tensor(spark: SparkSession, shape: Sequence[int], dtype="int64") -> Tensor:
    """Cells hold their indices as decimal digits: sum of index j times 10^(d - j), j from 1."""
    n = len(shape)
    x = sum((F.col(f"i{k}") * 10 ** (n - 1 - k) for k in range(n)), F.lit(0))
    return Tensor(cells(spark, shape).withColumn("x", x.cast(as_dtype(dtype).spark)), shape, dtype)


# ---- joining and parting (H8-H11) --------------------------------------------------------------------------------------

def concatenate(tensors: Sequence[Tensor], axis: int = 0) -> Tensor:
    if not tensors:
        raise ValueError("nothing to join")
    first = tensors[0]
    axis = first._axis(axis)
    if any(t.dtype != first.dtype for t in tensors):
        raise TypeError("tensors to join have one dtype")
    rest = lambda t: (*t.shape[:axis], *t.shape[axis + 1 :])
    if any(t.ndim != first.ndim or rest(t) != rest(first) for t in tensors):
        raise ValueError("tensors to join differ on that axis only")
    out, at = None, 0
    for t in tensors:
        df = t.df.withColumn(f"i{axis}", F.col(f"i{axis}") + at)
        out = df if out is None else out.unionByName(df)
        at += t.shape[axis]
    return Tensor(out, (*first.shape[:axis], at, *first.shape[axis + 1 :]), first.dtype)


def stack(tensors: Sequence[Tensor], axis: int = 0) -> Tensor:
    if any(t.shape != tensors[0].shape for t in tensors):
        raise ValueError("tensors to stack have one shape")
    axis = tensors[0]._axis(axis, tensors[0].ndim + 1)
    return concatenate([t.expand_dims(axis) for t in tensors], axis)


def _cut(t: Tensor, points: Sequence[int], axis: int) -> list[Tensor]:
    key = lambda a, b: (*[slice(None)] * axis, slice(a, b))
    edges = [0, *points, t.shape[axis]]
    return [t[key(a, max(a, b))] for a, b in zip(edges, edges[1:], strict=False)]


def split(t: Tensor, parts, axis: int = 0) -> list[Tensor]:
    """Equal parts (ValueError if uneven), or cuts at the given indices."""
    axis = t._axis(axis)
    if isinstance(parts, int):
        if parts < 1 or t.shape[axis] % parts:
            raise ValueError(f"{t.shape[axis]} can't be cut into {parts} equal parts")
        step = t.shape[axis] // parts
        parts = [step * k for k in range(1, parts)]
    return _cut(t, parts, axis)


def array_split(t: Tensor, parts, axis: int = 0) -> list[Tensor]:
    """As split, but the first parts may be one longer."""
    axis = t._axis(axis)
    if isinstance(parts, int):
        if parts < 1:
            raise ValueError("parts must be at least 1")
        q, r = divmod(t.shape[axis], parts)
        edges, at = [], 0
        for k in range(parts - 1):
            at += q + (k < r)
            edges.append(at)
        parts = edges
    return _cut(t, parts, axis)


# ---- tables ------------------------------------------------------------------------------------------------------------

#: Rows that one task numbers.
NUMBERED_ROWS = 1_000_000


def numbered(df: DataFrame, order: Sequence[str], name: str, rows: int | None = None) -> DataFrame:
    """df with each row's rank from 0 by the order columns. Many rows are sorted in ranges, which a checkpoint in the shared folder
    fixes: a rank is the rows of earlier ranges plus the place in its own, so that no task sorts all."""
    n = df.count() if rows is None else rows
    parts = -(-n // NUMBERED_ROWS)
    if parts <= 1:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    shared_root(df.sparkSession)  # names the folder where the session has none
    ranges = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)  # how these ids are made up
    counts = ranges.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row a range
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__e"))
    return ranges.withColumn("__part", part).join(before, "__part").withColumn(name, F.col("__e") + place).drop("__part", "__e", "__id")


def rank_axis(df: DataFrame, col: str, name: str = "i0") -> DataFrame:
    """Distinct values of a column with their rank from 0: an axis."""
    return numbered(df.select(col).distinct(), [col], name)


def points_from_events(events: DataFrame, entity: str | Sequence[str] = "user_id", ts: str = "ts", value: str = "value", order: str = "event_id") -> DataFrame:
    """(entity, t, v): one function for each entity, t in days since its first event, the last value 0 (finite support)."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys)
    last = F.row_number().over(w.orderBy(F.desc(ts), F.desc(order))) == 1
    t = (F.col("__us") - F.min("__us").over(w)) / F.lit(86_400_000_000.0)
    return events.withColumn("__us", us).select(*keys, t.alias("t"), F.when(last, F.lit(0.0)).otherwise(F.col(value)).alias("v"))


def reindexed(df: DataFrame, old: Sequence[int], new: Sequence[int]) -> DataFrame:
    return df.select(flat_index(old).alias("__f"), "x").withColumns(unflatten(F.col("__f"), new))
