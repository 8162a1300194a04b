"""Tensors as DataFrames: one row per cell, index columns i0..ik (BIGINT) and the element in x.

shape and dtype are kept on the driver; operations return new tensors over new plans (no storage is shared, so writing to a
slice never changes its parent); `X[...] = v` and `+=` rebind the wrapper. Elements by dtype are in stepforge.dtypes.
Every cell has a row.
"""

from __future__ import annotations

import itertools
import math
import warnings

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stepforge import dtypes
from stepforge.dtypes import DType, dtype as as_dtype
from stepforge.functions import numeric

_FLOATS = ("float", "pcf")
_ARITHMETIC = ("float", "int", "uint", "pcf", "ipcf")


def axes(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def flat_index(shape: Sequence[int]) -> Column:
    """Row-major position of a cell."""
    out = F.lit(0).cast("bigint")
    for k, n in enumerate(shape):
        out = out * F.lit(int(n)) + F.col(f"i{k}")
    return out


def unflatten(flat: Column, shape: Sequence[int]) -> dict[str, Column]:
    out, step = {}, 1
    for k in range(len(shape) - 1, -1, -1):
        n = max(1, int(shape[k]))
        out[f"i{k}"] = ((flat - flat % step) / step).cast("bigint") % n
        step *= n
    return {f"i{k}": out[f"i{k}"] for k in range(len(shape))}


def packed(df: DataFrame) -> tuple[str, bytes]:
    """A frame's schema and its rows as an Arrow stream."""
    import pyarrow as pa

    table, out = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return df.schema.json(), out.getvalue().to_pybytes()


def unpacked(schema: str, rows: bytes) -> DataFrame:
    """The frame of `packed`, in the session that is active."""
    import json

    import pyarrow as pa

    from pyspark.sql.types import StructType

    return SparkSession.builder.getOrCreate().createDataFrame(pa.ipc.open_stream(rows).read_all(), StructType.fromJson(json.loads(schema)))


def _unpickled(kind, schema: str, rows: bytes, shape, dtype) -> Tensor:
    return kind(unpacked(schema, rows), shape, dtype)


def broadcast_shapes(a: Sequence[int], b: Sequence[int]) -> tuple[int, ...]:
    out = []
    for x, y in itertools.zip_longest(reversed(a), reversed(b), fillvalue=1):
        if x != y and 1 not in (x, y):
            raise ValueError(f"shapes {tuple(a)} and {tuple(b)} don't fit together")
        out.append(y if x == 1 else x)
    return tuple(reversed(out))


class Tensor:
    def __init__(self, df: DataFrame, shape: Sequence[int], dtype):
        self.shape, self.dtype = tuple(int(n) for n in shape), as_dtype(dtype)
        self.df = df.select(*axes(len(self.shape)), "x")

    # ---- metadata (I12) ----
    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def strides(self) -> tuple[int, ...]:
        """Those of a row-major array of this shape."""
        return tuple(math.prod(self.shape[k + 1 :]) for k in range(self.ndim))

    @property
    def offset(self) -> int:
        return 0

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def T(self) -> Tensor:  # noqa: N802
        return self.transpose()

    def __len__(self) -> int:
        return self.shape[0]

    def __iter__(self):
        return (self[k] for k in range(self.shape[0]))

    def __repr__(self) -> str:
        return f"Tensor(shape={self.shape}, dtype={self.dtype})"

    def _new(self, df: DataFrame, shape=None, dtype=None) -> Tensor:
        return Tensor(df, self.shape if shape is None else shape, dtype or self.dtype)

    def _cast(self, d: DType) -> Tensor:
        return self._new(self.df.withColumn("x", F.col("x").cast(d.spark)), dtype=d)

    # ---- shape (H1-H7, H13) ----
    def reshape(self, *shape) -> Tensor:
        shape = list(shape[0] if len(shape) == 1 and isinstance(shape[0], (tuple, list)) else shape)
        if shape.count(-1) > 1 or any(n < -1 for n in shape):
            raise ValueError("one length at most may be -1")
        if -1 in shape:
            rest = math.prod(n for n in shape if n != -1)
            if not rest or self.size % rest:
                raise ValueError(f"{self.size} cells don't fit {tuple(shape)}")
            shape[shape.index(-1)] = self.size // rest
        if math.prod(shape) != self.size:
            raise ValueError(f"{self.size} cells don't fit {tuple(shape)}")
        flat = self.df.select(flat_index(self.shape).alias("__f"), "x")
        return self._new(flat.withColumns(unflatten(F.col("__f"), shape)) if shape else flat, shape)

    def flatten(self) -> Tensor:
        return self._new(self.df.select(flat_index(self.shape).alias("i0"), "x"), (self.size,))

    def transpose(self, axes_: Sequence[int] | None = None) -> Tensor:
        order = list(range(self.ndim))[::-1] if axes_ is None else [self._axis(a) for a in axes_]
        if sorted(order) != list(range(self.ndim)):
            raise ValueError("axes must name each axis once")
        return self._new(self.df.select(*[F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(order)], "x"), [self.shape[a] for a in order])

    def swapaxes(self, a: int, b: int) -> Tensor:
        order = list(range(self.ndim))
        a, b = self._axis(a), self._axis(b)
        order[a], order[b] = order[b], order[a]
        return self.transpose(order)

    def squeeze(self, axis: int | None = None) -> Tensor:
        gone = [k for k, n in enumerate(self.shape) if n == 1] if axis is None else [self._axis(axis)]
        if any(self.shape[k] != 1 for k in gone):
            raise ValueError("only axes of length 1 can go")
        kept = [k for k in range(self.ndim) if k not in gone]
        return self._keep(kept, [self.shape[k] for k in kept])

    def _keep(self, kept: Sequence[int], shape) -> Tensor:
        return self._new(self.df.select(*[F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(kept)], "x"), shape)

    def expand_dims(self, axis: int) -> Tensor:
        axis = self._axis(axis, self.ndim + 1)
        cols = [F.col(f"i{k}") for k in range(self.ndim)]
        cols.insert(axis, F.lit(0).cast("bigint"))
        return self._new(self.df.select(*[c.alias(f"i{k}") for k, c in enumerate(cols)], "x"), (*self.shape[:axis], 1, *self.shape[axis:]))

    def broadcast_to(self, shape: Sequence[int]) -> Tensor:
        shape = tuple(shape)
        if len(shape) < self.ndim or broadcast_shapes(self.shape, shape) != shape:
            raise ValueError(f"{self.shape} can't be broadcast to {shape}")
        lead = len(shape) - self.ndim
        df = self.df.select(*[F.col(f"i{k}").alias(f"i{k + lead}") for k in range(self.ndim)], "x")
        for k, n in enumerate(shape):
            if k < lead or self.shape[k - lead] != n:  # each cell lists its own copies
                df = df.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")) if n else F.explode(F.array().cast("array<bigint>")))
        return self._new(df, shape)

    def copy(self) -> Tensor:
        return self._new(self.df)

    __copy__ = copy

    def __deepcopy__(self, memo) -> Tensor:
        return self.copy()

    def __reduce__(self):
        """Pickled as its cells (A9), which pass through the driver: for tensors that fit there."""
        return _unpickled, (type(self), *packed(self.df), self.shape, self.dtype.name)

    def _axis(self, a: int, n: int | None = None) -> int:
        n = self.ndim if n is None else n
        if not -n <= a < n:
            raise IndexError(f"axis {a} of {n}")
        return a % n

    def astype(self, d) -> Tensor:
        """Whole numbers from floats are cut off towards zero; pairs without a cast raise TypeError (H12)."""
        d = as_dtype(d)
        if d.name not in dtypes.CASTS[self.dtype.name]:
            raise TypeError(f"no cast from {self.dtype} to {d}")
        return self._cast(d)

    # ---- reading out (A5, T10) ----
    def to_numpy(self):
        import numpy as np

        if self.dtype.family not in ("float", "int", "uint", "bool"):
            raise TypeError(f"{self.dtype} elements have no NumPy array")
        rows = self.df.select(flat_index(self.shape).alias("f"), "x").toPandas().sort_values("f")
        return rows["x"].to_numpy().astype(self.dtype.numpy).reshape(self.shape) if self.size else np.empty(self.shape, self.dtype.numpy)

    __array__ = lambda self, dtype=None, copy=None: self.to_numpy() if dtype is None else self.to_numpy().astype(dtype)

    def item(self):
        if self.size != 1:
            raise ValueError("only a tensor of one element has a value")
        return self.df.first()["x"]

    def __bool__(self) -> bool:
        return bool(self.item())

    def __float__(self) -> float:
        return float(self.item())

    def __int__(self) -> int:
        return int(self.item())

    # ---- arithmetic and comparison (T1-T11) ----
    def _need(self, *families) -> None:
        if self.dtype.family not in families:
            raise TypeError(f"{self.dtype} elements don't support this")

    def _apply(self, fn) -> Tensor:
        """fn on each number: the element, or each value of a step function."""
        if self.dtype.family in ("pcf", "ipcf"):
            x = F.transform("x", lambda p: F.struct(p["t"].alias("t"), fn(p["v"]).alias("v")))
        else:
            x = fn(F.col("x"))
        return self._new(self.df.withColumn("x", x.cast(self.dtype.spark)))

    def _ops(self) -> dict:
        from stepforge.operators.steps import INT_OPS, OPS

        return INT_OPS if self.dtype.family in ("int", "uint", "ipcf") else OPS

    def _binary(self, other, op: str, reverse: bool = False) -> Tensor:
        if self.dtype.family == "bool" and op == "*":
            return self._pairwise(other, lambda a, b: a & b, self.dtype) if isinstance(other, Tensor) else self._apply(lambda v: v & F.lit(bool(other)))
        self._need(*_ARITHMETIC)
        if not isinstance(other, Tensor):
            if isinstance(other, bool) or not isinstance(other, (int, float)):
                return NotImplemented
            if self.dtype.family in ("int", "uint") and op == "/":
                return self.astype("float64")._binary(other, op, reverse) if self.dtype.family == "int" else self._cast(dtypes.DTYPES["float64"])._binary(other, op, reverse)
            fn = self._ops()[op]
            return self._apply(lambda v: fn(F.lit(other), v) if reverse else fn(v, F.lit(other)))
        if other.dtype != self.dtype:
            raise TypeError(f"{self.dtype} and {other.dtype} don't mix")
        if self.dtype.family in ("int", "uint") and op == "/":
            f64 = dtypes.DTYPES["float64"]
            return self._cast(f64)._binary(other._cast(f64), op)
        return self._combine(other, op) if self.dtype.family in ("pcf", "ipcf") else self._pairwise(other, self._ops()[op], self.dtype)

    def _joined(self, other: Tensor) -> tuple[DataFrame, tuple[int, ...]]:
        """Cells of the common shape with both elements, a and b: an equi-join on the axes that both sides have in full."""
        shape = broadcast_shapes(self.shape, other.shape)
        n = len(shape)

        def named(t: Tensor, side: str):
            lead = n - t.ndim
            full = [k for k in range(n) if k >= lead and t.shape[k - lead] == shape[k]]
            return t.df.select(*[F.col(f"i{k - lead}").alias(f"{side}{k}") for k in full], F.col("x").alias(side)), set(full)

        (left, lf), (right, rf) = named(self, "a"), named(other, "b")
        both = sorted(lf & rf)
        cond = [F.col(f"a{k}") == F.col(f"b{k}") for k in both]
        joined = left.join(right, cond) if cond else left.join(right)  # without shared axes all cells meet: the result's own size
        for k in range(n):
            if k not in lf and k not in rf:
                joined = joined.withColumn(f"a{k}", F.lit(0).cast("bigint"))
        return joined.select(*[F.col(f"a{k}" if k in lf or k not in rf else f"b{k}").alias(f"i{k}") for k in range(n)], "a", "b"), shape

    def _pairwise(self, other: Tensor, fn, dtype: DType) -> Tensor:
        df, shape = self._joined(other)
        return self._new(df.withColumn("x", fn(F.col("a"), F.col("b")).cast(dtype.spark)), shape, dtype)

    def _combine(self, other: Tensor, op) -> Tensor:
        from stepforge.operators.steps import compact, merged

        df, shape = self._joined(other)
        keys = axes(len(shape))
        tagged = lambda c, s: F.transform(c, lambda p: F.struct(F.lit(s).alias("side"), p["t"].alias("t"), p["v"].alias("v")))
        rows = df.select(*keys, F.inline(F.concat(tagged("a", 0), tagged("b", 1))))
        fn = self._ops()[op] if isinstance(op, str) else op
        points = compact(merged(rows, keys).select(*keys, "t", fn(F.col("fv"), F.col("gv")).alias("v")), keys)
        return from_points(points, shape, self.dtype, complete=True)

    def __add__(self, o):
        return self._binary(o, "+")

    def __sub__(self, o):
        return self._binary(o, "-")

    def __mul__(self, o):
        return self._binary(o, "*")

    def __truediv__(self, o):
        return self._binary(o, "/")

    def __radd__(self, o):
        return self._binary(o, "+", True)

    def __rsub__(self, o):
        return self._binary(o, "-", True)

    def __rmul__(self, o):
        return self._binary(o, "*", True)

    def __rtruediv__(self, o):
        return self._binary(o, "/", True)

    def _inplace(self, other, op: str) -> Tensor:
        if op == "/" and self.dtype.family in ("int", "uint"):
            raise TypeError("whole-number tensors can't take a quotient in place")
        if isinstance(other, Tensor) and broadcast_shapes(self.shape, other.shape) != self.shape:
            raise ValueError("the left side can't grow")
        out = self._binary(other, op)
        if out is NotImplemented:
            return out
        self.df = out.df
        return self

    def __iadd__(self, o):
        return self._inplace(o, "+")

    def __isub__(self, o):
        return self._inplace(o, "-")

    def __imul__(self, o):
        return self._inplace(o, "*")

    def __itruediv__(self, o):
        return self._inplace(o, "/")

    def __neg__(self) -> Tensor:
        self._need("float", "int", "pcf", "ipcf")
        return self._apply(lambda v: -v)

    def __pow__(self, p) -> Tensor:
        self._need(*_FLOATS)
        out = self._apply(lambda v: numeric.ieee_power(v.cast("double"), p))
        values = out.df.select(F.explode("x.v").alias("v")) if self.dtype.family == "pcf" else out.df.select(F.col("x").alias("v"))
        if not values.where(F.isnan("v") | (F.abs("v") == numeric.INF)).isEmpty():
            warnings.warn("power gave NaN or infinity", RuntimeWarning, stacklevel=2)
        return out

    def __ipow__(self, p) -> Tensor:
        self._need(*_FLOATS)
        self.df = self._apply(lambda v: numeric.ieee_power(v.cast("double"), p)).df
        return self

    def __floordiv__(self, o) -> Tensor:
        self._need("float", "int", "uint")
        whole = self.dtype.family != "float"
        if isinstance(o, Tensor):
            return self._pairwise(o, lambda a, b: numeric.floor_divide(a, b, whole), self.dtype)
        return self._apply(lambda v: numeric.floor_divide(v, F.lit(o), whole))

    def __ifloordiv__(self, o) -> Tensor:
        if isinstance(o, Tensor) and broadcast_shapes(self.shape, o.shape) != self.shape:
            raise ValueError("the left side can't grow")
        self.df = (self // o).df
        return self

    def _compare(self, other, fn, ordered: bool) -> Tensor:
        if ordered:
            self._need("float", "int", "uint")
        boolean = dtypes.DTYPES["boolean"]
        if isinstance(other, Tensor):
            if self.dtype != other.dtype:
                raise TypeError(f"{self.dtype} and {other.dtype} don't compare")
            return self._pairwise(other, fn, boolean)
        return self._new(self.df.withColumn("x", fn(F.col("x"), F.lit(other))), dtype=boolean)

    def _equal(self, a: Column, b: Column) -> Column:
        if self.dtype.family == "float":
            return numeric.same_value(a, b)
        if self.dtype.family == "pcf":  # NaN equals nothing
            return (a == b) & ~F.exists(a, lambda p: F.isnan(p["v"]) | F.isnan(p["t"]))
        return a == b

    def __eq__(self, o):  # noqa: PYI032
        return self._compare(o, self._equal, False)

    def __ne__(self, o):
        return self._compare(o, lambda a, b: ~self._equal(a, b), False)

    __hash__ = None

    def __lt__(self, o):
        return self._compare(o, lambda a, b: (a < b) & ~_nan(a, b), True)

    def __le__(self, o):
        return self._compare(o, lambda a, b: (a <= b) & ~_nan(a, b), True)

    def __gt__(self, o):
        return self._compare(o, lambda a, b: (a > b) & ~_nan(a, b), True)

    def __ge__(self, o):
        return self._compare(o, lambda a, b: (a >= b) & ~_nan(a, b), True)

    # ---- whole-tensor questions (R3-R5) ----
    def any_of(self, fn=None) -> bool:
        return not self.df.where(fn(F.col("x")) if fn else F.col("x")).isEmpty()

    def all_of(self, fn=None) -> bool:
        return self.df.where(~(fn(F.col("x")) if fn else F.col("x"))).isEmpty()

    def array_equal(self, other: Tensor) -> bool:
        if self.shape != other.shape or self.dtype != other.dtype:
            return False
        return self._compare(other, self._equal, False).all_of()

    # ---- indexing: see stepforge.indexing (I1-I11) ----
    def __getitem__(self, key):
        from stepforge.indexing import get

        return get(self, key)

    def __setitem__(self, key, value) -> None:
        from stepforge.indexing import put

        self.df = put(self, key, value).df

    def __call__(self, times):
        """Each step function at a time, a list or array of times, or a tensor of times: shape is X.shape + t.shape (E3)."""
        from stepforge.functions.evaluation import evaluate_tensor

        return evaluate_tensor(self, times)


def _nan(a: Column, b: Column) -> Column:
    return F.isnan(a.cast("double")) | F.isnan(b.cast("double"))


def allclose(a: Tensor, b: Tensor, atol: float = 1e-8, rtol: float = 1e-5) -> bool:
    """|a - b| <= atol + rtol * |b| everywhere; for float tensors, and for tensors of matrices of one kind."""
    if a.dtype.family != b.dtype.family or a.dtype.family not in ("float", "distmat", "symmat"):
        raise TypeError("allclose takes two float tensors or two tensors of matrices of one kind")
    if a.shape != b.shape:
        return False
    near = lambda x, y: (F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)) | (x == y) & ~F.isnan(x)
    df, _ = a._joined(b)
    if a.dtype.family == "float":
        return df.where(~near(F.col("a"), F.col("b"))).isEmpty()
    same = (F.col("a.n") == F.col("b.n")) & F.forall(F.arrays_zip(F.col("a.vals").alias("p"), F.col("b.vals").alias("q")), lambda z: near(z["p"], z["q"]))
    return df.where(~same).isEmpty()


# ---- between tensors and points ----------------------------------------------------------------------------------------

def to_points(x: Tensor) -> DataFrame:
    x._need("pcf", "ipcf")
    return x.df.select(*axes(x.ndim), F.inline("x"))


def from_points(points: DataFrame, shape: Sequence[int], dtype="pcf64", complete: bool = False) -> Tensor:
    """A tensor from (i0..ik, t, v); cells without points are zero functions (complete: there are none)."""
    d = as_dtype(dtype)
    keys = axes(len(shape))
    df = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).cast(d.spark).alias("x"))
    if not complete:
        df = cells(points.sparkSession, shape).join(df, keys, "left").withColumn("x", F.coalesce("x", F.expr(dtypes.ZERO[d.family]).cast(d.spark)))
    return Tensor(df, shape, d)


def cells(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """One row for each cell of shape."""
    return spark.range(math.prod(shape)).withColumns(unflatten(F.col("id"), shape)).drop("id")
