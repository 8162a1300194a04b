"""Functions over tensors: reductions, norms, distances, kernels and barcode summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from pyspark.sql import functions as F

from stepforge.dtypes import DTYPES
from stepforge.functions.numeric import INF
from stepforge.operators import barcodes, pairs, steps
from stepforge.operators.homology import persistent_homology
from stepforge.operators.matrices import DistanceMatrix, SymmetricMatrix, stack_matrices
from stepforge.sources.construct import pcf_tensor, point_clouds, stack, zeros
from stepforge.tensor import Tensor, allclose, axes, from_points, to_points  # noqa: F401


def _number(x: Tensor) -> str:
    return "float32" if x.dtype.name.endswith("32") else "float64"


def _scalars(df, shape, x: Tensor) -> Tensor:
    name = _number(x)
    return Tensor(df.withColumn("x", F.col("x").cast(DTYPES[name].spark)), shape, name)


def _floats(x: Tensor) -> None:
    if x.dtype.family != "pcf":
        raise TypeError("float step functions are asked for")


def _without(x: Tensor, dim: int):
    """Axes that stay, their new names, the shape left ((1,) for none) and the axis that goes."""
    dim = x._axis(dim)
    kept = [k for k in range(x.ndim) if k != dim]
    return dim, [f"i{k}" for k in kept], tuple(x.shape[k] for k in kept)


def _renamed(df, old: Sequence[str]):
    if not old:
        return df.withColumn("i0", F.lit(0).cast("bigint"))
    return df.withColumnsRenamed({o: f"__n{k}" for k, o in enumerate(old)}).withColumnsRenamed({f"__n{k}": f"i{k}" for k in range(len(old))})


def mean(x: Tensor, dim: int = 0) -> Tensor:
    """Pointwise mean along an axis; a 1-D tensor gives shape (1,)."""
    _floats(x)
    dim, kept, shape = _without(x, dim)
    out = steps.mean(to_points(x), kept, f"i{dim}", x.shape[dim])
    return from_points(_renamed(out, kept), shape or (1,), x.dtype)


def max_time(x: Tensor, dim: int = 0) -> Tensor:
    """Last breakpoint along an axis."""
    x._need("pcf", "ipcf")
    dim, kept, shape = _without(x, dim)
    last = x.df.select(*kept, F.array_max(F.transform("x", lambda p: p["t"])).alias("__t"))
    out = last.groupBy(*kept).agg(F.max("__t").alias("x"))
    return _scalars(_renamed(out, kept), shape or (1,), x)


def reduce(x: Tensor, op, dim: int = 0) -> Tensor:
    """Any aggregate along an axis, at each breakpoint of the group: "sum", "max", "min", or a function of a column."""
    x._need("pcf", "ipcf")
    dim, kept, shape = _without(x, dim)
    out = steps.fold(to_points(x), kept, f"i{dim}", op)
    return from_points(_renamed(out, kept), shape or (1,), x.dtype)


parallel_reduce = reduce
average = mean


def combine(f: Tensor, g: Tensor, op) -> Tensor:
    """op(fv, gv) cell by cell, on the union of breakpoints."""
    if f.dtype != g.dtype:
        raise TypeError(f"{f.dtype} and {g.dtype} don't mix")
    return f._combine(g, op)


def iterate_rectangles(f: Tensor, g: Tensor, a: float = 0.0, b: float = INF):
    """(l, r, fv, gv) rows for each cell of two tensors of one shape."""
    if f.shape != g.shape:
        raise ValueError("tensors of one shape are asked for")
    return steps.rectangles(to_points(f), to_points(g), axes(f.ndim), a, b)


def lp_norm(x: Tensor | list, p: float = 1.0) -> Tensor:
    """Of each function of a tensor or a list."""
    x = _listed(x)
    _floats(x)
    return _scalars(steps.lp_norm(to_points(x), axes(x.ndim), p), x.shape, x)


def l2_norm(x: Tensor) -> Tensor:
    return lp_norm(x, 2.0)


def linfinity_norm(x: Tensor) -> Tensor:
    _floats(x)
    return _scalars(steps.linfinity_norm(to_points(x), axes(x.ndim)), x.shape, x)


def lp_distance(f: Tensor, g: Tensor, p: float = 1.0) -> float:
    _floats(f)
    if f.dtype != g.dtype:
        raise TypeError(f"{f.dtype} and {g.dtype} don't mix")
    if f.size != 1 or g.size != 1:
        raise ValueError("one function each is asked for")
    return pairs.lp_distance(to_points(f), to_points(g), p).first()["d"]


def _one_axis(x: Tensor) -> None:
    _floats(x)
    if x.ndim != 1:
        raise ValueError("a tensor with one axis is asked for")


def _listed(x) -> Tensor:
    """A tensor, or a list of single functions as one: tensors of one element, or elements as indexing gives them (rows of
    time and value, taken as pcf64). An empty list is a tensor of shape (0,)."""
    if isinstance(x, Tensor):
        return x
    x = [f if isinstance(f, Tensor) else _element(f) for f in x]
    if len({f.dtype.name for f in x}) > 1:
        raise TypeError("functions of one type are asked for")
    return stack([f.reshape(()) for f in x]) if x else zeros(_session(), (0,), "pcf64")


def _element(rows) -> Tensor:
    try:
        pairs_ = [(float(t), float(v)) for t, v in rows]
    except (TypeError, ValueError) as e:
        raise TypeError("a tensor or a list of functions is asked for") from e
    return pcf_tensor(_session(), [pairs_], "pcf64")


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def pdist(x: Tensor | list, p: float = 1.0, strategy: str = "auto") -> DistanceMatrix:
    x = _listed(x)
    _one_axis(x)
    return DistanceMatrix(pairs.pdist(to_points(x), "i0", p, strategy), x.shape[0], complete=True)


def cdist(x: Tensor | list, y: Tensor | list, p: float = 1.0, strategy: str = "auto") -> Tensor:
    """Shape x.shape + y.shape, for tensors or lists of functions."""
    x, y = _listed(x), _listed(y)
    _floats(x)
    if 0 not in (*x.shape, *y.shape) and x.dtype != y.dtype:
        raise TypeError(f"{x.dtype} and {y.dtype} don't mix")
    d = pairs.cdist(to_points(x), to_points(y), axes(x.ndim), axes(y.ndim), p, strategy)
    names = {f"j{k}": f"i{x.ndim + k}" for k in range(y.ndim)}
    return _scalars(d.withColumnsRenamed(names).withColumnRenamed("d", "x"), (*x.shape, *y.shape), x)


def l2_kernel(x: Tensor | list, strategy: str = "auto") -> SymmetricMatrix:
    x = _listed(x)
    _one_axis(x)
    return SymmetricMatrix(pairs.l2_kernel(to_points(x), "i0", strategy), x.shape[0], complete=True)


def l2_cross_kernel(x: Tensor, y: Tensor, strategy: str = "auto") -> Tensor:
    _one_axis(x)
    _one_axis(y)
    k = pairs.l2_cross_kernel(to_points(x), to_points(y), "i0", "i0", strategy)
    return _scalars(k.select(F.col("i").alias("i0"), F.col("j").alias("i1"), F.col("k").alias("x")), (x.shape[0], y.shape[0]), x)


def compute_persistent_homology(x, max_dim: int = 1, reduced: bool = False, distance_type: str = "Euclidean", complex_type: str = "VietorisRips", spark=None) -> Tensor:
    """Barcodes for a tensor of clouds or distance matrices (shape x.shape + (max_dim + 1,)), or for one cloud, given as an
    n x d array or float tensor, or one DistanceMatrix (shape (max_dim + 1,))."""
    one = not (isinstance(x, Tensor) and x.dtype.family in ("pcloud", "distmat"))
    if isinstance(x, DistanceMatrix):
        x = stack_matrices([x])
    elif one:
        if isinstance(x, Tensor):
            if x.dtype.family != "float":
                raise TypeError("clouds or distance matrices are asked for")
            spark, x = x.spark, x.to_numpy()
        x = np.asarray(x, float)
        if x.ndim != 2:
            raise ValueError("a cloud is an n x d array of points")
        x = point_clouds(spark, [x])
    h = persistent_homology(x, max_dim, reduced, distance_type, complex_type)
    return h[0] if one else h


def element_to_numpy(x: Tensor):
    """The n x 2 array of one step function (times, values) or barcode (births, deaths)."""
    x._need("pcf", "ipcf", "barcode")
    return np.array([tuple(r) for r in x.item()], x.dtype.numpy).reshape(-1, 2)


def n_points(x: Tensor) -> Tensor:
    """How many breakpoints (or bars) each element has (A6)."""
    x._need("pcf", "ipcf", "barcode")
    return Tensor(x.df.withColumn("x", F.size("x").cast("bigint")), x.shape, "int64")


def to_string(x: Tensor) -> str:
    """One element's (time, value) or (birth, death) rows as text."""
    return "[" + ", ".join(f"({a:g}, {b:g})" for a, b in element_to_numpy(x)) + "]"


def to_bars(x: Tensor):
    x._need("barcode")
    return x.df.select(*axes(x.ndim), F.inline("x"))


def _summary(x: Tensor, fn, **more) -> Tensor:
    keys = axes(x.ndim)
    out = fn(to_bars(x), keys, index=x.df.select(*keys) if keys else x.df, **more)
    return from_points(out, x.shape, "pcf32" if x.dtype.name.endswith("32") else "pcf64", complete=True)


def barcode_to_stable_rank(x: Tensor) -> Tensor:
    return _summary(x, barcodes.stable_rank)


def barcode_to_betti_curve(x: Tensor) -> Tensor:
    return _summary(x, barcodes.betti_curve)


def barcode_to_accumulated_persistence(x: Tensor, max_death: float = INF) -> Tensor:
    return _summary(x, barcodes.accumulated_persistence, max_death=max_death)


def is_isomorphic(a: Tensor, b: Tensor) -> bool:
    """Two barcodes equal but for the order of their bars."""
    return barcodes.is_isomorphic(to_bars(a), to_bars(b))
