"""Random tensors. Every number is a hash of (seed, cell, draw), so results don't depend on partitions."""

from __future__ import annotations

import math

from collections.abc import Sequence

import numpy as np
import pandas as pd

from pyspark.sql import Column, SparkSession, Window, functions as F

from stepforge.dtypes import dtype as as_dtype
from stepforge.tensor import Tensor, axes, cells, flat_index


class Generator:
    """A master seed; each use draws from a stream of its own."""

    def __init__(self, seed: int = 0):
        self.seed(seed)

    def seed(self, seed: int) -> None:
        self._seed, self._used = int(seed), 0

    def stream(self) -> int:
        self._used += 1
        return self._seed * 1_000_003 + self._used


_default = Generator(42)


def seed(s: int) -> None:
    """Restarts the default generator."""
    _default.seed(s)


def uniform(stream: int, cell: Column, draw: Column | int, salt: int = 0) -> Column:
    """In (0, 1)."""
    h = F.xxhash64(F.lit(stream).cast("bigint"), cell, F.lit(draw) if isinstance(draw, int) else draw, F.lit(salt))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal(stream: int, cell: Column, draw: Column | int) -> Column:
    """Box and Muller's transform of two uniforms."""
    return F.sqrt(-2 * F.log(uniform(stream, cell, draw, 1))) * F.cos(2 * math.pi * uniform(stream, cell, draw, 2))


def _noisy(spark: SparkSession, fn, shape: Sequence[int], n_points: int, dtype, generator: Generator | None) -> Tensor:
    d = as_dtype(dtype)
    if d.family != "pcf":
        raise TypeError("noisy functions are float step functions")
    stream = (generator or _default).stream()
    base = cells(spark, shape).withColumn("__f", flat_index(shape)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))))
    keys = axes(len(shape))
    w = Window.partitionBy("__f").orderBy("t", "__k")
    raw = base.withColumn("t", F.when(F.col("__k") == 0, 0.0).otherwise(uniform(stream, F.col("__f"), F.col("__k"))))
    last = F.row_number().over(w) == n_points
    noise = normal(stream, F.col("__f"), F.col("__k")) * 0.1
    rows = raw.withColumn("v", F.when(last, 0.0).otherwise(fn(2 * math.pi * F.col("t")) + noise))
    x = F.array_sort(F.collect_list(F.struct("t", "v"))).cast(d.spark)
    return Tensor(rows.groupBy(*keys, "__f").agg(x.alias("x")), shape, d)


def noisy_sin(spark: SparkSession, shape: Sequence[int], n_points: int = 20, dtype="pcf32", generator: Generator | None = None) -> Tensor:
    """Random breakpoints in (0, 1) with sin(2 pi t) plus noise of deviation 0.1; first time 0, last value 0."""
    return _noisy(spark, F.sin, shape, n_points, dtype, generator)


def noisy_cos(spark: SparkSession, shape: Sequence[int], n_points: int = 20, dtype="pcf32", generator: Generator | None = None) -> Tensor:
    return _noisy(spark, F.cos, shape, n_points, dtype, generator)


def sample_poisson(spark: SparkSession, shape: Sequence[int], dim: int = 2, rate: float = 1.0, lo=None, hi=None, generator: Generator | None = None, dtype="pcloud64") -> Tensor:
    """Poisson point processes in boxes: the number of points is Poisson(rate times volume), points are uniform."""
    lo = [0.0] * dim if lo is None else [float(v) for v in np.broadcast_to(lo, (dim,))] if np.ndim(lo) == 0 else list(map(float, lo))
    hi = [1.0] * dim if hi is None else [float(v) for v in np.broadcast_to(hi, (dim,))] if np.ndim(hi) == 0 else list(map(float, hi))
    if len(lo) != dim or len(hi) != dim:
        raise ValueError("lo and hi have one number for each dimension")
    if any(a > b for a, b in zip(lo, hi, strict=True)):
        raise ValueError("lo must not exceed hi")
    d, stream = as_dtype(dtype), (generator or _default).stream()
    volume = math.prod(b - a for a, b in zip(lo, hi, strict=True))
    keys = axes(len(shape))

    def draw(frames):
        for pdf in frames:
            out = []
            for f in pdf["__f"]:
                rng = np.random.Generator(np.random.Philox(key=[stream % (1 << 64), int(f)]))
                out.append(rng.uniform(lo, hi, (rng.poisson(rate * volume), dim)).tolist())
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "x": out})

    schema = ", ".join([*[f"{k} bigint" for k in keys], "x array<array<double>>"])
    df = cells(spark, shape).withColumn("__f", flat_index(shape)).mapInPandas(draw, schema)
    return Tensor(df.withColumn("x", F.col("x").cast(d.spark)), shape, d)
