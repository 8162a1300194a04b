"""Evaluation of tensors of step functions at times."""

from pyspark.sql import functions as F

from stepforge.dtypes import DTYPES
from stepforge.operators.steps import evaluate_at
from stepforge.tensor import Tensor, axes, flat_index, to_points, unflatten


def value_at(pts, t: float):
    """One array-valued function at one time, as a column."""
    return F.element_at(F.filter(pts, lambda p: p["t"] <= t), -1)["v"]


def evaluate_tensor(x: Tensor, times):
    """x.shape + shape of times; a single time gives x.shape."""
    x._need("pcf", "ipcf")
    number = {"pcf32": "float32", "pcf64": "float64", "pcf32i": "int32", "pcf64i": "int64"}[x.dtype.name]
    if isinstance(times, (int, float)):
        if times < 0:
            raise ValueError("functions have no values before 0")
        return Tensor(x.df.withColumn("x", value_at(F.col("x"), times)), x.shape, number)
    if isinstance(times, Tensor):
        t, shape = times.df.select(flat_index(times.shape).alias("__f"), F.col("x").cast("double").alias("time")), times.shape
    else:
        import numpy as np

        a = np.asarray(times, float)
        shape = a.shape
        t = x.spark.createDataFrame([(i, float(v)) for i, v in enumerate(a.ravel())], "__f bigint, time double")
    keys = axes(x.ndim)
    found = evaluate_at(to_points(x), keys, t)
    new = {f"i{x.ndim + int(k[1:])}": c for k, c in unflatten(F.col("__f"), shape).items()}
    return Tensor(found.withColumns(new).withColumn("x", F.col("v").cast(DTYPES[number].spark)), (*x.shape, *shape), number)
