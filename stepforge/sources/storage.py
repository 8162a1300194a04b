"""Saved tensors: Parquet rows and a JSON file with shape and dtype beside them, read by any Spark file system."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from stepforge.dtypes import DTYPES
from stepforge.tensor import Tensor

FORMAT = 1


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where the session names none, a temporary folder does for a master
    whose executors are the driver's own process; any other cluster has to name one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tables-")
        sc.setCheckpointDir(own)
        root = sc.getCheckpointDir()
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return root.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back, so that what made it, its shuffles above all, is made once and then goes."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.System.gc()  # files of shuffles go with what refers to them
    return spark.read.schema(df.schema).parquet(path)


def save(item: Tensor, path: str, mode: str = "errorifexists") -> None:
    item.df.write.mode(mode).parquet(f"{path}/cells")
    head = json.dumps({"format": FORMAT, "shape": item.shape, "dtype": item.dtype.name})
    item.spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/head")


def load(spark: SparkSession, path: str) -> Tensor:
    try:
        head = json.loads(spark.read.text(f"{path}/head").first()["value"])
        shape, dtype = tuple(map(int, head["shape"])), head["dtype"]
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise ValueError(f"{path} holds no tensor") from e
    if head.get("format") != FORMAT or dtype not in DTYPES:
        raise ValueError(f"{path} has format {head.get('format')} and dtype {dtype}")
    return Tensor(spark.read.parquet(f"{path}/cells"), shape, dtype)


def save_points(points: DataFrame, path: str, buckets: int, key: str) -> None:
    """Points as a table bucketed by function, so that later windows and groups by function don't shuffle."""
    points.write.bucketBy(buckets, key).sortBy(key, "t").mode("overwrite").option("path", path).saveAsTable(path.rstrip("/").rpartition("/")[2])
