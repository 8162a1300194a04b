"""Shared-folder tables: lineage is cut by writing Parquet where every executor can read it."""

import ctypes
import uuid

import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from stepforge.sources.storage import shared_root


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once and read it back: later stages restart from the files, not from df's plan."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote; nothing that is still to run may read them."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df.written_to
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded in bytes: of long texts a batch holds few rows. The bound belongs to the
    session, as plans are lazy; a bound of the caller's own is left alone."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_BYTES))
    return df


#: Rows that a Parquet reader holds at once.
READ_ROWS = 256


def bounded_reads(df: DataFrame) -> DataFrame:
    """df, with the session's Parquet readers bounded in rows: they put a batch's texts into one array, and 4,096 long ones fill
    a heap. As in bounded_batches, the bound belongs to the session and one of the caller's own is left alone."""
    conf, key = df.sparkSession.conf, "spark.sql.parquet.columnarReaderBatchSize"
    if key not in conf.getAll:
        conf.set(key, str(READ_ROWS))
    return df


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks, and the next stage's memory counts beside theirs."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_schema(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


#: Whole numbers with nulls stay whole: as floats, those beyond 2^53 would change.
_WHOLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}


def map_frames(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """run over the pandas frames of each task, as mapInPandas, but for columns of whole numbers, which are Int64 with NA for
    null whatever their rows hold; a task gives its memory back at its end."""
    out = arrow_schema(schema)

    def mapped(batches):
        for frame in run(b.to_pandas(types_mapper=_WHOLE.get) for b in batches):
            yield pa.RecordBatch.from_pandas(frame, schema=out, preserve_index=False)
        give_back()

    return df.mapInArrow(mapped, schema)


def whole(column: pd.Series) -> list:
    """Python integers, None for null."""
    return [None if v is pd.NA else v for v in column.tolist()]


def bounded_broadcast(df: DataFrame, rows: int, max_rows: int = 200_000):
    """Broadcast hint for a materialized table whose counted rows are within max_rows, else the table as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= max_rows else df


def hash_sample(df: DataFrame, key: str, most: int, columns: list[str]) -> list:
    """`most` rows at most, those with the smallest hashes of key, on the driver: rows above a hash that leaves a
    tenth more than asked for are filtered out where they are, so no task sends more than its share."""
    from pyspark.sql import functions as F

    n = df.count()
    h = F.shiftrightunsigned(F.xxhash64(F.lit(97), key), 24)
    picked = df.withColumn("__h", h)
    if n > most:
        picked = picked.where(F.col("__h") < int((1 << 40) * min(1.0, 1.1 * most / n)))
    # the limit holds where many rows have one key; the order makes it a top-k in each task
    rows = picked.select("__h", *columns, F.xxhash64(F.lit(11), *columns).alias("__tie")).orderBy("__h", "__tie").limit(most).collect()
    return sorted(rows, key=lambda r: (r[0], *(str(v) for v in r[1:])))
