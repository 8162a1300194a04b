"""Streams of events against the same events as a batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stepforge.streaming import ingest

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _batches(spark, path, n=3):
    t0 = datetime(2024, 1, 1)
    rows = [(k, t0 + timedelta(minutes=7 * k), k % 3, "ab"[k % 2], float(k)) for k in range(60)]
    step = len(rows) // n
    for b in range(n):
        spark.createDataFrame(rows[b * step : (b + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return rows


def _run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp-{name}").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_of_segments(spark, tmp_path):
    rows = _batches(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in")
    got = _run(spark, ingest.segments_from_stream(stream), "segs", tmp_path)
    assert got.count() == len(rows) - 3 and got.where(F.col("r") - F.col("l") != 21 * 60 * 1_000_000).isEmpty()


def test_stream_of_windows_closes_by_the_watermark(spark, tmp_path):
    _batches(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    got = _run(spark, ingest.windowed_integral(stream, watermark="10 minutes"), "wins", tmp_path)
    first = got.where("event_type = 'a'").orderBy("w").first()
    assert first["n"] == 5 and first["total"] == 20.0 and first["top"] == 8.0
