"""Line deduplication: explode normalised lines, hash, find those of several documents per host, drop, reassemble.

A line's key is the line without white space at its ends and with A-Z lower-cased; keys shorter than min_chars stay.
Keys travel as two 64-bit hashes. A key found in at least min_docs documents of a host (all rows are one host if no host
column is given) loses its lines in all documents but the smallest id that holds it.

Defined cases: null text is one empty line; rows repeated under one id are the same document; rows with a null id are
neither counted nor changed; ties have no effect (the smallest id is unique); extra columns pass through.
"""

from pyspark.sql import Column, DataFrame, functions as F

from stepforge.llm.storage import bounded_broadcast, bounded_reads, materialize

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _lines(docs: DataFrame, host: str | None, min_chars: int) -> DataFrame:
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").alias("__id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("__row"),
        (F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit("\0"))) if host else F.lit(0).cast("long")).alias("__host"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("__pos", "__line"),
    )
    keyed = rows.withColumn("__key", line_key(F.col("__line"))).where(F.length("__key") >= min_chars)
    return keyed.select("__id", "__row", "__pos", "__host", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(7), "__key").alias("__h2"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, host: str | None = None) -> DataFrame:
    """docs with text reassembled from the lines that stay, and __n_lines, __n_dropped."""
    docs = bounded_reads(docs)
    lines = _lines(docs, host, min_chars)
    by_key = lines.groupBy("__host", "__h1", "__h2")
    if min_docs <= 2:
        common = by_key.agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last")
    else:
        common = by_key.agg(F.min("__id").alias("__first"), F.countDistinct("__id").alias("__docs")).where(F.col("__docs") >= min_docs)
    common = materialize(common.select("__host", "__h1", "__h2", "__first"), "common-lines")
    hits = lines.join(bounded_broadcast(common, common.count()), ["__host", "__h1", "__h2"]).where("__id <> __first")
    drops = hits.groupBy("__id", "__row").agg(F.collect_set("__pos").alias("__drop"))  # positions of one document's lines
    left = docs.withColumns({"__row": F.xxhash64(F.coalesce("text", F.lit(""))), "__join": F.col("doc_id")})
    right = drops.withColumnsRenamed({"__id": "__join"}).hint("shuffle_hash")
    both = left.join(right, ["__join", "__row"], "left").withColumn("__ls", F.split(F.coalesce("text", F.lit("")), "\n"))
    n = F.size("__ls")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__drop"))
    kept = F.when(F.col("__drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.col("__ls")[i]), "\n"))
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    return both.select("doc_id", kept.alias("text"), *other, n.cast("long").alias("__n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("__n_dropped"))
