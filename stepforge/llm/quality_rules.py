"""Quality rules with cross-document line frequency, in DataFrame functions only.

Normalised lines are hashed; each host's (source's) documents holding a line are counted; lines of more than max_docs
documents of a host are removed; a document is depleted if fewer than min_left of its words stay. The base rules (words,
symbols, repeated lines and 3-word windows) are array functions within the row.

Defined cases: null or empty text has no words and fails; each row counts as a document, so repeated rows count each; a
null source is a host of its own; null ids keep their row; an empty table gives no rows; extra columns are ignored.
"""

from pyspark.sql import DataFrame, functions as F

from stepforge.llm.line_dedup import line_key
from stepforge.llm.storage import bounded_broadcast, materialize

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_DOCS, MIN_LINE_CHARS, MIN_LEFT = 10, 10, 0.5
SYMBOLS = "#*$%&|<>"
_WS = r"[\x20\x09-\x0D]+"


def with_rules(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("__ws", F.filter(F.split(text, _WS), lambda w: w != ""))
    d = d.withColumn("__tri", F.when(F.size("__ws") >= 3, F.transform(F.sequence(F.lit(0), F.size("__ws") - 3), lambda i: F.xxhash64(F.col("__ws")[i], F.col("__ws")[i + 1], F.col("__ws")[i + 2]))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("__some", F.size(F.array_distinct("__tri")) < F.size("__tri"))
    # sorted (hash, position) pairs: a window repeats if a neighbour has the same hash
    d = d.withColumn("__so", F.when(F.col("__some"), F.sort_array(F.transform("__tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    before = lambda i: (i > 0) & (F.col("__so")[F.greatest(i - 1, F.lit(0))]["h"] == F.col("__so")[i]["h"])
    after = lambda i: (i < F.size("__so") - 1) & (F.col("__so")[F.least(i + 1, F.size("__so") - 1)]["h"] == F.col("__so")[i]["h"])
    d = d.withColumn("__at", F.when(F.col("__some"), F.sort_array(F.transform(F.filter("__so", lambda x, i: before(i) | after(i)), lambda x: x["i"]))))
    # each repeated window covers its words up to the next repeated window
    covered = F.aggregate("__at", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")), lambda s: s["n"])
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    d = d.withColumn("__ls", lines)
    d = d.withColumns({
        "n_words": F.size("__ws").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, _WS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__ls") - F.size(F.array_distinct("__ls"))).cast("long"),
        "n_repeat_words": F.coalesce(F.when(F.col("__some"), covered), F.lit(0)).cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("__ws", "__tri", "__some", "__so", "__at", "__ls")


def _host_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each distinct normalised line of a row of docs: row key, host, hash, words in all its occurrences."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__row"), F.xxhash64(F.coalesce("source", F.lit("\0"))).alias("__host"),
        F.explode(F.array_distinct(F.transform(F.split(text, "\n"), line_key))).alias("__key"),
    ).where(F.length("__key") >= min_chars)
    return rows.select("__id", "__row", "__host", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(7), "__key").alias("__h2"))


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__row"), F.xxhash64(F.coalesce("source", F.lit("\0"))).alias("__host"),
        F.posexplode(F.transform(F.split(text, "\n"), line_key)).alias("__pos", "__key"),
    ).where(F.length("__key") >= min_chars)
    return rows.select("__id", "__row", "__host", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(7), "__key").alias("__h2"), F.size(F.split("__key", _WS)).alias("__w"))


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_chars: int = MIN_LINE_CHARS, min_left: float = MIN_LEFT) -> DataFrame:
    """The rule columns of each row of docs with removed_words (in lines above the limit) and kept."""
    docs = docs.select("doc_id", "text", "source")
    common = _host_lines(docs, min_chars).groupBy("__host", "__h1", "__h2").agg(F.count("*").alias("__docs")).where(F.col("__docs") > max_docs)
    common = materialize(common.select("__host", "__h1", "__h2"), "common-lines")
    hits = _occurrences(docs, min_chars).join(bounded_broadcast(common, common.count()), ["__host", "__h1", "__h2"])
    once = hits.groupBy("__id", "__row", "__host", "__pos").agg(F.max("__w").alias("__w"))  # repeated rows have the same lines
    removed = once.groupBy("__id", "__row", "__host").agg(F.sum("__w").cast("long").alias("removed_words"))
    rules = with_rules(docs).withColumns({"__row": F.xxhash64(F.coalesce("text", F.lit(""))), "__host": F.xxhash64(F.coalesce("source", F.lit("\0")))}).drop("text", "source")
    same = rules["doc_id"].eqNullSafe(removed["__id"]) & (rules["__row"] == removed["__row"]) & (rules["__host"] == removed["__host"])
    out = rules.join(removed, same, "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= min_left * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "removed_words")
