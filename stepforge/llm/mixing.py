"""Mixing sources to target weights: hash-random keys, ordered within each source, prefix sums, exact budgets.

Sources by code point (null last) weigh weights[0], weights[1], ... repeating. Targets share `share` times all words by
weight; a target stops at `cap` times its source's words and the excess is shared again by weight. A document's key is
md5(doc_id|seed); the leading hex digits deal a source's documents into ranges of keys small enough for one task, so the
words before a document are the words of earlier ranges (prefix sum over range totals) plus those before it in its own
range. A source takes whole epochs while its budget lasts and is cut in the last one at the exact word.

Defined cases: null text has size 0 and is never taken; sources without words have target 0; repeated rows count each;
rows tied in key are ordered by id and size (equal ones are interchangeable); null ids have one key, and many of them are one
range; long texts are counted, and in the mix cut, whole; an empty table gives no rows; extra columns pass through, whatever
their names, but for __size, __source_size, __target and __taken.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from stepforge.llm.storage import bounded_reads, materialize

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix"
ROWS_A_RANGE = 2000
_SPACE = r"\x20\x09-\x0D"


def n_words(text: Column) -> Column:
    """Words become one letter each and the letters are counted: regexp_count would first list all words of a text."""
    letters = F.regexp_replace(text, f"[{_SPACE}]*[^{_SPACE}]+[{_SPACE}]*", "w")
    return F.when(text.rlike(f"[^{_SPACE}]"), F.length(letters)).otherwise(0).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """__n, __s, source_size with target: one row per source, water-filled. Sources are a small table; one window orders them."""
    order = Window.orderBy("__n", "__s")
    wts = F.array(*[F.lit(float(w)) for w in weights])
    w = sources.withColumn("__w", wts[(F.row_number().over(order) - 1) % len(weights)])
    w = w.withColumn("__c", F.lit(cap) * F.col("source_size") / F.col("__w"))
    ranked = Window.orderBy("__c", "__n", "__s")
    all_ = Window.partitionBy()
    capped = F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumns({"__k": F.row_number().over(ranked), "__lam": (F.lit(share) * F.sum("source_size").over(all_) - capped) / rest})
    level = F.min(F.when(F.col("__lam") < F.col("__c"), F.struct("__k", "__lam"))).over(all_)
    w = w.withColumn("__at", level)
    limit = F.lit(cap) * F.col("source_size")
    target = F.when(F.col("__at").isNull() | (F.col("__k") < F.col("__at.__k")), limit).otherwise(F.col("__at.__lam") * F.col("__w"))
    return w.select("__n", "__s", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """docs with __size, __source_size, __target and __taken."""
    docs = bounded_reads(docs)
    digits = max(1, math.ceil(math.log(max(1, docs.count() / ROWS_A_RANGE), 16)))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|" + seed)).cast("binary"))
    # the row itself is one column: no name of docs can clash with those of the plan
    base = docs.select(F.struct(*docs.columns).alias("__doc"), n_words(F.col("text")).alias("__size"), key.alias("__key"), F.col("source").isNull().cast("int").alias("__n"), F.coalesce("source", F.lit("")).alias("__s"))
    base = base.withColumn("__range", F.substring("__key", 1, digits))
    ranges = materialize(base.groupBy("__n", "__s", "__range").agg(F.sum("__size").alias("__words")), "ranges")
    plan = materialize(targets(ranges.groupBy("__n", "__s").agg(F.sum("__words").alias("source_size")), weights, share, cap), "targets")
    earlier = F.sum("__words").over(Window.partitionBy("__n", "__s").orderBy("__range")) - F.col("__words")
    ranges = ranges.select("__n", "__s", "__range", earlier.alias("__earlier")).join(plan, ["__n", "__s"])
    own = Window.partitionBy("__n", "__s", "__range").orderBy("__key", "__doc.doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target")
    left = budget % F.col("source_size") - F.col("__earlier") - F.coalesce(F.sum("__size").over(own), F.lit(0))
    taken = F.floor(budget / F.col("source_size")) * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), left))
    done = base.join(ranges, ["__n", "__s", "__range"]).withColumn("__taken", F.when(F.col("source_size") > 0, taken).otherwise(0).cast("long"))
    return done.select("__doc.*", "__size", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__taken")


def realize(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken; a part taken in the last epoch is its leading words."""
    whole = F.when(F.col("__size") > 0, F.floor(F.col("__taken") / F.col("__size"))).otherwise(0).cast("int")
    part = F.when(F.col("__size") > 0, F.col("__taken") % F.col("__size")).otherwise(0).cast("long")
    counts = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    rows = mixed.select(*columns, F.explode(counts).alias("__words"))
    # cut between a word's end and the white space after it: each piece but a blank last one ends in one word
    lead = F.array_join(F.slice(F.split("text", f"(?<=[^{_SPACE}])(?=[{_SPACE}])"), 1, F.col("__words").cast("int")), "")
    return rows.withColumn("text", F.when(F.col("__words") >= 0, lead).otherwise(F.col("text"))).select(*columns)
