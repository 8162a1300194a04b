"""The pipeline's stages, each on what the one before it wrote."""

import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline

from stepforge.llm import language_id, line_dedup, minhash_dedup, packing


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    rows = []
    for k in range(120):
        en = k % 2 == 0
        words = ["the", "thing", "was", "over", "with"] if en else ["der", "schuh", "ung", "ist", "über"]
        rows.append((k, "\n".join(" ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(12)) for _ in range(4)), "en" if en else "de", f"s{k % 5}" if k % 7 else None, 0))
    rows += [(200 + k, rows[k][1], rows[k][2], rows[k][3], 0) for k in range(10)]
    rows += [(300, None, None, "s1", 0), (301, "", None, "s1", 0), (302, "123 456", "en", None, 0), (0, rows[0][1], "en", None, 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
        seen[name] = (ids(before), ids(docs))
        if name == "near_dedup":
            again = minhash_dedup.near_duplicates(docs)
            assert again.where(~F.col("kept")).isEmpty() and len(set(ids(docs))) == len(ids(docs))
        if name == "mixing":
            assert set(ids(docs)) <= set(ids(before))
    gone = set(seen["language_id"][0]) - set(seen["language_id"][1])
    assert gone == {300, 301, 302}
    assert seen["line_dedup"][0] == seen["line_dedup"][1]
    assert set(seen["near_dedup"][1]) >= set(range(120))
    assert set(seen["packing"][0]) == set(seen["packing"][1])


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


def test_language_scores_decide(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert ids(corpus_pipeline.identify_language(spark, unlabelled, sf_dir)) == ids(docs) - {300, 301, 302}
    sure = corpus_pipeline.language_id.predict

    def torn(*args):
        return sure(*args).withColumn("__score", F.when(F.col("doc_id") == 5, 0.52).otherwise(F.col("__score")))

    monkeypatch.setattr(corpus_pipeline.language_id, "predict", torn)
    assert ids(corpus_pipeline.identify_language(spark, docs, sf_dir)) == ids(docs) - {5, 300, 301, 302}


def test_near_dedup_shuffles_no_texts_to_find_those_that_are_left(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 300")
    read = []

    def seen(d, **options):
        read.append(d)
        return minhash_dedup_near(d, **options)

    minhash_dedup_near = minhash_dedup.near_duplicates
    monkeypatch.setattr(minhash_dedup, "near_duplicates", seen)
    small, key = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")  # tables are not small because the test's are
    kept = {r[0] for r in corpus_pipeline.dedup_documents(spark, docs, sf_dir).select("doc_id").collect()}
    came = read[0]
    plan = came._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(key, small)
    assert {r[0] for r in came.collect()} == {r[0] for r in docs.collect()}
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert kept == set(range(120))


def test_every_stage_reads_few_rows_at_once(spark, sf_dir):
    """4,096 texts in one array fill a heap, whichever stage reads them."""
    bound = "spark.sql.parquet.columnarReaderBatchSize"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage in (line_dedup.dedup_lines, language_id.training_sample, lambda d: packing.pack_documents(d, corpus_pipeline.tokenizer_path()), minhash_dedup.near_duplicates):
        spark.conf.unset(bound)
        stage(docs.limit(5))
        assert spark.conf.get(bound) == "256"
