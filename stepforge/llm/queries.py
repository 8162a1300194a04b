"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB equivalents."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from stepforge.llm import cover_tree, html_extract, language_id, line_dedup, minhash_dedup, mixing, packing, quality_rules, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), tokenizer_path(), packing.MAX_LEN, packing.END_ID)
    packed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), packing.MAX_LEN)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    done = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return done.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    done = language_id.predict(docs, language_id.train(docs), ["doc_id"])
    return done.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("__pred").alias("lang_pred"), F.col("__score").alias("score"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_chars=10, min_docs=2)
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.archive(_table(spark, sf_dir, "pages"), min_bytes=100)
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), n=2, percent=80)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_mix_sources": op2_mix_sources,
    "op3_toxicity": op3_toxicity,
    "op4_html_extract": op4_html_extract,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_cover_tree": op7_cover_tree,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "pipeline": pipeline,
}

_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY_SQL = f"translate(trim(line, {_SPACE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS_SQL})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|mix') AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM s
), c AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS c FROM w
), l AS (
  SELECT *, row_number() OVER o AS k,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam
  FROM c WINDOW o AS (ORDER BY c, source IS NULL, source)
), a AS (
  SELECT *, min(k) FILTER (lam < c) OVER () AS ka FROM l
), t AS (
  SELECT source, source_size, CASE WHEN ka IS NULL OR k < ka THEN 2.0::DOUBLE * source_size ELSE max(CASE WHEN k = ka THEN lam END) OVER () * w END AS target FROM a
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p
"""

OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d
), tri AS (
  SELECT rid, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, unnest(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w
), rep AS (
  SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), cov AS (
  SELECT rid, sum(least(3, coalesce(i - p, 3)))::BIGINT AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM rep) GROUP BY rid
), x AS (
  SELECT rid, doc_id, host, unnest(ls) AS line FROM w
), nl AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM x WHERE trim(line, {_SPACE_SQL}) <> '' GROUP BY rid
), k AS (
  SELECT rid, host, {_KEY_SQL} AS key FROM x
), big AS (
  SELECT host, key FROM k WHERE length(key) >= 10 GROUP BY host, key HAVING count(DISTINCT rid) > 10
), rem AS (
  SELECT k.rid, sum(len(regexp_extract_all(k.key, '[^\x20\x09-\x0D]+')))::BIGINT AS n FROM k JOIN big USING (host, key) GROUP BY k.rid
), r AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda s: length(s))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(nl.n, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN nl USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN rem USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words FROM f
"""

OP8_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, {_KEY_SQL} AS key FROM l),
dup AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT k.doc_id, k.pos, k.line, dup.key IS NOT NULL AND k.doc_id <> dup.keeper AS dropped FROM k LEFT JOIN dup ON k.key = dup.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP9_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""

ORACLE_SQL: dict[str, str] = {"op2_mix_sources": OP2_SQL, "op6_quality_rules": OP6_SQL, "op8_line_dedup": OP8_SQL, "op9_warc": OP9_SQL}
