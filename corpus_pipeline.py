"""A training corpus from raw documents: language, repeated lines, near-duplicates, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it wrote, and returns a DataFrame. All but the
last return the columns of documents; n_chars follows the text where a stage changes it.

Defined cases: null and empty texts have no letter and go in the first stage; long texts stay whole up to the last stage,
which cuts them into pieces; rows with a null id are documents of their own: no line of theirs goes, they are nobody's
near-duplicates, and they are mixed and packed; ids are whole at any size; rows repeated under one id are one document from
the third stage on, the longest text (of several, the first by code point) standing for it; ties go by id; an empty table
gives empty tables; extra columns pass through to the mix, whatever their names but for those that begin with __.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stepforge.llm import language_id, line_dedup, minhash_dedup, mixing, packing
from stepforge.llm.components import connected_components
from stepforge.llm.queries import tokenizer_path
from stepforge.llm.storage import bounded_broadcast, materialize, new_path

#: A document's best language has to reach this share of the way from an even guess (1 / languages) to certainty.
LEAST_SHARE = 0.1


def least_score(languages: int) -> float:
    """The bound on the pooled score; a single language is always certain, its bound a little less for rounding."""
    return 1 / languages + LEAST_SHARE * (1 - 1 / languages) - 1e-6


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents whose language can't be told go: those without a letter, and those whose best pooled score is
    under least_score. The others stay whatever their lang says; without a model all documents with a letter do."""
    model = language_id.train(docs)
    if model is None:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    done = language_id.predict(docs, model, docs.columns)
    return done.where((F.col("__pred") != language_id.UNDETERMINED) & (F.col("__score") >= least_score(len(model.languages)))).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: lines that an earlier document holds go from the later ones; every document keeps its row."""
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 with its two-word shingles and similarity 0.8: of each group of near-duplicates the smallest id stays, in one
    row. The stage before took from a near copy the lines that it shares, so what is alike is only seen in the documents
    as they were; both texts of a document are compared, the one it came with and the one it has. Documents without a
    word left go: all they held stays elsewhere."""
    came = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id is not null")
    # the few that went before are left out by id: the texts, which are read several times, are not shuffled for it
    before = materialize(came.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti").distinct(), "before")
    came = came.join(bounded_broadcast(before, before.count()), "doc_id", "left_anti")
    links = [minhash_dedup.near_duplicates(d, n=2, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")) for d in (came, docs)]
    alike = materialize(connected_components(links[0].union(links[1]).distinct()), "alike")
    gone = materialize(alike.where("node <> component").select(F.col("node").alias("doc_id")), "gone")
    left = docs.where(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).join(bounded_broadcast(gone, gone.count()), "doc_id", "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "text"))
        left = left.where("doc_id is not null").withColumn("__nth", first).where("__nth = 1").drop("__nth").unionByName(left.where("doc_id is null"))
    return left.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: each source comes to its target words; documents repeat by epochs, the last one is cut at the budget."""
    mixed = mixing.realize(mixing.mix(docs), docs.columns)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces of the documents' token ids with their place in sequences of 2048."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language identification is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
