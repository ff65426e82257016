"""A corpus pipeline over documents: each stage works on all that the one before kept.

In every stage repeated rows stay repeated, an empty table gives an empty table, null sources and languages are values of their own,
and columns beyond those of documents are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrecon.llm import bpe, copies, langid, mixing, pii
from gridrecon.llm.common import new_path
from gridrecon.llm.queries import EPOCHS, PII_KEY, RANKS, SEED, WEIGHTS, domain

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the tokens at hand that the mix asks for.
FRACTION = 0.8
#: Most bytes of a batch that Spark hands to a Python worker (one row at least): long texts fill batches by bytes, not by their number.
BATCH = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Batches to Python workers of at most BATCH bytes in this session, unless it asks for smaller ones; rows and results stay the same."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH:
        spark.conf.set(name, f"{BATCH}b")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter in their text (und; null and empty ones too) go; lang becomes the predicted language.

    Ties between languages go to the first by name; where no row has a language nothing is learned and all go.
    """
    bounded(spark)
    learned = langid.sample(docs, F.lit(True))
    out = langid.identify(docs.select(*COLUMNS), learned).where("lang_pred <> 'und'")
    return out.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of their five-word shingles in common) the document with the smallest id stays.

    Wordless texts are copies of each other. Rows that repeat the smallest id all stay; rows with a null id take no part and stay.
    """
    bounded(spark)
    return copies.one_of_each(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates; n_chars follows the new text (null for a null one)."""
    bounded(spark)
    return pii.replace(docs.select(*COLUMNS), PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the budgets of its domain, language and source take it.

    Rows that repeat an id (or have none) are each taken as often as the most often taken of them.
    """
    bounded(spark)
    docs = docs.select(*COLUMNS)
    taken = mixing.select(docs, domain(), FRACTION, EPOCHS, SEED, WEIGHTS)
    taken = taken.groupBy("doc_id").agg(F.max("copies").alias("copies"))
    out = docs.alias("d").join(taken.alias("t"), F.expr("d.doc_id <=> t.doc_id")).select("d.*", "copies")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix; a null text has none."""
    bounded(spark)
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.read_ranks(spark, RANKS))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("PII", personal_data), ("mixing", mix), ("byte-level BPE", tokens)]

#: Cross-parsing and SimHash have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
