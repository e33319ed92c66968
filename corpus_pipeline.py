"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame. All but the last
return the columns of `docs`; the last adds `epoch`. Rows without a doc_id are only removed by language, exact copies and
benchmark leaks; rows that share a doc_id count as one document for near copies and for the mixture.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm.copies import exact_duplicates
from driftwatch.llm.decontaminate import clean
from driftwatch.llm.language import accepted, fit
from driftwatch.llm.minhash import near_duplicates
from driftwatch.llm.queries import mix
from driftwatch.storage import stage

DIGEST = "__text_sha256"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not recognised: null texts and texts without a letter."""
    return accepted(docs, fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, keep the one with the smallest doc_id, and one row of it."""
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    named = docs.withColumn(DIGEST, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(DIGEST) == F.col("__sha"))
    return named.join(kept, same, "left_semi").dropDuplicates(["doc_id", DIGEST]).drop(DIGEST)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, similarity of 0.8 or more), keep the one with the smallest doc_id."""
    gone = near_duplicates(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__id"))
    return docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken for the target weights, with its epoch."""
    taken = mix(docs).select(F.col("doc_id").alias("__id"), "epoch").distinct()
    return docs.drop("epoch").join(taken, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id")


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies),
          ("decontaminate", decontaminate), ("mixture", mixture)]

# language identification and BM25 have no SQL form; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
