"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` (more columns
are dropped) and returns a DataFrame; :func:`run` writes each stage's result as Parquet into
the cluster's shared folder and reads it back as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_codec, decontaminate, jaccard_join, quality_mil, secret_scan
from tidemark.llm.common import documents, materialize
from tidemark.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose probability of good quality is lower go.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Attention-based multiple-instance classifier, learned from the labels of these documents; those it rejects go."""
    model = quality_mil.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_mil.score(docs.select(*COLUMNS), model).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join one row stays: the one with the least doc_id (nulls last), then the least digest of the row.

    Rows are told apart by all their columns, so rows that share a doc_id or have none go
    only if their texts are linked; rows without shingles have no links and stay.
    """
    no_id = F.lit("0").cast(docs.schema["doc_id"].dataType)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", no_id).alias("doc_id"), F.md5(F.to_json(F.struct(*COLUMNS))).alias("digest"))
    named = docs.select(row.alias("row"), *COLUMNS)
    joined = jaccard_join.apply(named, doc_id="row")
    kept = joined.where("doc_id = component_id").groupBy(F.col("doc_id").alias("row")).agg(F.max("n_shingles").alias("n"))
    left = named.join(kept, "row")
    first = left.where("n > 0").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("d"))
    return first.select("d.*").unionByName(left.where("n = 0").select(*COLUMNS))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.apply(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.where("n_hit = 0").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span is replaced by a mark; ``n_chars`` follows the new text."""
    found = secret_scan.apply(docs, keep=("lang", "source", "n_chars"))
    text = secret_scan.redact(F.col("text"), F.col("spans"))
    return found.select("doc_id", text.alias("text"), "lang", "source", "n_chars", F.size("spans").alias("n")).withColumn("n_chars", F.when(F.col("n") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by the backtracking encoder, as unsigned 32-bit integers in ``ids``; ``round_trip`` tells whether they decode to the text."""
    path = vocabulary_path()
    coded = bpe_codec.round_trip(docs.select(*COLUMNS), path)
    return coded.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", leaks), ("secret scans", secrets), ("BPE encoding and decoding", tokens)]

#: Several stages cannot be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{n}")
    return docs
