"""Registered queries of the training-data operators: the contract's columns from the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, decontaminate, filter_audit, jaccard_join, license_scan, ngram_lm, quality_mil, quality_rules, secret_scan, token_alignment, token_counts, url_filter, warc
from .common import documents

MAX_TOKENS = 1024
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = quality_rules.apply(documents(spark, sf_dir)).withColumn("base_failed", failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("accepted")).alias("kept"), F.round("quality", 6).alias("quality"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.apply(documents(spark, sf_dir), vocabulary_path()).withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    found = secret_scan.apply(documents(spark, sf_dir), rules)
    counts = [F.size(F.array_remove(F.transform("spans", lambda s: (s["kind"] == kind).cast("int")), 0)).cast("long").alias(f"n_{r.kind}") for kind, r in enumerate(secret_scan.BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(F.col("spans"), rules, len(secret_scan.BASE_RULES)), 256).alias("base_sha256"), secret_scan.joined(F.col("spans"), rules).alias("spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.apply(documents(spark, sf_dir)).withColumn("base", F.filter("spans", lambda s: s["exact"]))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform("base", lambda s: s["first_word"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("spans").alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.apply(documents(spark, sf_dir))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.apply(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    coded = bpe_codec.round_trip(documents(spark, sf_dir).select("doc_id", "text"), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    model = quality_mil.fit(docs.where(~F.col("held_out")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_mil.score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.apply(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))
    return ngram_lm.apply(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.apply(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.apply(documents(spark, sf_dir), vocabulary_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.apply(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_secret_scan, op4_license_scan, op5_jaccard_join, op6_url_filter, op7_bpe_codec, op8_quality_mil, op9_decontamination, op10_ngram_lm, op11_filter_audit, op12_token_alignment, op13_warc)}


_ORDERS = "l(f, k) AS (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)), o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5)"
_AUDIT = f"""WITH {_ORDERS}, t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
b AS (SELECT doc_id, part, CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(first < doc_id, first IS NOT NULL) AS INT) AS bits FROM w),
m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, bits, count(*) AS n, count(*) FILTER (WHERE good) AS ng, count(*) FILTER (WHERE m.toxic) AS nt FROM b LEFT JOIN m USING (doc_id) GROUP BY part, bits),
s AS (SELECT filter_order, step, ks[step] AS k, list_reduce(list_concat([0], list_transform(ks[1:step - 1], lambda x: 1 << x)), lambda x, y: x + y) AS prior FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, k, sum(n) FILTER (WHERE bits & (prior | (1 << k)) = 0) AS kept, sum(n) FILTER (WHERE bits & prior = 0 AND (bits >> k) & 1 = 1) AS removed, sum(n) FILTER (WHERE bits & prior <> 0 AND (bits >> k) & 1 = 1) AS redundant,
  sum(n) FILTER (WHERE bits = 1 << k) AS unique_fails, sum(ng) FILTER (WHERE bits & prior = 0 AND (bits >> k) & 1 = 1) AS good_lost, sum(nt) FILTER (WHERE bits & prior = 0 AND (bits >> k) & 1 = 1) AS toxic_lost FROM g, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, """ + ", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) + """,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, k), 0) AS BIGINT) AS shapley FROM r"""

_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM g"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": _AUDIT, "op13_warc": _WARC}
