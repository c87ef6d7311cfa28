"""Queries of this subpackage, pN_... for problem N of the test tables' description."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandmill.llm import garbled, lookalikes, mixture, neardup, pairs, percentiles as pct, pii
from strandmill.llm.tokenize import Tokenizer
from strandmill.plans.registry import Registry
from strandmill.session import table

LLM = Registry()


@lru_cache(1)
def _tokenizer(application: str) -> Tokenizer:
    return Tokenizer()


def tokenizer(spark: SparkSession) -> Tokenizer:
    """byte_bpe_50k, read once a session."""
    return _tokenizer(spark.sparkContext.applicationId)


_P3_SQL = """
WITH once AS (
  SELECT DISTINCT request_id, server, concurrency_level, start_ts, latency_ms, ttfb_ms FROM request_records
), long AS (
  SELECT 'latency_ms' AS measure, server, concurrency_level, strftime(make_timestamp(CAST(floor(start_ts) AS BIGINT) * 1000000), '%Y-%m-%d') AS day, latency_ms AS v FROM once WHERE latency_ms IS NOT NULL
  UNION ALL
  SELECT 'ttfb_ms', server, concurrency_level, strftime(make_timestamp(CAST(floor(start_ts) AS BIGINT) * 1000000), '%Y-%m-%d'), ttfb_ms FROM once WHERE ttfb_ms IS NOT NULL
), spread AS (
  SELECT measure, server, concurrency_level, day, v FROM long UNION ALL SELECT measure, server, concurrency_level, 'all', v FROM long
)
SELECT measure, server, concurrency_level, day, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, CAST(0 AS DOUBLE) AS error_bound
FROM spread GROUP BY ALL
"""


@LLM.add("p3_percentiles", _P3_SQL)
def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    found = pct.percentiles(table(spark, folder, "request_records"), ["server", "concurrency_level"], ["latency_ms", "ttfb_ms"], "request_id", "start_ts")
    day = F.when(F.col("per_period"), F.date_format(F.date_from_unix_date("period"), "yyyy-MM-dd")).otherwise(F.lit("all"))
    return found.select("measure", F.col("k0").alias("server"), F.col("k1").alias("concurrency_level"), day.alias("day"), "n", *[F.round(F.col("quantiles")[i], 6).alias(f"p{round(q * 100)}") for i, q in enumerate(pct.QUANTILES)], "error_bound")


def bank_texts(spark: SparkSession, folder: str) -> DataFrame:
    """field, id, text of the three fields in which near-duplicates are looked for."""
    articles, items = table(spark, folder, "tds_articles"), table(spark, folder, "benchmark_items")
    return (
        articles.select(F.lit("tds_articles.content").alias("field"), F.col("article_id").alias("id"), F.col("content").alias("text"))
        .unionByName(items.select(F.lit("benchmark_items.content").alias("field"), "id", F.col("content").alias("text")))
        .unionByName(items.select(F.lit("benchmark_items.prompt").alias("field"), "id", F.col("prompt").alias("text")))
    )


@LLM.add("p2_found")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    keyed = neardup.keyed_texts(bank_texts(spark, folder))
    return neardup.expand_pairs(keyed, neardup.similar_classes(keyed)).withColumnRenamed("field", "field_name")


@LLM.add("p2_groups")
def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    keyed = neardup.keyed_texts(bank_texts(spark, folder))
    return neardup.groups(keyed, neardup.similar_classes(keyed)).withColumnRenamed("field", "field_name")


@LLM.add("p7_ids")
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer(spark).encode(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


@LLM.add("p7_roundtrip")
def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text is, and is not, given back by decoding their ids."""
    encoded = tokenizer(spark).encode(table(spark, folder, "documents").select("text"), "text")
    same = tokenizer(spark).decode(F.col("ids")) == F.coalesce("text", F.lit(""))
    return encoded.groupBy(same.alias("same")).agg(F.count("*").alias("n_documents"), F.sum(F.size("ids")).alias("n_tokens"))


def _mixture(spark: SparkSession, folder: str):
    documents = tokenizer(spark).encode(table(spark, folder, "documents").select("doc_id", "source", "text"), "text")
    sized = documents.select("doc_id", "source", F.size("ids").alias("n_tokens"), mixture.quality_weight(F.col("text")).alias("weight"))
    return mixture.mix(sized, table(spark, folder, "source_targets"))


@LLM.add("p8_mixture")
def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the mixture and how often each is used."""
    return _mixture(spark, folder)[0]


@LLM.add("p8_shares")
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares, repeats and sizes of each source."""
    return mixture.mixture_report(*_mixture(spark, folder))


@LLM.add("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.find_garbled(table(spark, folder, "documents"), "doc_id").select("doc_id").distinct()


@LLM.add("p9_restored")
def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled documents, the mappings that were undone and the original text where nothing was lost."""
    return garbled.find_garbled(table(spark, folder, "documents"), "doc_id")


def _look_alike_tables(spark: SparkSession, folder: str):
    return (
        ("documents", table(spark, folder, "documents"), "doc_id", "text"),
        ("ptt_articles", table(spark, folder, "ptt_articles"), "article_id", "content"),
        ("tds_articles", table(spark, folder, "tds_articles"), "article_id", "content"),
    )


def _disguised(spark: SparkSession, folder: str) -> DataFrame:
    """table_name, record_id, kinds, form of disguised records; documents that are garbled aren't among them."""
    out = None
    for name, rows, key, text in _look_alike_tables(spark, folder):
        if name == "documents":
            stats = garbled.pair_statistics(rows)
            wrong = garbled.find_garbled(rows.filter(F.col("text").rlike(lookalikes.CANDIDATE)), key, text, stats).select(key).distinct()
            rows = rows.join(wrong, key, "left_anti")
        found = lookalikes.find_disguised(rows, key, text).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("record_id"), "kinds", "form")
        out = found if out is None else out.unionByName(found)
    return out


@LLM.add("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with disguised characters."""
    return _disguised(spark, folder).select("table_name", "record_id").distinct()


@LLM.add("p4_forms")
def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every disguised record."""
    return _disguised(spark, folder)


@LLM.add("p4_groups")
def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Records that look the same and are written in different ways, of all three tables."""
    all_rows = None
    for name, rows, key, text in _look_alike_tables(spark, folder):
        own = rows.select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("key"), F.col(text).alias("text"))
        all_rows = own if all_rows is None else all_rows.unionByName(own)
    return lookalikes.look_alike_groups(all_rows, "key", "text")


@LLM.add("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pairs.find_broken_pairs(table(spark, folder, "llm_responses"), table(spark, folder, "benchmark_items"))
    return found.select("response_id", "defect_type").distinct()


@LLM.add("p1_defects")
def p1_defects(spark: SparkSession, folder: str) -> DataFrame:
    """Every defect of every broken pair."""
    found = pairs.find_broken_pairs(table(spark, folder, "llm_responses"), table(spark, folder, "benchmark_items"))
    return found.select("response_id", F.explode("defects").alias("defect_type")).distinct()


def _pii_tables(spark: SparkSession, folder: str):
    """The tables, and one model with the words of all their texts."""
    tables = (
        ("documents", table(spark, folder, "documents"), "doc_id", "text"),
        ("ptt_articles", table(spark, folder, "ptt_articles"), "article_id", "content"),
        ("ptt_pushes", table(spark, folder, "ptt_pushes"), "push_id", "content"),
    )
    model = pii.model_for([rows.select(F.col(text).alias("text")) for _, rows, _, text in tables])
    return [(*t, model) for t in tables]


@LLM.add("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name, rows, key, text, model in _pii_tables(spark, folder):
        found = pii.find_kinds(rows, key, text, model).select(F.lit(name).alias("table_name"), "record_id", "pii_kind")
        out = found if out is None else out.unionByName(found)
    return out


@LLM.add("p6_redacted")
def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every record with placeholders, and the kinds that were replaced."""
    out = None
    for name, rows, key, text, model in _pii_tables(spark, folder):
        found = pii.redact(rows, key, text, model).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("record_id"), "redacted", "kinds")
        out = found if out is None else out.unionByName(found)
    return out
