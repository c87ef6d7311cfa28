"""Readers with declared schemas: JSON lines, prompts, threads, Markdown folders, manifests, answer sheets, snapshots.

Lines are split at \\n and \\r only, so that rows with other line separators inside a string are kept whole. Positions come
from the file's name and the place in it, never from ids that change with partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strandmill.functions import text as t

REQUEST_RECORD = T.StructType(
    [T.StructField(n, k) for n, k in (
        ("request_id", T.StringType()), ("start_ts", T.DoubleType()), ("end_ts", T.DoubleType()), ("latency_ms", T.DoubleType()), ("error", T.StringType()), ("input_tokens", T.IntegerType()), ("output_tokens", T.IntegerType()), ("scenario", T.StringType()), ("server", T.StringType()), ("concurrency_level", T.IntegerType()),
        ("ttfb_ms", T.DoubleType()), ("first_token_gap_ms", T.DoubleType()), ("mean_token_interval_ms", T.DoubleType()), ("token_interval_p95_ms", T.DoubleType()), ("dns_ms", T.DoubleType()), ("connect_ms", T.DoubleType()), ("tls_ms", T.DoubleType()), ("wait_ms", T.DoubleType()), ("output_tokens_approx", T.BooleanType()), ("retries", T.IntegerType()), ("error_category", T.StringType()),
    )]
)
THREAD = "id string, text string, timestamp bigint, username string, like_count int, replies_count int, repost_count int, permalink string, replies array<struct<id string, text string, timestamp bigint, username string, like_count int>>"
MANIFEST = "source_page string, file_url string, label string, file_type string, school string, subject string, grade string, term string"


def request_records(spark: SparkSession, path: str) -> DataFrame:
    """K01's counterpart: older files have the first ten fields only, the rest is null."""
    return spark.read.schema(REQUEST_RECORD).option("recursiveFileLookup", "true").json(path)


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """Role, content; blank lines are skipped, a line that is no JSON object is a user's prompt."""
    lines = spark.read.text(path).filter(t.strip(F.col("value")) != "")
    row = F.from_json("value", "role string, content string")
    is_object = F.startswith(F.ltrim("value"), F.lit("{")) & (row["role"].isNotNull() | row["content"].isNotNull())
    return lines.select(F.when(is_object, F.coalesce(row["role"], F.lit("user"))).otherwise(F.lit("user")).alias("role"), F.when(is_object, row["content"]).otherwise(t.strip(F.col("value"))).alias("content"))


def challenge_rows(spark: SparkSession, path: str) -> DataFrame:
    """Text (else content), title (else the text's first 60 characters); broken lines and empty texts are dropped."""
    r = F.from_json("value", "text string, content string, title string, source_category string, keyword string, month string")
    own = spark.read.text(path).select(r.alias("r")).select("r.*").withColumn("text", F.coalesce(F.nullif(t.strip(F.col("text")), F.lit("")), t.strip(F.col("content"))))
    return own.filter(F.coalesce("text", F.lit("")) != "").select("text", F.coalesce(F.nullif("title", F.lit("")), F.substring("text", 1, 60)).alias("title"), "source_category", "keyword", "month")


def threads(spark: SparkSession, path: str, min_likes: int = 0, min_replies: int = 0, min_length: int = 1, contains: str | None = None, dates: tuple[str, str] | None = None) -> DataFrame:
    """Posts with their replies, filtered, first post of each id (a missing id is one id); file and place give the order.

    A post without a time passes the date filter; replies by the post's own author and empty ones are left out.
    """
    raw = spark.read.option("multiLine", "true").schema(THREAD).json(path).withColumn("file", F.input_file_name())
    # The pair (file, line of the array) is the only order that survives a shuffle.
    posts = raw.select("file", F.monotonically_increasing_id().alias("place"), *[c for c in raw.columns if c != "file"])
    day = F.date_format(F.timestamp_seconds("timestamp"), "yyyyMMdd")
    known = F.when(F.coalesce("timestamp", F.lit(0)) > 0, day)
    keep = (F.coalesce("like_count", F.lit(0)) >= min_likes) & (F.coalesce("replies_count", F.lit(0)) >= min_replies) & (F.length("text") >= min_length) & ~t.is_emoji_only(F.col("text"))
    if contains:
        keep = keep & F.contains(F.lower("text"), F.lit(contains.lower()))
    if dates:
        keep = keep & (known.isNull() | known.between(*dates))
    own = F.filter("replies", lambda r: (F.coalesce(r["username"], F.lit("")) != F.coalesce(F.col("username"), F.lit(""))) & (F.coalesce(t.strip(r["text"]), F.lit("")) != ""))
    rows = posts.filter(F.coalesce(keep, F.lit(False))).select("file", "place", F.coalesce("id", F.lit("")).alias("id"), "text", known.alias("date"), F.transform(F.coalesce(own, F.array().cast("array<struct<id:string,text:string,timestamp:bigint,username:string,like_count:int>>")), lambda r: r["text"]).alias("replies"))
    first = rows.groupBy("id").agg(F.min_by(F.struct("text", "date", "replies"), F.struct("file", "place")).alias("p"))
    return first.select("id", t.first_line_title(F.col("p.text")).alias("title"), "p.date", t.thread_text(F.col("p.text"), F.col("p.replies")).alias("content"))


def markdown_folder(spark: SparkSession, path: str, categories: tuple[str, ...] = (), min_length: int = 50) -> DataFrame:
    """Category (folder), title (file name), content of Markdown files; short ones are left out."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = raw.select(F.element_at(parts, -2).alias("category"), F.regexp_replace(F.element_at(parts, -1), r"\.md$", "").alias("title"), t.strip_markdown(F.col("value")).alias("content"))
    rows = rows.filter(F.length("content") >= min_length)
    return rows.filter(F.col("category").isin(*categories)) if categories else rows


def extracts(spark: SparkSession, path: str, category: str, min_length: int = 100, max_length: int = 3000) -> DataFrame:
    """Encyclopedia extracts saved as JSON lines (title, extract)."""
    rows = spark.read.schema("title string, extract string").json(path)
    return rows.filter(F.length(F.trim("extract")) >= min_length).select("title", F.substring(F.trim("extract"), 1, max_length).alias("content"), F.lit(category).alias("source_category"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """PDF entries of a CSV or JSON manifest, a byte order mark taken away."""
    if path.endswith(".json"):
        rows = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    else:
        rows = spark.read.option("header", "true").schema(MANIFEST).option("enforceSchema", "true").csv(path)
    return rows.filter(F.lower("file_type") == "pdf")


def answer_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Number, statement, answer of a CSV; rows without a statement and an answer are skipped."""
    raw = spark.read.option("header", "true").csv(path)
    a, b, c = (F.col(f"`{raw.columns[i]}`") for i in range(3))
    return raw.select(F.floor(a.try_cast("double")).cast("int").alias("number"), t.strip(b).alias("statement"), t.strip(c).alias("answer")).filter((F.coalesce("statement", F.lit("")) != "") | (F.coalesce("answer", F.lit("")) != ""))


def search_payload(payload: Column, field: str = "results") -> Column:
    """Array of documents of a search answer: plain JSON, or the last 'data:' line of an event stream."""
    data = F.coalesce(F.element_at(F.regexp_extract_all(payload, F.lit(r"(?m)^data:\s*(.*)$"), F.lit(1)), -1), payload) if field else payload
    last = F.when(F.contains(payload, F.lit("data:")), data).otherwise(payload)
    docs = F.get(F.array(F.from_json(last, f"{field} array<struct<title:string,content:string,categories:array<string>>>")[field]), F.lit(0))
    return F.filter(docs, lambda d: (F.coalesce(d["title"], F.lit("")) != "") | (F.coalesce(d["content"], F.lit("")) != ""))


def unnested_summary(summaries: DataFrame, column: str = "summary") -> DataFrame:
    """Scenario, server, level, metrics of nested summaries (JSON); a missing throughput is 0, a missing percentile null."""
    metrics = "map<string,string>"
    tree = F.from_json(column, f"scenarios map<string,map<string,struct<concurrency_buckets:map<string,{metrics}>>>>")
    rows = summaries.select(F.explode(tree["scenarios"]).alias("scenario", "servers")).select("scenario", F.explode("servers").alias("server", "stats")).select("scenario", "server", F.explode("stats.concurrency_buckets").alias("level", "m")).filter(F.size("m") > 0)
    number = lambda k: F.element_at("m", k).try_cast("double")
    return rows.select("scenario", "server", F.col("level").cast("int").alias("level"), F.coalesce(number("tokens_per_sec_output"), F.lit(0.0)).alias("tokens_per_sec_output"), F.coalesce(number("requests_per_sec"), F.lit(0.0)).alias("requests_per_sec"), number("p50_ms").alias("p50_ms"), number("p95_ms").alias("p95_ms"))
