"""Metrics of request records."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.operators import metrics as m
from strandmill.plans.registry import Registry
from strandmill.session import table

METRICS = Registry()

_BOTH = "both_levels AS (SELECT *, CAST(NULL AS INT) AS level FROM request_records UNION ALL SELECT *, concurrency_level FROM request_records)"


def _ranked(c: str) -> str:
    return f"SELECT scenario, server, level, {c} AS v, row_number() OVER w - 1 AS pos0, count(*) OVER (PARTITION BY scenario, server, level) AS n FROM both_levels WHERE error IS NULL AND {c} IS NOT NULL WINDOW w AS (PARTITION BY scenario, server, level ORDER BY {c})"


def _pct(q: int) -> str:
    return f"max(v) FILTER (WHERE pos0 = least(n * {q} // 100, n - 1))"


@METRICS.add("A01_request_metrics", f"""WITH {_BOTH}, ranked AS ({_ranked('latency_ms')}),
ranks AS (SELECT scenario, server, level, {_pct(50)} AS p50_ms, {_pct(90)} AS p90_ms, {_pct(95)} AS p95_ms, {_pct(99)} AS p99_ms FROM ranked GROUP BY ALL),
sums AS (SELECT scenario, server, level, count(*) AS n_all, count(latency_ms) FILTER (WHERE error IS NULL) AS count, count(*) FILTER (WHERE error <> '') AS error_count, count(*) FILTER (WHERE error_category <> '') AS failed_count, avg(latency_ms) FILTER (WHERE error IS NULL) AS a,
  coalesce(sum(input_tokens) FILTER (WHERE error IS NULL), 0)::BIGINT AS ti, coalesce(sum(output_tokens) FILTER (WHERE error IS NULL), 0)::BIGINT AS t, greatest(max(end_ts) - min(start_ts), 1e-9) AS span FROM both_levels GROUP BY ALL)
SELECT s.scenario, s.server, s.level, count, error_count, failed_count, round(a, 6) AS avg_ms, p50_ms, p90_ms, p95_ms, p99_ms, ti AS total_input_tokens, t AS total_output_tokens, ti + t AS total_tokens,
  round(t / span, 6) AS tokens_per_sec_output, round(ti / span, 6) AS tokens_per_sec_input, round((ti + t) / span, 6) AS tokens_per_sec_total, round(n_all / span, 6) AS requests_per_sec, round(error_count / n_all, 6) AS error_rate
FROM sums s JOIN ranks r ON s.scenario IS NOT DISTINCT FROM r.scenario AND s.server IS NOT DISTINCT FROM r.server AND s.level IS NOT DISTINCT FROM r.level""")
def a01(spark, folder):
    return m.request_metrics(table(spark, folder, "request_records"))


@METRICS.add("A05_ttfb_percentiles", f"WITH {_BOTH}, ranked AS ({_ranked('ttfb_ms')}) SELECT scenario, server, level, count(*) AS n, {_pct(50)} AS p50, {_pct(90)} AS p90, {_pct(95)} AS p95 FROM ranked GROUP BY ALL")
def a05(spark, folder):
    return m.timing_percentiles(table(spark, folder, "request_records"), "ttfb_ms", (0.5, 0.9, 0.95))


@METRICS.add("A05_wait_percentiles", f"WITH {_BOTH}, ranked AS ({_ranked('wait_ms')}) SELECT scenario, server, level, count(*) AS n, {_pct(50)} AS p50, {_pct(95)} AS p95, CAST(sum(CAST(v AS DECIMAL(28, 9))) AS DOUBLE) / count(*) AS avg FROM ranked GROUP BY ALL")
def a05_wait(spark, folder):
    return m.timing_percentiles(table(spark, folder, "request_records"), "wait_ms", (0.5, 0.95), average=True)


@METRICS.add("A06_A07_token_and_retry_ratios", f"WITH {_BOTH} SELECT scenario, server, level, round(avg(CAST(coalesce(output_tokens_approx, false) AS DOUBLE)) FILTER (WHERE output_tokens IS NOT NULL), 6) AS approx_ratio, CAST(sum(coalesce(retries, 0)) AS BIGINT) AS retries_total, round(sum(coalesce(retries, 0)) / count(*), 6) AS retry_rate FROM both_levels GROUP BY ALL")
def a06(spark, folder):
    return m.token_and_retry_ratios(table(spark, folder, "request_records"))


@METRICS.add("A07_error_categories", f"WITH {_BOTH} SELECT scenario, server, level, error_category, count(*) AS n FROM both_levels WHERE error_category <> '' GROUP BY ALL")
def a07(spark, folder):
    return m.error_category_counts(table(spark, folder, "request_records"))


@METRICS.add("A03_A04_stream_cadence", "WITH e AS (SELECT user_id, list(epoch_us(ts) / 1e6 ORDER BY ts, event_id) AS t FROM events GROUP BY 1), g AS (SELECT user_id, t, list_sort(list_transform(range(2, len(t) + 1), lambda i: t[i] - t[i - 1])) AS gaps FROM e WHERE len(t) > 1) SELECT user_id, round(t[2] - t[1], 3) AS first_gap, round((t[len(t)] - t[1]) / (len(t) - 1), 3) AS mean_interval, round(gaps[(len(gaps) * 95 + 99) // 100], 3) AS p95_gap FROM g")
def a03(spark, folder):
    events = table(spark, folder, "events").select("user_id", F.struct((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_id").alias("e"))
    times = events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["t"]).alias("t")).filter(F.size("t") > 1)
    c = m.cadence(F.col("t"))
    return times.select("user_id", F.round(c["first_gap"], 3).alias("first_gap"), F.round(c["mean_interval"], 3).alias("mean_interval"), F.round(m.interval_p95(F.col("t")), 3).alias("p95_gap"))


@METRICS.add("A36_latency_profile", "SELECT input_tokens // 100 AS size, count(*) AS n, round(avg(latency_ms), 6) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms FROM request_records WHERE input_tokens IS NOT NULL GROUP BY 1")
def a36(spark, folder):
    r = table(spark, folder, "request_records").filter("input_tokens is not null")
    return r.groupBy(F.floor(F.col("input_tokens") / 100).alias("size")).agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"))


@METRICS.add("M29_duration_tags", "SELECT CASE WHEN latency_ms > 1000 THEN 'slow' WHEN latency_ms > 300 THEN 'warn' ELSE 'ok' END AS tag, count(*) AS n FROM request_records GROUP BY 1")
def m29(spark, folder):
    tag = F.when(F.col("latency_ms") > 1000, "slow").when(F.col("latency_ms") > 300, "warn").otherwise("ok")
    return table(spark, folder, "request_records").groupBy(tag.alias("tag")).agg(F.count("*").alias("n"))


@METRICS.add("A20_hourly_requests", "SELECT server, strftime(make_timestamp(CAST(floor(start_ts) AS BIGINT) * 1000000), '%Y-%m-%d %H') AS hour, count(*) AS n, count(*) FILTER (WHERE error <> '') AS errors, min(start_ts) AS first_ts, max(start_ts) AS last_ts FROM request_records GROUP BY 1, 2")
def a20_requests(spark, folder):
    hour = F.date_format(F.timestamp_seconds(F.floor("start_ts")), "yyyy-MM-dd HH")
    return table(spark, folder, "request_records").groupBy("server", hour.alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("error") != "").alias("errors"), F.min("start_ts").alias("first_ts"), F.max("start_ts").alias("last_ts"))


@METRICS.add("S20_top_requests_per_day", "SELECT day, server, request_id, latency_ms FROM (SELECT strftime(make_timestamp(CAST(floor(start_ts) AS BIGINT) * 1000000), '%Y-%m-%d') AS day, server, request_id, latency_ms FROM (SELECT DISTINCT start_ts, server, request_id, latency_ms FROM request_records)) QUALIFY row_number() OVER (PARTITION BY day ORDER BY latency_ms DESC, request_id) <= 5")
def s20(spark, folder):
    """Top 5 of each day: partial top-k by slices first, so that a day isn't one task."""
    from strandmill.operators.topk import top_per_group

    r = table(spark, folder, "request_records").select("start_ts", "server", "request_id", "latency_ms").distinct()
    own = r.select(F.date_format(F.timestamp_seconds(F.floor("start_ts")), "yyyy-MM-dd").alias("day"), "server", "request_id", "latency_ms")
    return top_per_group(own, ["day"], [F.col("latency_ms").desc(), F.col("request_id")], 5, "request_id")
