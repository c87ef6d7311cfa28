"""Metrics of load-test requests: counts, nearest-rank percentiles, throughput, errors, for (scenario, server) overall and by concurrency level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandmill.operators.order_statistics import order_statistics

KEYS = ("scenario", "server")
SPAN = 1e-9


def both_groupings(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """One row for each (scenario, server, level) and one, with a null level, for each (scenario, server); one scan, combined before the shuffle."""
    grouped = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("per_level")).withColumn("level", F.when(F.col("per_level"), F.col("concurrency_level")))
    return grouped.groupBy(*KEYS, "per_level", "level").agg(*aggregates)


def latency_state(rows: DataFrame, measure: str) -> DataFrame:
    """State of a measure of the rows without an error, with the level as period."""
    value = F.col(measure).cast("double")
    ok = rows.filter(F.col("error").isNull() & value.isNotNull() & ~F.isnan(value))
    return ok.groupBy(F.lit(measure).alias("measure"), F.col("scenario").alias("k0"), F.col("server").alias("k1"), F.col("concurrency_level").alias("period"), value.alias("value")).agg(F.count("*").alias("n"))


def request_metrics(rows: DataFrame, measure: str = "latency_ms", quantiles: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """scenario, server, level, count, error_count, failed_count, avg, p.., token sums and throughputs.

    Percentiles are nearest-rank (position min(int(n * q), n - 1) from 0) over rows whose error is null; exhausted
    requests, whose error is null but which have an error category, count as ordinary ones, and failed_count tells how
    many they are. An empty error string is no error in error_count, but keeps its row out of the latencies. The wall
    span is at least 1e-9 s. A group without any latency has no row. Null tokens are 0.
    """
    ok = F.col("error").isNull()
    span = F.greatest(F.max("end_ts") - F.min("start_ts"), F.lit(SPAN))
    tokens = lambda c: F.coalesce(F.sum(F.when(ok, F.coalesce(F.col(c), F.lit(0)))), F.lit(0)).cast("long")
    sums = both_groupings(
        rows,
        F.count("*").alias("n_all"),
        F.count_if(ok & F.col(measure).isNotNull()).alias("count"),
        F.count_if(F.col("error") != "").alias("error_count"),
        F.count_if(F.coalesce(F.col("error_category"), F.lit("")) != "").alias("failed_count"),
        F.avg(F.when(ok, F.col(measure))).alias("avg_ms"),
        tokens("input_tokens").alias("total_input_tokens"),
        tokens("output_tokens").alias("total_output_tokens"),
        span.alias("span"),
    )
    found = order_statistics(latency_state(rows, measure), [("nearest", q) for q in quantiles], expected_rows=rows.count())
    ranks = found.select(F.col("k0").alias("scenario"), F.col("k1").alias("server"), F.col("per_period").alias("per_level"), F.col("period").alias("level"), *[F.col("values")[i].alias(f"p{round(q * 100)}_ms") for i, q in enumerate(quantiles)])
    on = [sums[k].eqNullSafe(ranks[k]) for k in (*KEYS, "level", "per_level")]
    joined = sums.join(ranks, on).select(*[sums[c] for c in sums.columns if c != "per_level"], *[ranks[f"p{round(q * 100)}_ms"] for q in quantiles])
    per_second = lambda c: F.round(F.col(c) / F.col("span"), 6)
    return joined.filter("count > 0").select(
        *KEYS, "level", "count", "error_count", "failed_count", F.round("avg_ms", 6).alias("avg_ms"), *[f"p{round(q * 100)}_ms" for q in quantiles],
        "total_input_tokens", "total_output_tokens", (F.col("total_input_tokens") + F.col("total_output_tokens")).alias("total_tokens"),
        per_second("total_output_tokens").alias("tokens_per_sec_output"), per_second("total_input_tokens").alias("tokens_per_sec_input"),
        F.round((F.col("total_input_tokens") + F.col("total_output_tokens")) / F.col("span"), 6).alias("tokens_per_sec_total"), per_second("n_all").alias("requests_per_sec"),
        F.round(F.col("error_count") / F.col("n_all"), 6).alias("error_rate"),
    )


def timing_percentiles(rows: DataFrame, measure: str, quantiles: tuple[float, ...], average: bool = False) -> DataFrame:
    """scenario, server, level, n, p.. (and avg): nearest-rank percentiles of another timing; groups without values have no row. Averages come from decimal sums, so they don't depend on the order of rows."""
    state = latency_state(rows, measure)
    found = order_statistics(state, [("nearest", q) for q in quantiles], expected_rows=rows.count())
    columns = [F.col("k0").alias("scenario"), F.col("k1").alias("server"), F.col("period").alias("level"), F.col("total").alias("n"), *[F.col("values")[i].alias(f"p{round(q * 100)}") for i, q in enumerate(quantiles)]]
    if not average:
        return found.select(*columns)
    ok = F.col("error").isNull() & F.col(measure).isNotNull() & ~F.isnan(F.col(measure).cast("double"))
    means = both_groupings(rows.filter(ok), (F.sum(F.col(measure).cast("decimal(28,9)")).cast("double") / F.count("*")).alias("avg")).select(*[F.col(c).alias(f"m_{c}") for c in (*KEYS, "per_level", "level")], "avg")
    on = found["k0"].eqNullSafe(means["m_scenario"]) & found["k1"].eqNullSafe(means["m_server"]) & found["period"].eqNullSafe(means["m_level"]) & (found["per_period"] == means["m_per_level"])
    return found.join(means, on).select(*columns, "avg")


def token_and_retry_ratios(rows: DataFrame) -> DataFrame:
    """scenario, server, level, approx_ratio (of rows with output tokens; null without any), retries_total, retry_rate."""
    counted = F.when(F.col("output_tokens").isNotNull(), F.coalesce(F.col("output_tokens_approx"), F.lit(False)).cast("double"))
    retries = F.sum(F.coalesce("retries", F.lit(0)))
    return both_groupings(rows, F.round(F.avg(counted), 6).alias("approx_ratio"), retries.alias("retries_total"), F.round(retries / F.count("*"), 6).alias("retry_rate")).drop("per_level")


def error_category_counts(rows: DataFrame) -> DataFrame:
    """scenario, server, level, error_category, n; a map of a group's categories has an entry a row."""
    own = rows.filter(F.coalesce(F.col("error_category"), F.lit("")) != "")
    return own.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("per_level")).groupBy(*KEYS, "per_level", F.when(F.col("per_level"), F.col("concurrency_level")).alias("level"), "error_category").agg(F.count("*").alias("n")).drop("per_level")


def interval_p95(times: Column) -> Column:
    """The 95th percentile of the gaps of an array of chunk times, by the rule ceil(0.95 n) - 1; null for fewer than two chunks."""
    gaps = F.transform(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), lambda t, i: t - F.get(times, i))
    at = F.floor((F.size(gaps) * 95 + 99) / 100).cast("int") - 1
    return F.when(F.size(times) > 1, F.get(F.array_sort(gaps), F.greatest(at, F.lit(0))))


def cadence(times: Column) -> Column:
    """Struct (first_gap, mean_interval) of an array of chunk times; nulls for fewer than two chunks."""
    n = F.size(times)
    return F.struct(F.when(n > 1, F.get(times, F.lit(1)) - F.get(times, F.lit(0))).alias("first_gap"), F.when(n > 1, (F.get(times, n - 1) - F.get(times, F.lit(0))) / (n - 1)).alias("mean_interval"))
