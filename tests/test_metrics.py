import pytest

from strandmill.operators.metrics import cadence, interval_p95, request_metrics, token_and_retry_ratios
from strandmill.operators.order_statistics import combine_states, order_statistics
from pyspark.sql import functions as F

SCHEMA = "request_id string, start_ts double, end_ts double, latency_ms double, error string, input_tokens int, output_tokens int, scenario string, server string, concurrency_level int, output_tokens_approx boolean, retries int, error_category string"


def record(i, latency, level=1, error=None, category=None, tokens=10, start=0.0, end=1.0, server="s"):
    return (f"r{i}", start, end, latency, error, tokens, tokens, "chat", server, level, False, 1, category)


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_nearest_rank_is_not_a_discrete_percentile(spark):
    found = request_metrics(rows(spark, [record(i, float(i)) for i in range(1, 21)])).filter("level is null").first()
    assert (found.p50_ms, found.p95_ms, found["count"]) == (11.0, 20.0, 20)


def test_failures_hide_in_the_latencies_and_show_in_failed_count(spark):
    found = request_metrics(rows(spark, [record(1, 5.0), record(2, 9.0, category="connection"), record(3, 7.0, error="boom"), record(4, 8.0, error="")])).filter("level is null").first()
    assert (found["count"], found.error_count, found.failed_count, found.error_rate, found.total_output_tokens) == (2, 1, 1, 0.25, 20)


def test_group_of_errors_only_has_no_row_and_span_is_clamped(spark):
    data = [record(1, 5.0, server="bad", error="x"), record(2, 5.0, start=3.0, end=3.0, server="good", tokens=None)]
    found = request_metrics(rows(spark, data)).collect()
    assert {r.server for r in found} == {"good"} and all(r.total_tokens == 0 and r.requests_per_sec == pytest.approx(1e9) for r in found)


def test_levels_add_up(spark):
    found = request_metrics(rows(spark, [record(i, float(i % 7), level=1 + i % 3) for i in range(50)])).collect()
    assert sum(r["count"] for r in found if r.level is not None) == sum(r["count"] for r in found if r.level is None) == 50


def test_empty_table(spark):
    assert request_metrics(rows(spark, [])).count() == 0 and token_and_retry_ratios(rows(spark, [])).count() == 0


def test_positions_over_many_partitions_and_combined_states(spark):
    data = spark.range(5000).select(F.lit("m").alias("measure"), (F.col("id") % 2).alias("k0"), (F.col("id") % 5).cast("int").alias("period"), F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") * 37 % 1009).cast("double")).alias("value"), F.lit(1).cast("long").alias("n"))
    state = combine_states([data.filter("period < 2"), data.filter("period >= 2")])
    found = {(r.k0, r.period): list(r["values"]) for r in order_statistics(state, [("low", 0.5), ("high", 0.9), ("nearest", 0.95), ("ceiling", 0.95)], rows_per_partition=100).collect()}
    raw = [(r.k0, r.period, r.value) for r in data.collect()]
    for (k, p), values in found.items():
        own = sorted(v for a, b, v in raw if a == k and p in (b, None))
        n = len(own)
        assert values == [own[(n - 1) // 2], own[-(-(n - 1) * 9 // 10)], own[min(n * 95 // 100, n - 1)], own[-(-95 * n // 100) - 1]]
    assert len(found) == 12


def test_chunk_times(spark):
    df = spark.createDataFrame([([0.0, 1.0, 3.0, 4.0],), ([5.0],), ([],)], "t array<double>")
    found = df.select(interval_p95(F.col("t")).alias("p"), cadence(F.col("t")).alias("c")).collect()
    assert [(r.p, r.c.first_gap) for r in found] == [(2.0, 1.0), (None, None), (None, None)]
