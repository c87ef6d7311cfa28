from pyspark.sql import functions as F

from strandmill.operators import bank as b, sampling, trend
from strandmill.operators.lineage import chain_roots
from strandmill.operators.skew import salted_join
from strandmill.operators.topk import top_per_group

RESULT = "id string, model_key string, reference_answer string, prompt string, score int, loaded_at int"


def results(spark, data):
    return spark.createDataFrame(data, RESULT)


S = '{"statement": "s1", "answer": "TRUE"}'


def test_three_difficulties_differ(spark):
    rows = results(spark, [("1", "m", S, "p", None, 1), ("2", "m", S, "p", 5, 2), ("3", None, S, "p", 5, 1), ("4", "n", None, "q\nlast", 4, 1), ("5", "n", "broken", " ", 4, 1)])
    found = {v: {r.statement: (r.correct, r.total, r.category) for r in b.difficulty(rows, v).collect()} for v in ("question_list", "export", "p_values")}
    assert found["question_list"] == {"s1": (1, 2, "ideal"), "last": (1, 1, "easy")}
    assert found["export"] == {"s1": (0, 1, "hard"), "last": (1, 1, "easy")}
    assert found["p_values"] == {"s1": (1, 1, "easy")}


def test_bounds_belong_to_ideal(spark):
    assert [r.c for r in spark.createDataFrame([(0.4,), (0.7,), (0.39,), (0.71,), (None,)], "p double").select(b.difficulty_class(F.col("p")).alias("c")).collect()] == ["ideal", "ideal", "hard", "easy", "unknown"]


def test_rules(spark):
    df = spark.createDataFrame([("true_false", S, "it is true", None), ("true_false", S, "", "FALSE"), ("true_false", S, "答案是TRUE", None), ("qa", S, "TRUE", None), ("true_false", '{"answer": "maybe"}', "TRUE", None), ("school_qa", '{"type": "choice", "answer": "BC"}', "b", None)], "t string, r string, a string, e string")
    args = [F.col(c) for c in "trae"]
    assert [(x.u, x.v) for x in df.select(b.rule_score_true_false(*args).alias("u"), b.rule_score_choice(*args, ("choice",)).alias("v")).collect()] == [(5, None), (1, None), (1, None), (None, None), (None, None), (None, 1)]


def test_leaderboard_order_and_empty(spark):
    kind = "model_key string, score int, latency_ms double, error string"
    rows = spark.createDataFrame([("a", 3, 1.0, None), ("b", 3, 1.0, "x"), ("c", None, 1.0, None), ("d", 9, 1.0, None), ("e", 5, 1.0, None)], kind)
    assert [r.model for r in b.leaderboard(rows).orderBy("position").collect()] == ["e", "a", "b", "c", "d"]
    empty = spark.createDataFrame([], kind)
    assert b.leaderboard(empty).count() == 0 and [r.n for r in b.score_histogram(empty).collect()] == [0] * 5 and b.scoring_consistency(empty).first().n == 0


def test_keep_first_and_last_with_nulls(spark):
    rows = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("k", 1, None), ("k", 1, "z")], "k string, o int, v string")
    order = [F.col("o"), b.text_or_empty("v")]
    assert sorted((str(r.k), r.v) for r in b.keep(rows, ["k"], order).collect()) == [("None", "a"), ("k", None)]
    assert sorted((str(r.k), r.v) for r in b.keep(rows, ["k"], order, last=True).collect()) == [("None", "b"), ("k", "z")]


def test_samples(spark):
    rows = spark.createDataFrame([(i, "x" if i < 90 else "y" if i < 93 else "z") for i in range(100)], "id long, f string")
    found = sampling.quota_sample(rows, "f", "id", ["x", "y"], 11).collect()
    assert len(found) == 11 and sum(r.f == "y" for r in found) == 3
    found = sampling.guaranteed_sample(rows, "f", "id", ["x", "y", "none"], 5).collect()
    assert len(found) == 5 and {"x", "y"} <= {r.f for r in found}
    assert sampling.quota_sample(rows.limit(0), "f", "id", ["x"], 5).count() == 0
    assert [r.run for r in sampling.cycled(rows.limit(3), "id", 7).orderBy("run").collect()] == list(range(7)) and sampling.cycled(rows.limit(0), "id", 7).count() == 0


def test_top_per_group_and_salted_join(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else "k") for i in range(300)], "i int, k string")
    assert sorted(r.i for r in top_per_group(rows, ["k"], [F.col("i").desc()], 2, "i", slices=5).collect()) == [294, 297, 298, 299]
    right = spark.createDataFrame([("k", "v"), (None, "w")], "k string, v string")
    joined = salted_join(rows, right, "k", "i", rows_per_task=7).collect()
    assert len(joined) == 100 and {r.v for r in joined} == {"v"}


def test_trend(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-04", 9), ("b", "2024-01-02", 5), ("c", None, 5)], "t string, d string, v long")
    days = trend.topic_days(rows, "t", F.col("d").cast("date"), F.col("v"))
    found = trend.trend_scores(days, "2024-01-01", "2024-01-04").collect()
    assert [(r.topic, r.early_avg, r.recent_avg, r.score) for r in found] == [("a", 0.5, 4.5, round(4 / 1.5, 6))]
    assert trend.filled(days, "2024-01-01", "2024-01-04").count() == 8
    # One week only: no momentum. Then weeks without a row, which count as 0.
    assert {r.topic: r.momentum for r in trend.momentum(days).collect()} == {"a": "", "b": ""}
    more = spark.createDataFrame([("a", "2024-01-01", 4), ("a", "2024-01-29", 6), ("b", "2024-01-09", 8), ("b", "2024-01-23", 4)], "t string, d string, v long")
    far = trend.topic_days(more, "t", F.col("d").cast("date"), F.col("v"))
    assert {r.topic: (r.ratio, r.momentum, str(r.peak_week)) for r in trend.momentum(far).collect()} == {"a": (1.5, "穩定上升 ↗", "2024-01-29"), "b": (0.5, "緩慢退燒 ↘", "2024-01-08")}
    labels = {(r.topic, str(r.week)): r.label for r in trend.weekly_changes(far).collect()}
    assert [labels["b", f"2024-01-{d:02}"] for d in (1, 8, 15, 22, 29)] == ["—", "new", "-100%", "new", "-100%"] and len(labels) == 10


def test_chain_roots(spark):
    found = chain_roots(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, 77), (5, 5)], "k long, parent long")).collect()
    assert {r.k: (r.root, r.depth) for r in found} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 9: (9, 0), 5: (5, 0)}
