from strandmill.llm.mixture import mix, mixture_report, plan_sources

DOC = "doc_id long, source string, n_tokens int, weight double, repeats int"
TARGET = "source string, target_share double, max_repeats int"


def documents(spark, sizes):
    return spark.createDataFrame([(i, s, n, 0.5 + (i % 3) / 4, 9) for i, (s, n) in enumerate(sizes)], DOC)


def shares(spark, sizes, targets):
    mixture, plans = mix(documents(spark, sizes), spark.createDataFrame(targets, TARGET))
    return {r.source: r for r in mixture_report(mixture, plans).collect()}, mixture


def test_shares_and_repeats(spark):
    sizes = [("Big ", 10 + i % 7) for i in range(900)] + [("small", 10 + i % 5) for i in range(60)] + [("none", 10)] * 5 + [(None, 10)] * 5
    found, mixture = shares(spark, sizes, [("big", 0.7, 2), ("SMALL", 0.3, 3)])
    assert abs(found["big"].share_error) < 0.002 and abs(found["small"].share_error) < 0.002
    assert found["small"].most_repeats == 3 and found["big"].most_repeats == 1 and {r.source for r in mixture.collect()} == {"big", "small"}


def test_whole_epochs_come_first(spark):
    found, mixture = shares(spark, [("a", 10)] * 100 + [("b", 10)] * 40, [("a", 0.5, 1), ("b", 0.5, 9)])
    rows = [r.repeats for r in mixture.filter("source = 'b'").collect()]
    assert found["b"].epochs == 2 and sorted(set(rows)) == [2, 3] and len(rows) == 40 and abs(found["b"].share_error) < 0.01


def test_deterministic_and_weighted(spark):
    sizes = [("a", 10)] * 2000 + [("b", 10)] * 300
    targets = [("a", 0.5, 1), ("b", 0.5, 1)]
    first, second = (sorted(r.doc_id for r in shares(spark, sizes, targets)[1].filter("source = 'a'").collect()) for _ in range(2))
    assert first == second and 290 <= len(first) <= 310
    assert sum(i % 3 == 2 for i in first) > sum(i % 3 == 0 for i in first)


def test_edges(spark):
    assert shares(spark, [("a", 10)], [])[1].count() == 0 and shares(spark, [], [("a", 1.0, 2)])[1].count() == 0
    found, _ = shares(spark, [("a", 10)] * 50 + [("z", 0)] * 3, [("a", 0.5, 1), ("z", 0.2, 2), ("gone", 0.3, 2), (None, 0.5, 1), ("bad", None, 1)])
    assert found["a"].actual_share == 1.0 and found["z"].used_tokens == found["gone"].used_tokens == 0
    plans = {p.source: p for p in plan_sources({"a": (0.5, 2), "b": (0.5, 4)}, {"a": 100, "b": 40})}
    assert plans["a"].epochs == 1 and plans["b"].epochs == 4 and plans["a"].rest == 60.0
