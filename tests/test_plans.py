from strandmill.operators.sampling import balanced_sample, numbered, ordered_head
from strandmill.operators.topk import top_per_group
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_limited_before_the_shuffle(spark):
    """Without this a bucket's rows would all be sorted in a few tasks."""
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("b"))
    for made in (ordered_head(df, "b", "id", 5), top_per_group(df, ["b"], [F.col("id")], 5, "id")):
        assert "WindowGroupLimit" in plan(made)


def test_numbers_follow_a_range_sort(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    made, total = numbered(df, [F.col("k")])
    assert total == 1000 and made.filter("k <> i").isEmpty() and "SinglePartition" not in plan(made)


def test_balanced_sample(spark):
    df = spark.createDataFrame([(i, "big") for i in range(100)] + [(200, "one"), (300, None), (301, None), (302, None)], "k int, b string")
    got = [r.b for r in balanced_sample(df, "b", "k", 9).collect()]
    # A third each; what "one" lacks is made up by others.
    assert len(got) == 9 and got.count("one") == 1 and got.count(None) == 3 and got.count("big") == 5
    assert balanced_sample(df, "b", "k", 2).count() == 2 and balanced_sample(df, "b", "k", 1000).count() == 104 and balanced_sample(df.limit(0), "b", "k", 3).count() == 0
