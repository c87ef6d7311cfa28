"""Topics by day: zero-filled series, trend scores, momentum, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def topic_days(rows: DataFrame, topic: str, day: Column, value: Column) -> DataFrame:
    """topic, date, total, n: one row a topic and day; rows without a day are left out."""
    return rows.select(F.col(topic).alias("topic"), day.alias("date"), value.alias("value")).filter("date is not null").groupBy("topic", "date").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def filled(days: DataFrame, first: str, last: str) -> DataFrame:
    """topic, date, total with 0 for days without a row; the days between the two dates, both included."""
    spine = days.sparkSession.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS date")
    topics = days.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select("topic").distinct()
    every = topics.withColumn("one", F.lit(1)).join(F.broadcast(spine.withColumn("one", F.lit(1))), "one").drop("one")
    return every.join(days.select("topic", "date", "total"), ["topic", "date"], "left").select("topic", "date", F.coalesce("total", F.lit(0)).alias("total"))


def trend_scores(days: DataFrame, first: str, last: str, least_active: int = 2) -> DataFrame:
    """topic, score, early_avg, recent_avg, total, active_days: (recent - early) / (early + 1) of the two halves of the days (at least two)."""
    series = filled(days, first, last)
    length = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1
    early = F.datediff("date", F.lit(first).cast("date")) < F.floor(length / 2)
    a = series.groupBy("topic").agg(F.avg(F.when(early, F.col("total"))).alias("e"), F.avg(F.when(~early, F.col("total"))).alias("r"), F.sum("total").alias("total"), F.count_if(F.col("total") > 0).alias("active_days"))
    return a.filter(F.col("active_days") >= least_active).select("topic", F.round((F.col("r") - F.col("e")) / (F.col("e") + 1), 6).alias("score"), F.round("e", 6).alias("early_avg"), F.round("r", 6).alias("recent_avg"), "total", "active_days")


def cooling(scores: DataFrame, top: int = 10, below: float = -0.2) -> DataFrame:
    """The lowest first and then the limit, before the threshold."""
    return scores.orderBy("score", "topic").limit(top).filter(F.col("score") < below)


# Labels of weekly changes and of momentum, from the least ratio upwards.
NEW, NO_CHANGE = "new", "—"
MOMENTUM = ((2.0, "急速加速 🚀"), (1.3, "穩定上升 ↗"), (0.8, "持平震盪 ↔"), (0.5, "緩慢退燒 ↘"), (0.0, "快速冷卻 ❄"))


def weeks(days: DataFrame) -> DataFrame:
    """topic, week, i, n, total: every week from the first to the last of all topics, 0 where a topic has none; i counts from 0."""
    own = days.groupBy("topic", F.date_trunc("week", F.col("date")).cast("date").alias("week")).agg(F.sum("total").alias("total"))
    span = days.agg(F.date_trunc("week", F.min("date")).cast("date").alias("a"), F.date_trunc("week", F.max("date")).cast("date").alias("b"))
    # One row a week of the calendar.
    spine = span.filter("a is not null").select(F.posexplode(F.sequence("a", "b", F.expr("INTERVAL 7 DAY"))).alias("i", "week"), (F.datediff("b", "a") / 7 + 1).cast("int").alias("n"))
    every = own.select("topic").distinct().crossJoin(F.broadcast(spine))
    return every.join(own, ["topic", "week"], "left").select("topic", "week", "i", "n", F.coalesce("total", F.lit(0)).alias("total"))


def weekly_changes(days: DataFrame) -> DataFrame:
    """Topic, week, total, label: the change to the week before in whole percent; 'new' after a week of 0, a dash for the first."""
    before = F.lag("total").over(Window.partitionBy("topic").orderBy("week"))
    c = weeks(days).withColumn("before", before)
    percent = F.bround((F.col("total") - F.col("before")) / F.col("before") * 100, 0).cast("long")
    signed = F.concat(F.when(F.col("total") >= F.col("before"), "+").when(percent == 0, "-").otherwise(""), percent.cast("string"), F.lit("%"))
    label = F.when(F.col("before").isNull(), NO_CHANGE).when(F.col("before") == 0, F.when(F.col("total") > 0, NEW).otherwise(NO_CHANGE)).otherwise(signed)
    return c.select("topic", "week", "total", label.alias("label"))


def momentum(days: DataFrame) -> DataFrame:
    """Topic, ratio, momentum, peak_week: weeks of the later half by those of the earlier (0 counts as 1); the first week of the peak."""
    early = F.col("i") < F.floor(F.col("n") / 2)
    a = weeks(days).groupBy("topic").agg(F.sum(F.when(early, F.col("total")).otherwise(0)).alias("e"), F.sum(F.when(early, 0).otherwise(F.col("total"))).alias("l"), F.max("n").alias("n"), F.max_by("week", F.struct("total", -F.col("i"))).alias("peak_week"))
    ratio = F.col("l") / F.when(F.col("e") == 0, 1).otherwise(F.col("e"))
    kind = F.when(F.col("n") < 2, "")
    for least, name in MOMENTUM:
        kind = kind.when(ratio >= least, name)
    return a.select("topic", F.round(ratio, 6).alias("ratio"), kind.alias("momentum"), "peak_week")
