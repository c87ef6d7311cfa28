"""Equi-joins in which a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of one key that a task takes; keys with more are spread.
ROWS_PER_TASK = 100_000
#: Keys that are spread at most; where more keys are hot the rows of a task grow instead of the list.
MOST_HOT_KEYS = 10_000


def salted_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Inner join of `left` with `right`, which has few rows a key; rows of `left` of a hot key are spread over salts.

    Counts are combined before the shuffle, and only keys with more than `rows_per_task` rows, or a ten-thousandth of all
    rows if that is more, come to the driver: at most MOST_HOT_KEYS. Rows with a null key are in no result.
    """
    spark = left.sparkSession
    keyed = left.select(key).filter(F.col(key).isNotNull())
    rows_per_task = max(rows_per_task, -(-keyed.count() // MOST_HOT_KEYS))
    hot = [(r[key], -(-r["n"] // rows_per_task)) for r in keyed.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_task).collect()]
    if not hot:
        return left.join(right, key)
    salts = F.broadcast(spark.createDataFrame(hot, f"{key} {dict(left.dtypes)[key]}, salts int"))
    spread = left.join(salts, key, "left").withColumn("salt", F.pmod(F.xxhash64(spread_by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = right.join(salts, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return spread.join(copies, [key, "salt"]).drop("salt")
