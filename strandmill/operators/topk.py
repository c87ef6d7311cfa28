"""First k rows of each group, in two steps: within hash slices of a group, then among what is left (slices * k rows a group at most)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICES = 64


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread_by: str, slices: int = SLICES) -> DataFrame:
    """The columns of `rows`; `order` should tell all rows of a group apart. A null key is a key."""
    part = rows.withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.lit(slices)))
    few = part.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))).filter(F.col("_place") <= k)
    return few.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_place") <= k).drop("_place", "_slice")
