"""Exact percentiles of very large numeric columns, per group, for single days and all days together.

One distributed sort of (group, value) serves every quantile and both granularities:

1. `percentile_state` counts equal values per group and day, combined before the shuffle. A state is a table of
   (measure, keys, period, value, n); states of separate partitions or days are combined by a union (`combine_states`), nothing is lost. A period is a day.
2. `percentiles_from_state` range-partitions the state by group and value and keeps it (checkpoint). Counts per
   partition, group and day give, as running sums over the partitions, the offset of each partition in its group.
   Each partition finds the positions that fall into it, and the two neighbours of a position are interpolated.

The result is exact: error_bound is 0 for each row. A group that holds a third of all rows spreads over a third of the
partitions; equal values are one row, so a value that holds a third of all rows is no hot spot.

Defined results: the quantile q of n values lies at position q * (n - 1) (counted from 0), linear between neighbours.
Null and NaN values don't count; a group without values has no row. Rows with one identity count once (the least row,
by its fields); rows with a null identity are all kept. A null key is a group of its own; a null or non-finite time
counts for all days only. Ties, repeated rows and negative values are ordinary. An empty table gives no rows. Columns
of the input may have any names: all inner columns are made by select.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strandmill.operators.order_statistics import order_statistics

QUANTILES = (0.5, 0.9, 0.95, 0.99)


def epoch_day(seconds: Column) -> Column:
    """Days since 1970-01-01 (UTC) of epoch seconds; null where the time is null, NaN or infinite."""
    return F.when(F.abs(seconds) < 1e14, F.floor(seconds / 86400).cast("int"))


def percentile_state(rows: DataFrame, keys: Sequence[str], measures: Sequence[str], identity: str | None, time: str | None) -> DataFrame:
    """measure, k0.., period, value, n: how often each value occurs in a group on a day."""
    named = {f"k{i}": F.col(k) for i, k in enumerate(keys)}
    day = epoch_day(F.col(time)) if time else F.lit(None).cast("int")
    wide = rows.select(*[c.alias(n) for n, c in named.items()], day.alias("period"), *[F.col(m).cast("double").alias(f"v{i}") for i, m in enumerate(measures)], *([F.col(identity).alias("identity")] if identity else []))
    if identity:
        body = F.struct(*[c for c in wide.columns if c != "identity"])
        once = wide.filter("identity is not null").groupBy("identity").agg(F.min(body).alias("b")).select("b.*")
        wide = once.unionByName(wide.filter("identity is null").drop("identity"))
    long = wide.select(*named, "period", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"v{i}").alias("value")) for i, m in enumerate(measures)])).alias("m"))
    long = long.select("m.measure", *named, "period", (F.col("m.value") + F.lit(0.0)).alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("measure", *named, "period", "value").agg(F.count("*").alias("n"))


def percentiles_from_state(state: DataFrame, quantiles: Sequence[float] = QUANTILES, expected_rows: int | None = None) -> DataFrame:
    """measure, k0.., per_period, period, n, quantiles (array, in the order asked for), error_bound."""
    keys = [c for c in state.columns if c not in ("measure", "period", "value", "n")]
    found = order_statistics(state, [rule for q in quantiles for rule in (("low", q), ("high", q))], expected_rows)

    def line(i: int, q: float) -> Column:
        at = F.lit(q) * (F.col("total") - 1)
        low, high = F.col("values")[2 * i], F.col("values")[2 * i + 1]
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    return found.select("measure", *keys, "per_period", "period", F.col("total").alias("n"), F.array(*[line(i, q) for i, q in enumerate(quantiles)]).alias("quantiles"), F.lit(0.0).alias("error_bound"))


def percentiles(rows: DataFrame, keys: Sequence[str], measures: Sequence[str], identity: str | None = None, time: str | None = None, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """State and percentiles in one call."""
    return percentiles_from_state(percentile_state(rows, keys, measures, identity, time), quantiles, rows.count() * len(measures))
