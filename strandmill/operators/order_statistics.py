"""Values at given positions of sorted groups: one distributed sort for all positions and two granularities.

A state is a table (measure, k0.., period, value, n): how often each value occurs in a group, combined before the shuffle.
It is range-partitioned by group and value and kept (checkpoint). Counts per partition, group and period give, as
running sums over the partitions, each partition's offset in its group; the partition then finds the positions that fall
into it. Groups are looked at as a whole and by period; both come from the same sort, as rows of one period are in value
order, too. A group that holds a third of all rows spreads over a third of the partitions, and equal values are one row.

Positions are counted from 0 and named by a rule (kind, q) for a group of n values:
  low, high   floor and ceiling of q * (n - 1): neighbours for linear interpolation
  nearest     min(int(n * q), n - 1)
  ceiling     ceil(q * n) - 1
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandmill.session import cut

#: State rows to a partition of the sort; one probe holds one such partition.
ROWS_PER_PARTITION = 400_000

Rule = tuple[str, float]


def combine_states(states: Sequence[DataFrame]) -> DataFrame:
    """The state of all rows from states of disjoint sets of rows."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy([c for c in states[0].columns if c != "n"]).agg(F.sum("n").alias("n"))


def position(rule: Rule, total: np.ndarray) -> np.ndarray:
    kind, q = rule
    # In millionths, so that n * q is exact where q has few digits.
    scaled = total * round(q * 1_000_000)
    if kind == "nearest":
        return np.minimum(scaled // 1_000_000, total - 1)
    if kind == "ceiling":
        return np.maximum(-(-scaled // 1_000_000) - 1, 0)
    at = (total - 1) * round(q * 1_000_000)
    return at // 1_000_000 if kind == "low" else -(-at // 1_000_000)


def _find(keys: list[str], rules: tuple[Rule, ...]):
    """For one partition of the sorted state: the values at the wanted positions of each of its groups."""
    group_keys = ["measure", *keys]
    columns = [*group_keys, "period", "per_period", "rule", "value", "total"]

    def find(data: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        blocks = blocks.rename(columns=lambda c: c.removeprefix("b_"))
        for per_period in (False, True):
            by = [*group_keys, "period"] if per_period else group_keys
            rows = data[data["period"].notna()] if per_period else data
            own = blocks[blocks["per_period"] == per_period]
            if not len(rows) or not len(own):
                continue
            rows = rows.sort_values("value", kind="stable")
            number = rows.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(number, kind="stable")
            group = number[order]
            n, value = rows["n"].to_numpy(np.int64)[order], rows["value"].to_numpy(np.float64)[order]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            heads = rows.iloc[order[starts]][by].merge(own[[*by, "offset", "total"]], on=by, how="left")
            total, offset = heads["total"].to_numpy(np.int64), heads["offset"].to_numpy(np.int64)
            running = np.cumsum(n)
            before = running[starts] - n[starts]
            inside = np.r_[running[starts[1:] - 1], running[-1]] - before
            for i, rule in enumerate(rules):
                rest = position(rule, total) - offset
                hit = np.flatnonzero((rest >= 0) & (rest < inside))
                found = np.searchsorted(running, before[hit] + rest[hit], "right")
                out.append(heads.iloc[hit][by].assign(per_period=per_period, rule=i, value=value[found], total=total[hit]))
        if not out:
            return pd.DataFrame(columns=columns)
        return pd.concat(out, ignore_index=True).reindex(columns=columns)

    return find


def order_statistics(state: DataFrame, rules: Sequence[Rule], expected_rows: int | None = None, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """measure, k0.., per_period, period, total, values (array in the order of `rules`).

    expected_rows: rows of the state or a bound of them, for the number of partitions; counted if not given.
    """
    keys = [c for c in state.columns if c not in ("measure", "period", "value", "n")]
    kinds = dict(state.dtypes)
    spark = state.sparkSession
    if expected_rows is None:
        state = cut(state)
        expected_rows = state.count()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected_rows // rows_per_partition), 1)
    group = ["measure", *keys]
    placed = cut(state.repartitionByRange(partitions, *group, "value").withColumn("pid", F.spark_partition_id()))
    per_period = placed.filter("period is not null").groupBy("pid", *group, "period").agg(F.sum("n").alias("inside")).withColumn("per_period", F.lit(True))
    overall = placed.groupBy("pid", *group).agg(F.sum("n").alias("inside")).withColumn("period", F.lit(None).cast("int")).withColumn("per_period", F.lit(False))
    # A window holds one row for each partition that a group touches.
    within = Window.partitionBy(*group, "period", "per_period")
    blocks = per_period.unionByName(overall).select("*", (F.sum("inside").over(within.orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("inside")).alias("offset"), F.sum("inside").over(within).alias("total")).drop("inside")
    # Other names, so other columns: where the sides of a cogroup share columns, the optimiser prunes those of one side.
    blocks = blocks.select(*[F.col(c).alias(f"b_{c}") for c in blocks.columns])
    kind = ", ".join(["measure string", *[f"{k} {kinds[k]}" for k in keys], "period int", "per_period boolean", "rule int", "value double", "total long"])
    found = placed.groupBy("pid").cogroup(blocks.groupBy("b_pid")).applyInPandas(_find(keys, tuple(rules)), kind)
    values = F.array(*[F.max(F.when(F.col("rule") == i, F.col("value"))) for i in range(len(rules))])
    return found.groupBy(*group, "per_period", "period", "total").agg(values.alias("values"))
