"""Samplers with quotas by bucket, made deterministic: rows are ordered by a hash of their key and a seed.

A bucket may hold a third of all rows. Only the first `size` rows of a bucket can be chosen: ranks are limited in each of
64 hash slices of a bucket first, and Spark keeps no more than `size` rows of a slice in any task before the shuffle
(WindowGroupLimit; `tests/test_plans.py` looks for it in the plan).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from strandmill.session import cut

SLICES = 64


def ordered_head(rows: DataFrame, bucket: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """rows with `place` (from 1) of each bucket's first `size` rows in hash order; ties by key."""
    hashed = rows.withColumn("draw", F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed)))))
    order = [F.col("draw"), F.col(key).cast("string")]
    # First within slices of a bucket, then among what is left: at most SLICES * size rows a bucket.
    part = hashed.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(SLICES)))
    few = part.withColumn("place", F.row_number().over(Window.partitionBy(bucket, "slice").orderBy(*order))).filter(F.col("place") <= size).drop("place", "slice")
    return few.withColumn("place", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).filter(F.col("place") <= size)


def quota_sample(rows: DataFrame, bucket: str, key: str, labels: Sequence[str], size: int, seed: int = 0) -> DataFrame:
    """Size // k rows a label (the first size % k labels one more), topped up from the other rows of the labels in hash order."""
    size = max(1, min(size, 100))
    base, more = divmod(size, max(1, len(labels)))
    quota = F.create_map(*[F.lit(x) for i, label in enumerate(labels) for x in (label, base + (i < more))])
    head = ordered_head(rows.filter(F.col(bucket).isin(*labels)), bucket, key, size, seed).withColumn("within", F.col("place") <= quota[F.col(bucket)])
    # At most size rows a label from here on.
    ranked = head.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.col("within").desc(), "draw", F.col(key).cast("string"))))
    return ranked.filter(F.col("rank") <= size)


def guaranteed_sample(rows: DataFrame, bucket: str, key: str, labels: Sequence[str], size: int, seed: int = 0) -> DataFrame:
    """One row of each label that has one, then the rest in hash order, up to size rows."""
    size = max(1, min(size, 100))
    known = F.when(F.col(bucket).isin(*labels), F.col(bucket)).otherwise(F.lit(""))
    head = ordered_head(rows.withColumn("own", known), "own", key, size, seed).withColumn("within", (F.col("place") == 1) & (F.col("own") != ""))
    ranked = head.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.col("within").desc(), "draw", F.col(key).cast("string"))))
    return ranked.filter(F.col("rank") <= size)


def cycled(prompts: DataFrame, order: str, runs: int) -> DataFrame:
    """`runs` rows, the prompts in order over and over; places come from a range sort, so that no task holds all prompts."""
    pool, total = numbered(prompts, [F.col(order)])
    if not total:
        return prompts.withColumn("run", F.lit(None).cast("long"))
    spine = prompts.sparkSession.range(runs).withColumnRenamed("id", "run").withColumn("i", F.col("run") % total)
    return spine.join(pool, "i").drop("i")


def balanced_sample(rows: DataFrame, bucket: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """`size` rows spread evenly over all buckets, in the buckets' order of their least key; buckets with too few rows are made up for by rows of the others.

    A null bucket is a bucket. With no more rows than `size` all come out. The labels are grouped before; those with a quota
    are at most `size` (the first ones have one row each where there are more buckets than rows).
    """
    head = ordered_head(rows, bucket, key, size, seed)
    firsts = rows.groupBy(bucket).agg(F.min(F.col(key)).alias("first_key"))
    n = firsts.count()
    if not n:
        return rows
    base, more = divmod(size, n)
    # One row a bucket that has a quota beyond the base.
    extra = firsts.orderBy("first_key").limit(more).select(F.col(bucket).alias("_b"), F.lit(1).alias("_more"))
    with_quota = head.join(F.broadcast(extra), head[bucket].eqNullSafe(extra["_b"]), "left").withColumn("within", F.col("place") <= base + F.coalesce("_more", F.lit(0))).drop("_b", "_more")
    # At most `size` rows within the quotas, and as many of the rest, come to the last sort.
    chosen = with_quota.orderBy(F.col("within").desc(), "draw", F.col(key).cast("string")).limit(size)
    return chosen.select(*rows.columns)


def numbered(rows: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, int]:
    """rows with `i` (from 0) in order, which should tell all rows apart, and their number: a range sort, counts per partition, offsets."""
    held = cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = held.groupBy(F.shiftrightunsigned("_at", 33).alias("part")).count().collect()
    offsets, total = [], 0
    for part, n in sorted(counts):
        offsets.append((part, total))
        total += n
    # One row a partition.
    starts = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part long, _start long"))
    placed = held.withColumn("_part", F.shiftrightunsigned("_at", 33)).join(starts, "_part")
    return placed.withColumn("i", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_start"), total


def with_replacement(rows: DataFrame, order: Sequence[Column], size: int, seed: int = 0) -> DataFrame:
    """Rows with `n`, the number of the draw, from 0: each draw takes one of all rows, by a hash of n and the seed. No rows are an error."""
    pool, total = numbered(rows, order)
    if not total:
        raise ValueError("no rows to sample from")
    # 60 bits of the hash.
    drawn = F.conv(F.substring(F.md5(F.concat(F.col("n").cast("string"), F.lit(f"#{seed}"))), 1, 15), 16, 10).cast("long")
    draws = rows.sparkSession.range(size).select(F.col("id").alias("n")).withColumn("i", drawn % total)
    return pool.join(draws, "i").drop("i")


def declustered(rows: Sequence[Row]) -> list[Row]:
    """The rows (title, prefix, ...) in an order in which neighbours differ in title and prefix, else in prefix, else in title: always the first row that can follow."""
    left, out = list(rows), []
    title = prefix = ""
    while left:
        tests = (lambda r: r.title != title and r.prefix != prefix, lambda r: r.prefix != prefix, lambda r: r.title != title)
        at = next((i for t in tests for i, r in enumerate(left) if t(r)), 0)
        out.append(left.pop(at))
        title, prefix = out[-1].title, out[-1].prefix
    return out
