"""Mixing sources to target shares of tokens by weighted sampling without replacement.

Every document has the key -ln(u) / w (Efraimidis and Spirakis): u in (0, 1) from a hash of its id, w its quality weight.
The size of the mixture is the largest at which every target share can be met exactly:
T = min(max_repeats * available tokens / share). A source gives its whole documents in complete epochs, as many as fit
into share * T, and the rest from the documents of the least keys: prefix sums of tokens in key order up to the budget.

Prefix sums are distributed: rows are range-partitioned by source and key and kept; sums for each partition and source
(a few rows a partition) tell in which partition a source's budget ends; partitions before it are taken whole, and only
inside that partition a running sum is made. No source is ever in one task.

Defined results: labels are compared without case and surrounding white space; documents without a label or with one
that has no target aren't used. A document without tokens is repeated with its epochs but adds nothing. Sources with a
target but without tokens can't be met: the others' shares are scaled to 1, and the report shows them with share 0.
A target's share or repeats that are null or not positive mean that the source isn't used; of targets with equal labels
the shares are added and the smallest repeats hold. Whole documents fill a budget in key order, and one more is taken if that brings the sum
nearer to it; it is the one of its partition that brings it nearest. Repeated rows of an id are documents of their own. Empty tables give an empty mixture.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandmill.functions.keys import comparable_key
from strandmill.session import cut

SEED = 20240601
#: Rows of a partition of the sort; the running sum of one source is made inside one partition only.
ROWS_PER_PARTITION = 500_000


def quality_weight(text: Column) -> Column:
    """A stand-in for a trained quality score, between 0.05 and 1 (`mix` takes any column `weight`): the share of letters, digits and ideographs, less for very short texts and for broken characters."""
    length = F.nullif(F.length(text), F.lit(0))
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")) / length
    broken = F.length(F.regexp_replace(text, r"[^\x{FFFD}\p{Cc}&&[^\n\r\t]]+", "")) / length
    long_enough = F.least(F.lit(1.0), length / F.lit(120.0))
    return F.greatest(F.lit(0.05), F.coalesce(plain * long_enough * F.greatest(F.lit(0.0), 1 - 20 * broken), F.lit(0.05)))


@dataclass(frozen=True)
class Plan:
    """One source's part of the mixture."""

    source: str
    share: float
    max_repeats: int
    available: int
    epochs: int
    rest: float


def plan_sources(targets: dict[str, tuple[float, int]], available: dict[str, int]) -> list[Plan]:
    """Epochs and rest of each source at the largest size that meets all shares."""
    usable = {s: (w, n) for s, (w, n) in targets.items() if w > 0 and n > 0 and available.get(s, 0) > 0}
    total = sum(w for w, _ in usable.values())
    size = min((n * available[s] / (w / total) for s, (w, n) in usable.items()), default=0.0)
    plans = []
    for source, (share, repeats) in sorted(targets.items()):
        have, budget = available.get(source, 0), 0.0
        if source in usable:
            budget = min(size * share / total, float(repeats * have))
        epochs = min(repeats, int(budget // have + 1e-12)) if have else 0
        rest = budget - epochs * have
        plans.append(Plan(source, share, repeats, have, epochs, rest if rest > 1e-6 and epochs < repeats else 0.0))
    return plans


def mix(documents: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, list[Plan]]:
    """doc_id, source, n_tokens, repeats of (doc_id, source, n_tokens, weight) for targets (source, target_share, max_repeats); and the plan.

    `targets` has a row a source and goes to the driver.
    """
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select(comparable_key("source").alias("source"), "target_share", "max_repeats").collect():
        if r["source"] and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0:
            share, repeats = wanted.get(r["source"], (0.0, r["max_repeats"]))
            wanted[r["source"]] = (share + r["target_share"], min(repeats, r["max_repeats"]))
    spark = documents.sparkSession
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    keyed = cut(documents.select("doc_id", comparable_key("source").alias("source"), F.col("n_tokens").cast("long").alias("n_tokens"), (-F.log(u) / F.col("weight")).alias("sample_key")).filter(F.col("source").isin(*wanted)))
    totals = keyed.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()
    available, rows_used = {r["source"]: r["n"] for r in totals}, sum(r["rows"] for r in totals)
    plans = plan_sources(wanted, available)
    order = ["source", "sample_key", "doc_id"]
    # A number of partitions by the rows, so that the one in which a budget ends stays small; adaptive execution leaves given ones as they are.
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows_used // ROWS_PER_PARTITION))
    placed = cut(keyed.repartitionByRange(partitions, *order).withColumn("pid", F.spark_partition_id()))
    sums: dict[str, list[tuple[int, int]]] = {}
    for r in placed.groupBy("source", "pid").agg(F.sum("n_tokens").alias("n")).collect():  # sources + partitions rows at most
        sums.setdefault(r["source"], []).append((r["pid"], r["n"]))
    ends = []
    for p in plans:
        before, at = 0, -1
        for pid, n in sorted(sums.get(p.source, [])):
            at = pid
            if before + n >= p.rest:
                break
            before += n
        ends.append((p.source, p.epochs, p.rest, at, before))
    ends_df = F.broadcast(spark.createDataFrame(ends, "source string, epochs int, rest double, at int, before long"))
    rows = placed.join(ends_df, "source")
    inside = Window.partitionBy("source").orderBy("sample_key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Whole documents up to the budget, and the one document of the same partition that then brings the sum nearest to it.
    edge = rows.filter("pid = at").withColumn("sum", F.sum("n_tokens").over(inside) + F.col("before")).withColumn("fits", (F.col("rest") > 0) & (F.col("sum") <= F.col("rest")))
    edge = edge.withColumn("gap", F.col("rest") - F.coalesce(F.max(F.when(F.col("fits"), F.col("sum"))).over(Window.partitionBy("source")), F.col("before")))
    miss = F.abs(F.col("n_tokens") - F.col("gap"))
    edge = edge.withColumn("nearest", F.row_number().over(Window.partitionBy("source", "fits").orderBy(miss, "doc_id")))
    extra = F.when(F.col("fits") | ((F.col("rest") > 0) & (F.col("nearest") == 1) & (miss < F.col("gap"))), 1).otherwise(0)
    others = rows.filter("pid <> at").withColumn("repeats", F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("pid") < F.col("at")), 1).otherwise(0))
    columns = ["doc_id", "source", "n_tokens", "repeats"]
    return edge.withColumn("repeats", F.col("epochs") + extra).select(columns).unionByName(others.select(columns)).filter("repeats > 0"), plans


def mixture_report(mixture: DataFrame, plans: list[Plan]) -> DataFrame:
    """source, target_share, actual_share, share_error, n_documents, most_repeats, epochs, available_tokens, used_tokens: one row a target."""
    spark = mixture.sparkSession
    told = spark.createDataFrame([(p.source, p.share, p.max_repeats, p.epochs, p.available) for p in plans], "source string, target_share double, max_repeats int, epochs int, available_tokens long")
    used = mixture.groupBy("source").agg(F.count("*").alias("n_documents"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"))
    # One row a source, so a window over all of them is small.
    both = F.broadcast(told).join(used, "source", "left").fillna(0, ["n_documents", "most_repeats", "used_tokens"])
    share = F.coalesce(F.try_divide(F.col("used_tokens").cast("double"), F.sum("used_tokens").over(Window.partitionBy())), F.lit(0.0))
    return both.withColumn("actual_share", share).withColumn("share_error", F.col("actual_share") - F.col("target_share"))
