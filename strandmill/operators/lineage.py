"""Chains of parents: the root of every record."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandmill.session import cut


def chain_roots(rows: DataFrame) -> DataFrame:
    """k, root, depth of (k, parent). A null parent, an unknown one or a record's own key end the chain.

    Each round doubles the distance that a record knows, so a chain of length d takes log2(d) rounds; each is checkpointed.
    Records on a cycle never reach a root and come out with the least key of what they reached after 64 rounds.
    """
    own = rows.select("k", "parent").filter("k is not null").groupBy("k").agg(F.min("parent").alias("parent"))
    known = own.select(F.col("k").alias("parent"))
    e = own.join(known.withColumn("there", F.lit(True)), "parent", "left")
    step = cut(e.select("k", F.when(F.col("there") & (F.col("parent") != F.col("k")), F.col("parent")).otherwise(F.col("k")).alias("to")).withColumn("depth", F.when(F.col("to") == F.col("k"), 0).otherwise(1)))
    for _ in range(64):
        far = step.select(F.col("k").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        joined = cut(step.join(far, "to").select("k", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("next") != F.col("to")).alias("moved")))
        step = joined.drop("moved")
        if joined.filter("moved").isEmpty():
            break
    return step.select("k", F.col("to").alias("root"), "depth")
