"""Structured Streaming forms of the hourly request counts and of the daily topic store.

The batch operators define the results; with a watermark a row that comes later than `late` is left out, which the batch
form wouldn't do. Both are extensions: state is kept by the engine and survives lost executors with the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from strandmill.sources.sinks import replace_days


def hourly_requests(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """server, hour, n, errors of a stream (or batch) of request records; repeated records within the watermark count once."""
    timed = rows.withColumn("at", F.timestamp_seconds(F.col("start_ts")))
    if rows.isStreaming:
        timed = timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["request_id"])
    else:
        timed = timed.dropDuplicates(["request_id"])
    grouped = timed.groupBy(F.window("at", "1 hour").alias("w"), "server").agg(F.count("*").alias("n"), F.count_if(F.col("error") != "").alias("errors"))
    return grouped.select("server", F.col("w.start").alias("hour"), "n", "errors")


def store_days(rows: DataFrame, folder: str, checkpoint: str, day: str = "date") -> StreamingQuery:
    """Write each micro-batch's days over the stored ones (F26, K10); one trigger over what is there."""
    return rows.writeStream.foreachBatch(lambda batch, _: replace_days(batch, folder, day)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
