"""Sinks: JSON lines by partition, header-only CSV, last-write-wins upserts, first-write-wins inserts, replaced days, reports.

Distributed writes go through Spark's writers; only reports, whose rows are one for each group of a few keys, are
collected, and `small_rows` refuses more than its bound.
"""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

REPORT_ROWS = 100_000


def small_rows(df: DataFrame, most: int = REPORT_ROWS) -> list[dict]:
    """Rows of a report; more than `most` are an error, never cut."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them with Spark instead")
    return rows


def write_requests(rows: DataFrame, folder: str) -> None:
    """JSON lines by scenario and server."""
    rows.write.mode("overwrite").partitionBy("scenario", "server").json(folder)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, also if there are no rows."""
    rows = small_rows(df)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, df.columns)
        w.writeheader()
        w.writerows(rows)


def write_json(value: object, path: str) -> None:
    """Absent instead of null, readable text."""

    def lean(v):
        if isinstance(v, dict):
            return {k: lean(x) for k, x in v.items() if x is not None}
        return [lean(x) for x in v] if isinstance(v, list) else v

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(lean(value), f, ensure_ascii=False, indent=2, default=str)


def nested_summary(metrics: DataFrame) -> dict:
    """The tree scenarios > server > values and concurrency_buckets, of the flat metrics."""
    tree: dict = {"scenarios": {}}
    for r in small_rows(metrics):
        node = tree["scenarios"].setdefault(r.pop("scenario"), {}).setdefault(r.pop("server"), {"concurrency_buckets": {}})
        level = r.pop("level")
        if level is None:
            node.update(r)
        else:
            node["concurrency_buckets"][str(level)] = r
    return tree


def markdown_table(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """An aligned table; null is shown as 0."""
    cells = [[str(c) for c in columns], *[["0" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, widths)) + " |"
    return "\n".join([line(cells[0]), "| " + " | ".join("-" * w for w in widths) + " |", *map(line, cells[1:])])


def write_report(metrics: DataFrame, folder: str) -> None:
    """Summary.json, concurrency.csv and report.md of the metrics."""
    write_json(nested_summary(metrics), f"{folder}/summary.json")
    write_csv(metrics.filter("level is not null"), f"{folder}/concurrency.csv")
    columns = ["scenario", "server", "level", "count", "p50_ms", "p95_ms", "requests_per_sec", "error_rate"]
    rows = [[r[c] for c in columns] for r in small_rows(metrics.select(columns).orderBy("scenario", "server", "level"))]
    with open(f"{folder}/report.md", "w", encoding="utf-8") as f:
        f.write("# Requests\n\n" + markdown_table(columns, rows) + "\n")


def upserted(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new row of a key, else the stored one; of several new rows the greatest by all columns (same columns in both)."""
    columns = stored.columns
    both = stored.select(F.lit(0).alias("turn"), *columns).unionByName(new.select(F.lit(1).alias("turn"), *columns))
    others = [c for c in columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("turn", *others)).alias("r")).select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in columns])


def inserted(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows and the new ones of new keys (the least by all columns of each)."""
    columns = stored.columns
    others = [c for c in columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*others)).alias("r")).select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in columns])
    return stored.unionByName(first.join(stored.select(*keys), list(keys), "left_anti").select(columns))


def replace_days(rows: DataFrame, folder: str, day: str = "date") -> None:
    """The days in `rows` replace the stored ones, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(folder)


def file_name(c: Column) -> Column:
    """A name without characters that file systems don't take; 'challenge' if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(c, r'[\\/:*?"<>|\r\n]+', "_")), F.lit("")), F.lit("challenge"))
