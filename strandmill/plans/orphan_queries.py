"""Orphan references of the question bank's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.operators.orphans import Parent, Reference, find_orphans, orphan_report
from strandmill.plans.registry import Registry
from strandmill.session import table

ORPHANS = Registry()

# White space as Unicode has it; fixed values.
_BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"


def _norm(c: str) -> str:
    return f"lower(trim({c}, {_BLANKS}))"


def _refs(name: str, column: str, parent: str) -> str:
    return f"""SELECT '{name}' AS table_name, '{parent}' AS parent_name, id AS record_id, {_norm(column)} AS k, min(loaded_at) OVER (PARTITION BY id) AS first_at FROM {name} WHERE id IS NOT NULL"""


_ORPHANS_SQL = f"""
WITH refs AS (
  {_refs('benchmark_items', 'run_id', 'qual_runs')} UNION ALL
  {_refs('llm_responses', 'benchmark_item_id', 'benchmark_items')} UNION ALL
  {_refs('judge_scores', 'benchmark_item_id', 'benchmark_items')}
), parents AS (
  SELECT 'qual_runs' AS parent_name, {_norm('id')} AS k, min(loaded_at) AS parent_at FROM qual_runs GROUP BY 1, 2 UNION ALL
  SELECT 'benchmark_items', {_norm('id')}, min(loaded_at) FROM benchmark_items GROUP BY 1, 2
), gone AS (
  SELECT DISTINCT table_name AS parent_name, {_norm('deleted_id')} AS k FROM deleted_keys
), judged AS (
  SELECT r.table_name, r.record_id, r.k, r.first_at,
         CASE WHEN p.k IS NOT NULL AND p.parent_at > r.first_at THEN 'late' WHEN p.k IS NOT NULL THEN NULL WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS orphan_kind
  FROM refs r LEFT JOIN parents p ON p.parent_name = r.parent_name AND p.k = r.k LEFT JOIN gone g ON g.parent_name = r.parent_name AND g.k = r.k
  WHERE r.k IS NOT NULL AND r.k <> ''
)
"""


def bank_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans of items' runs, and of responses' and scores' items."""
    runs, items, deleted = (table(spark, folder, t) for t in ("qual_runs", "benchmark_items", "deleted_keys"))
    references = [
        Reference("benchmark_items", items, "run_id", "qual_runs"),
        Reference("llm_responses", table(spark, folder, "llm_responses"), "benchmark_item_id", "benchmark_items"),
        Reference("judge_scores", table(spark, folder, "judge_scores"), "benchmark_item_id", "benchmark_items"),
    ]
    return find_orphans(references, [Parent("qual_runs", runs), Parent("benchmark_items", items)], deleted)


@ORPHANS.add("p5_found", _ORPHANS_SQL + "SELECT DISTINCT table_name, record_id, orphan_kind FROM judged WHERE orphan_kind IS NOT NULL")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return bank_orphans(spark, folder).select("table_name", "record_id", "orphan_kind").distinct()


@ORPHANS.add("p5_orphans_by_month", _ORPHANS_SQL + "SELECT table_name, strftime(first_at, '%Y-%m') AS month, orphan_kind, count(DISTINCT record_id) AS n_records, count(DISTINCT k) AS n_keys FROM judged WHERE orphan_kind IS NOT NULL GROUP BY 1, 2, 3")
def p5_orphans_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(bank_orphans(spark, folder))
