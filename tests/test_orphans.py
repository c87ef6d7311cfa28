from datetime import datetime

import pytest

from strandmill.operators.orphans import Parent, Reference, find_orphans, orphan_report

T = [datetime(2024, 1, d) for d in range(1, 29)]
REF = "id string, run_id string, loaded_at timestamp_ntz, table_name string, digest long"
PARENT = "id string, loaded_at timestamp_ntz, state int"
GONE = "table_name string, deleted_id string"


def run(spark, refs, parents, gone=(), **options):
    rows = spark.createDataFrame([(*r, "x", 1) for r in refs], REF)
    found = find_orphans([Reference("items", rows, "run_id", "runs")], [Parent("runs", spark.createDataFrame([(*p, 0) for p in parents], PARENT))], spark.createDataFrame(list(gone), GONE), **options)
    return found, sorted((r.record_id, r.orphan_kind) for r in found.collect())


def test_kinds_blanks_case_and_deliveries(spark):
    refs = [("a", " R1\n", T[5]), ("b", "r2", T[5]), ("c", "r3", T[5]), ("d", None, T[5]), ("e", " \t", T[5]), ("f", "R9", T[5]), ("g", "r2", T[1]), ("g", "r2", T[9]), (None, "r9", T[5]), ("f", "R9", T[5])]
    parents = [("r1", T[1]), ("R2 ", T[7]), ("r2", T[8]), (None, T[1]), (" ", T[1])]
    _, found = run(spark, refs, parents, [("runs", "R3"), ("runs", "r1"), ("other", "r9")])
    assert found == [("b", "late"), ("c", "deleted"), ("f", "missing"), ("g", "late")]


def test_null_times_are_never_late(spark):
    _, found = run(spark, [("a", "r1", None), ("b", "r2", T[3])], [("r1", T[5]), ("r2", None), ("r2", T[9])])
    assert found == []


@pytest.mark.parametrize("refs,parents", [([], [("r1", T[1])]), ([], []), ([("a", "r1", T[1])], [])])
def test_empty_tables(spark, refs, parents):
    _, found = run(spark, refs, parents)
    assert found == [(r[0], "missing") for r in refs]


def test_ranges_and_salted_hot_key_agree_with_plain_lookup(spark):
    refs = [(f"i{i}", "hot" if i % 3 == 0 else f"r{i % 97}", T[i % 20]) for i in range(3000)]
    parents = [(f"r{i}", T[i % 25]) for i in range(60)] + [("hot", T[10])]
    first = {k.lower(): t for k, t in parents}
    expected = sorted((i, "missing" if k not in first else "late") for i, k, t in refs if k not in first or first[k] > t)
    _, found = run(spark, refs, parents, keys_per_range=10, references_per_probe=50)
    assert found == expected


def test_report(spark):
    found, _ = run(spark, [("a", "x", T[1]), ("b", "x", T[2]), ("c", "y", None)], [("r1", T[1])])
    assert sorted((r.month, r.n_records, r.n_keys) for r in orphan_report(found).collect()) == [("", 1, 1), ("2024-01", 2, 1)]
