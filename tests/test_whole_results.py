"""Whole results of queries whose SQL holds a cut, against brute force."""

import re
from hashlib import md5

import pytest
from pyspark.sql import Row, functions as F

from strandmill.operators import bank as b, sampling
from strandmill.plans import bank_queries, more_queries


def truth(task, reference, response, error):
    """U01 in plain Python, for a reference answer that was read already."""
    right = (reference or "").strip().upper()
    if task != "true_false" or right not in ("TRUE", "FALSE"):
        return None
    found = re.search(r"\b(TRUE|FALSE)\b", (response or error or "").strip().upper())
    return 5 if found and found.group(1) == right else 1


def test_true_false_scores_keep_every_response(spark, folder):
    rows = bank_queries.results(spark, folder).select("id", "task_type", b.json_text(F.col("reference_answer"), "answer").alias("a"), "response_text", "error").collect()
    found = {r.id: r.rule_score for r in bank_queries.u01(spark, folder).collect()}
    assert found == {r.id: truth(r.task_type, r.a, r.response_text, r.error) for r in rows}


def test_word_boundaries_of_other_scripts(spark):
    texts = ["TRUE。因為", "因此為 FALSE。", "答案是TRUE", "TRUE‍", "TRUE️", "TRUE②", "「true」", "TRUEé FALSE", "false_ TRUE", "TRUE1"]
    df = spark.createDataFrame([(i, "true_false", '{"answer": "TRUE"}', t, None) for i, t in enumerate(texts)], "i int, t string, r string, a string, e string")
    found = df.select("a", b.rule_score_true_false(*[F.col(c) for c in "trae"]).alias("s")).collect()
    assert [r.s for r in found] == [truth("true_false", "TRUE", r.a, None) for r in found]


def draw(key):
    return md5(f"{key}#7".encode()).hexdigest(), key


def test_draws_come_from_all_items(spark, folder):
    pool = sorted((r.item_key for r in more_queries._items(spark, folder).collect()), key=draw)
    found = sorted((r.n, r.item_key) for r in more_queries.r05(spark, folder).collect())
    assert found == [(n, pool[int(md5(f"{n}#7".encode()).hexdigest()[:15], 16) % len(pool)]) for n in range(20)]
    assert len({k for _, k in found}) > 4


def test_few_rows_are_drawn_again_and_none_is_an_error(spark):
    rows = spark.range(3)
    found = sampling.with_replacement(rows, [F.col("id")], 50).collect()
    assert sorted(r.n for r in found) == list(range(50)) and {r.id for r in found} == {0, 1, 2}
    with pytest.raises(ValueError):
        sampling.with_replacement(rows.limit(0), [F.col("id")], 5)


def test_numbers_follow_the_order_over_partitions(spark):
    found, total = sampling.numbered(spark.range(1000).repartition(7), [F.col("id").desc()])
    assert total == 1000 and sorted((r.i, r.id) for r in found.collect()) == [(i, 999 - i) for i in range(1000)]


def articles(rows, n):
    """R07 in plain Python: rows of (key, title, prefix)."""
    titles = {}
    for r in sorted(rows, key=lambda r: draw(r[0])):
        titles.setdefault(r[1] or "__unknown__", []).append(r)
    groups = sorted((g[: max(1, n // 10)] for g in titles.values()), key=lambda g: draw(g[0][0]))
    pool = [(*g[t], t + 1) for t in range(max(1, n // 10)) for g in groups if t < len(g)][:n]
    out, last = [], ("", "")
    while pool:
        for test in (lambda r: r[1] != last[0] and r[2] != last[1], lambda r: r[2] != last[1], lambda r: r[1] != last[0], lambda r: True):
            if fit := next((r for r in pool if test(r)), None):
                break
        pool.remove(fit)
        out.append((fit[0], fit[1], fit[3]))
        last = fit[1], fit[2]
    return out


def test_articles_have_a_tenth_a_title_and_are_declustered(spark, folder, monkeypatch):
    few = [(f"k{i}", ("a", "b", "c", None)[i % 4], f'{{"statement": "{"xxxxyzw"[i % 7]}bcd{i}"}}' if i % 5 else "no JSON") for i in range(60)]
    schema = "item_key string, title string, reference_answer string"
    monkeypatch.setattr(more_queries, "_items", lambda *_: spark.createDataFrame(few, schema))
    found = [tuple(r) for r in more_queries.r07(spark, folder).collect()]
    assert len(found) == 16 and found == articles([(k, t, f"{a[15]}bc" if a[0] == "{" else "") for k, t, a in few], 40)


def test_articles_of_the_tables(spark, folder):
    rows = [tuple(r) for r in more_queries._items(spark, folder).select("item_key", "title", F.substring(F.coalesce(b.statement(F.col("reference_answer")), F.lit("")), 1, 3)).collect()]
    assert [tuple(r) for r in more_queries.r07(spark, folder).collect()] == articles(rows, 40)


def test_no_neighbours_of_a_kind_where_others_are_left():
    rows = [Row(title=t, prefix=p) for t, p in (("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"))]
    assert [(r.title, r.prefix) for r in sampling.declustered(rows)] == [("a", "x"), ("b", "y"), ("b", "x"), ("a", "y")]
