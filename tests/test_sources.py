import json

from strandmill.operators.metrics import request_metrics
from strandmill.sources import parsers, readers, sinks
from strandmill.streaming.requests import hourly_requests, store_days
from pyspark.sql import functions as F

PAPER = """一、選擇題
1. （ ）下列何者正確？
(A) 甲 (B) 乙
(C) 丙 (D) 丁
◎閱讀下列短文，山上有一座很老很老的廟，廟裡有一個很老的鐘。
2. 根據上文，鐘在哪裡？
（Ａ）山上
（Ｂ）海邊
（Ｃ）城裡
- 10 -
3. 沒有選項
1. 重複的題號 (A) x (B) y (C) z
二、問答題
4. 不算 (A) a (B) b (C) c
"""


def test_exam_questions():
    found = parsers.questions(PAPER)
    assert [q["number"] for q in found] == [1, 2] and found[0]["choices"] == {"A": "甲", "B": "乙", "C": "丙", "D": "丁"}
    assert found[1]["question"].startswith("◎閱讀") and found[1]["choices"] == {"A": "山上", "B": "海邊", "C": "城裡"}
    assert parsers.questions(None) == parsers.questions("") == []


def test_answer_key_formats():
    assert parsers.answer_key("題號 1 2 3\n答案 A ｂ C") == {1: "A", 2: "B", 3: "C"}
    assert parsers.answer_key("11. B 12. Ａ") == {11: "B", 12: "A"}
    assert parsers.answer_key("1 B  2 A") == {1: "B", 2: "A"}
    assert parsers.answer_key("A B C D A") == {1: "A", 2: "B", 3: "C", 4: "D", 5: "A"}
    assert parsers.answer_key("1\nC\n21\nD\n41\nA\n2\nB\n3\nB") == {1: "C", 21: "D", 41: "A", 2: "B", 3: "B"}
    assert parsers.answer_key("1\nC") == parsers.answer_key(None) == {}


def test_exam_questions_with_answers(spark):
    rows = spark.createDataFrame([("p", PAPER, "1. C"), ("q", None, None)], "k string, paper string, answers string")
    assert [(r.k, r.number, r.answer) for r in parsers.exam_questions(rows, "k", "paper", "answers").orderBy("number").collect()] == [("p", 1, "C"), ("p", 2, "")]


def test_pages():
    board = '<div class="r-ent"><div class="nrec"><span>12</span></div><div class="title"><a href="/a.html"> 標題 </a></div><div class="meta"><div class="author">me</div><div class="date">1/02</div></div></div><div class="r-ent"><div class="nrec"></div><div class="title">(已刪除)</div></div>'
    assert parsers.board_index(board)[0] == {"title": "標題", "href": "/a.html", "author": "me", "date": "1/02", "pushes": "12"}
    page = '<div id="main-content" class="main-content"><div class="article-metaline"><span class="article-meta-tag">作者</span><span class="article-meta-value">me</span></div>正文 &amp; 內容\n--\n簽名<div class="push"><span class="push-tag">推 </span><span class="push-userid">u</span><span class="push-content">: 好</span></div></div>'
    found = parsers.article(page)
    assert found == {"metas": ["me"], "body": "正文 & 內容", "pushes": [{"tag": "推", "user": "u", "content": "好"}]}
    assert parsers.links('<a href="x.pdf"> A\n b</a><a href="x.pdf">c</a>') == [("x.pdf", "A b")] and parsers.article(None) is None


def test_jsonl_readers(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"role":"system","content":"s"}\n\n plain line \n{"broken\n', encoding="utf-8")
    assert [(r.role, r.content) for r in readers.prompts(spark, str(tmp_path / "p.jsonl")).collect()] == [("system", "s"), ("user", "plain line"), ("user", '{"broken')]
    (tmp_path / "c.jsonl").write_text('{"text":"t u"}\nbad\n{"content":"c","title":"T"}\n{"text":" "}\n', encoding="utf-8")
    assert [(r.text, r.title) for r in readers.challenge_rows(spark, str(tmp_path / "c.jsonl")).collect()] == [("t u", "t u"), ("c", "T")]


def test_threads(spark, tmp_path):
    posts = [{"id": "1", "text": "hello", "timestamp": 0, "username": "u", "like_count": None, "replies": [{"id": "9", "text": "self", "username": "u"}, {"id": "8", "text": "other", "username": "v"}]}, {"id": "1", "text": "again", "username": "u"}, {"text": "😀", "username": "u"}, {"text": "no id", "timestamp": 1704067200}]
    (tmp_path / "a.json").write_text(json.dumps(posts), encoding="utf-8")
    found = {r.id: (r.title, r.date, r.content) for r in readers.threads(spark, str(tmp_path)).collect()}
    assert set(found) == {"1", ""} and found["1"][:2] == ("hello", None) and "1. other" in found["1"][2] and "self" not in found["1"][2] and found[""][1] == "20240101"


def test_other_readers(spark, tmp_path):
    (tmp_path / "History").mkdir()
    (tmp_path / "History" / "Old.md").write_text("---\na: 1\n---\n" + "x" * 60)
    (tmp_path / "History" / "Short.md").write_text("x")
    assert [(r.category, r.title) for r in readers.markdown_folder(spark, str(tmp_path)).collect()] == [("History", "Old")]
    (tmp_path / "m.csv").write_text("source_page,file_url,label,file_type,school,subject,grade,term\np,u,l,PDF,s,x,1,2\np,v,l,doc,s,x,1,2\n")
    assert readers.manifest(spark, str(tmp_path / "m.csv")).count() == 1
    (tmp_path / "a.csv").write_text("﻿#,陳述句,TRUE / FALSE\n1.0,s,TRUE\n,,\n", encoding="utf-8")
    assert [tuple(r) for r in readers.answer_sheet(spark, str(tmp_path / "a.csv")).collect()] == [(1, "s", "TRUE")]
    payload = 'event: x\ndata: {"results": []}\ndata: {"results": [{"title": "t", "content": null}, {"title": "", "content": ""}]}\n'
    assert [d.title for d in spark.createDataFrame([(payload,)], "p string").select(readers.search_payload(F.col("p")).alias("d")).first().d] == ["t"]
    summary = json.dumps({"scenarios": {"chat": {"s": {"concurrency_buckets": {"1": {"p50_ms": 5}, "2": {}}}}}})
    found = readers.unnested_summary(spark.createDataFrame([(summary,)], "summary string")).collect()
    assert [(r.level, r.tokens_per_sec_output, r.p50_ms, r.p95_ms) for r in found] == [(1, 0.0, 5.0, None)]


def test_sinks(spark, tmp_path):
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 5), ("b", 7), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, sinks.upserted(stored, new, ["k"]).collect())) == [("a", 1), ("b", 7), ("c", 2)]
    assert sorted(map(tuple, sinks.inserted(stored, new, ["k"]).collect())) == [("a", 1), ("b", 1), ("c", 2)]
    sinks.write_csv(stored.limit(0), str(tmp_path / "e.csv"))
    assert (tmp_path / "e.csv").read_text().strip() == "k,v"
    days = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, v int")
    sinks.replace_days(days, str(tmp_path / "d"))
    sinks.replace_days(spark.createDataFrame([("2024-01-02", 9)], "date string, v int"), str(tmp_path / "d"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [1, 9]
    assert [r.n for r in spark.createDataFrame([("a/b?",), (" ",), (None,)], "c string").select(sinks.file_name(F.col("c")).alias("n")).collect()] == ["a_b_", "challenge", "challenge"]


def test_report_and_stream(spark, folder, tmp_path):
    rows = spark.read.parquet(f"{folder}/request_records.parquet")
    sinks.write_report(request_metrics(rows), str(tmp_path / "r"))
    tree = json.loads((tmp_path / "r" / "summary.json").read_text())
    assert all("count" in s and s["concurrency_buckets"] for x in tree["scenarios"].values() for s in x.values()) and "| scenario" in (tmp_path / "r" / "report.md").read_text()
    sinks.write_requests(rows, str(tmp_path / "w"))
    assert readers.request_records(spark, str(tmp_path / "w")).count() == rows.count()
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/request_records.parquet*")
    q = hourly_requests(stream, "400 days").writeStream.outputMode("update").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = ["server", "hour"]
    streamed = {(r.server, r.hour): r.n for r in spark.table("hours").groupBy(*key).agg(F.max("n").alias("n")).collect()}
    assert streamed == {(r.server, r.hour): r.n for r in hourly_requests(rows).collect()}
    (tmp_path / "in").mkdir()
    days = spark.readStream.schema("date string, v int").json(str(tmp_path / "in"))
    (tmp_path / "in" / "a.json").write_text('{"date": "2024-01-01", "v": 3}\n')
    store_days(days, str(tmp_path / "days"), str(tmp_path / "c2")).awaitTermination(120)
    assert [r.v for r in spark.read.parquet(str(tmp_path / "days")).collect()] == [3]
