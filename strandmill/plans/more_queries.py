"""Further operators of the inventory: lookups, samples, item building and helpers, each a thin query."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from strandmill.functions import text as t
from strandmill.operators import bank as b, sampling
from strandmill.operators.topk import top_per_group
from strandmill.plans import fragments as q
from strandmill.plans.bank_queries import _STATEMENT, rejected_topic_sql, results
from strandmill.plans.registry import Registry
from strandmill.plans.text_queries import FACETS
from strandmill.session import table

MORE = Registry()
MODELS, SUBJECTS = ("model-a", "model-b", "model-c"), ("首映", "乾燥樣本", "乾燥漁港", "none")
_DRAW = "md5(concat(item_key, '#', 7))"


def _items(spark, folder):
    return b.latest_items(table(spark, folder, "benchmark_items"))


def _draw(key: str):
    return F.md5(F.concat(F.col(key), F.lit("#7")))


@MORE.add("J03_items_by_model", f"WITH {q.ITEMS} SELECT item_key, model FROM items, (VALUES {', '.join(f'({m!r})' for m in MODELS)}) v(model)")
def j03(spark, folder):
    """Every item once for each model of a given list."""
    return _items(spark, folder).select("item_key", F.explode(F.array(*map(F.lit, MODELS))).alias("model"))


@MORE.add("J06_spot_checked_scores", f"WITH {q.RESULTS} SELECT id, item_key, model_key, score FROM results WHERE score IS NOT NULL ORDER BY md5(concat(id, '#', 7)), id LIMIT 5")
def j06(spark, folder):
    return results(spark, folder).filter("score is not null").select("id", "item_key", "model_key", "score").orderBy(_draw("id"), "id").limit(5)


@MORE.add("J07_answers_by_statement", f"WITH {q.RESULTS}, k AS (SELECT {_STATEMENT} AS statement, arg_max({q.json_text('reference_answer', 'answer')}, struct_pack(a := loaded_at, b := item_key)) AS answer FROM items GROUP BY 1), r AS (SELECT id, response_text, {_STATEMENT} AS statement FROM results) SELECT r.id, CASE WHEN upper({q.strip('r.response_text')}) = upper(k.answer) THEN 5 ELSE 1 END AS human_score FROM r JOIN k USING (statement)")
def j07(spark, folder):
    """Answers joined to questions by statement, the later question wins; U04: exact equality in capitals."""
    k = b.keep(_items(spark, folder).select(b.statement(F.col("reference_answer")).alias("statement"), t.json_text(F.col("reference_answer"), "answer").alias("answer"), "loaded_at", "item_key").filter("statement is not null"), ["statement"], [F.col("loaded_at"), F.col("item_key")], last=True).select("statement", "answer")
    r = results(spark, folder).select("id", "response_text", b.statement(F.col("reference_answer")).alias("statement"))
    return r.join(k, "statement").select("id", F.when(F.upper(t.strip(F.col("response_text"))) == F.upper("answer"), 5).otherwise(1).alias("human_score"))


@MORE.add("J11_questions_with_difficulty", f"WITH {q.RESULTS}, f AS (SELECT {_STATEMENT} AS statement, model_key, score, loaded_at, id FROM results QUALIFY {_STATEMENT} IS NOT NULL AND score IS NOT NULL AND row_number() OVER (PARTITION BY {_STATEMENT}, model_key, score IS NULL ORDER BY loaded_at, id) = 1), d AS (SELECT statement, count(*) FILTER (WHERE score >= 4) AS correct, count(*) AS total FROM f GROUP BY 1) SELECT i.item_key, coalesce(d.correct, 0) AS correct, coalesce(d.total, 0) AS total FROM (SELECT item_key, {_STATEMENT} AS statement FROM items) i LEFT JOIN d USING (statement) WHERE i.statement IS NOT NULL")
def j11(spark, folder):
    i = _items(spark, folder).select("item_key", b.statement(F.col("reference_answer")).alias("statement")).filter("statement is not null")
    d = b.difficulty(results(spark, folder), "p_values").select("statement", "correct", "total")
    return i.join(d, "statement", "left").select("item_key", F.coalesce("correct", F.lit(0)).alias("correct"), F.coalesce("total", F.lit(0)).alias("total"))


@MORE.add("A16_model_facet_matrix", f"WITH {q.RESULTS}, f AS (SELECT model_key AS model, valid, CASE {' '.join('WHEN ' + ' OR '.join(f'contains(title, {w!r})' for w in words) + f' THEN {label!r}' for label, words in FACETS.items())} ELSE 'culture' END AS facet FROM results) SELECT model, facet, round(avg(valid), 6) AS mean, count(valid) AS n FROM f GROUP BY 1, 2")
def a16(spark, folder):
    """An unknown facet counts as the first label."""
    facet = F.coalesce(*[F.when(t.strip(F.col("title")).rlike("|".join(words)), F.lit(label)) for label, words in FACETS.items()], F.lit("culture"))
    s = b.valid_score(F.col("score"))
    return results(spark, folder).groupBy(F.col("model_key").alias("model"), facet.alias("facet")).agg(F.round(F.avg(s), 6).alias("mean"), F.count(s).alias("n"))


@MORE.add("A19_subject_counts", f"WITH c AS (SELECT keyword, count(*) AS n FROM documents GROUP BY 1) SELECT s.subject, coalesce(n, 0) AS n FROM (VALUES {', '.join(f'({s!r})' for s in SUBJECTS)}) s(subject) LEFT JOIN c ON keyword = subject")
def a19(spark, folder):
    c = table(spark, folder, "documents").filter(F.col("keyword").isin(*SUBJECTS)).groupBy(F.col("keyword").alias("subject")).agg(F.count("*").alias("n"))
    return F.broadcast(spark.createDataFrame([(s,) for s in SUBJECTS], "subject string")).join(c, "subject", "left").fillna(0, ["n"])


@MORE.add("A22_next_order_number", "SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def a22(spark, folder):
    last = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("m"))
    return table(spark, folder, "customer").select("c_custkey").distinct().join(last, "c_custkey", "left").select("c_custkey", (F.coalesce("m", F.lit(0)) + 1).alias("next"))


@MORE.add("A38_judge_results", "SELECT lower(judge_model) AS judge, count(*) AS total, round(avg(score), 2) AS mean, count(*) FILTER (WHERE score IS NULL) AS n_null FROM judge_scores GROUP BY 1")
def a38(spark, folder):
    return table(spark, folder, "judge_scores").groupBy(F.lower("judge_model").alias("judge")).agg(F.count("*").alias("total"), F.round(F.avg("score"), 2).alias("mean"), F.count_if(F.col("score").isNull()).alias("n_null"))


@MORE.add("D02_first_pushes", "SELECT push_id, min(coalesce(content, '')) AS content FROM ptt_pushes GROUP BY 1")
def d02(spark, folder):
    return table(spark, folder, "ptt_pushes").groupBy("push_id").agg(F.min(F.coalesce("content", F.lit(""))).alias("content"))


@MORE.add("D03_filtered_then_first_articles", f"SELECT article_id, min(title) AS title FROM ptt_articles WHERE length({q.strip('content')}) >= 50 AND NOT regexp_matches(lower({q.strip('title')}), '^(re:|fw:|\\[公告\\]|公告)') GROUP BY 1")
def d03(spark, folder):
    """Rows count as seen only after all filters."""
    a = table(spark, folder, "ptt_articles").filter((F.length(t.strip(F.col("content"))) >= 50) & ~t.excluded_title(F.col("title")))
    return a.groupBy("article_id").agg(F.min("title").alias("title"))


@MORE.add("D13_distinct_urls", "SELECT DISTINCT url FROM ptt_articles WHERE url IS NOT NULL")
def d13(spark, folder):
    return table(spark, folder, "ptt_articles").select("url").filter("url is not null").distinct()


@MORE.add("F03_lookup", "SELECT DISTINCT doc_id, lang FROM documents WHERE doc_id = 17")
def f03(spark, folder):
    return table(spark, folder, "documents").filter("doc_id = 17").select("doc_id", "lang").distinct()


@MORE.add("F06_titles_containing", "SELECT doc_id FROM documents WHERE contains(lower(title), lower('Bakery')) OR contains(title, '夜市')")
def f06(spark, folder):
    return table(spark, folder, "documents").filter(F.contains(F.lower("title"), F.lower(F.lit("Bakery"))) | F.contains("title", F.lit("夜市"))).select("doc_id")


@MORE.add("F14_subject_filter", f"SELECT doc_id, keyword FROM documents WHERE keyword IN ({', '.join(map(repr, SUBJECTS))})")
def f14(spark, folder):
    return table(spark, folder, "documents").filter(F.col("keyword").isin(*SUBJECTS)).select("doc_id", "keyword")


@MORE.add("F16_rejected_topics", f"SELECT doc_id, {rejected_topic_sql('title', 'text')} AS rejected FROM documents WHERE title IS NOT NULL")
def f16(spark, folder):
    return table(spark, folder, "documents").filter("title is not null").select("doc_id", t.rejected_topic(F.col("title"), F.col("text")).alias("rejected"))


@MORE.add("F19_rows_by_index", f"WITH {q.ITEMS}, n AS (SELECT item_key, row_number() OVER (ORDER BY item_key) - 1 AS i FROM items) SELECT w.pos, n.item_key FROM (VALUES (0, 5), (1, 2), (2, 9), (3, 2)) w(pos, i) JOIN n USING (i)")
def f19(spark, folder):
    """Rows by places in key order, in the requested order."""
    wanted = spark.createDataFrame([(0, 5), (1, 2), (2, 9), (3, 2)], "pos int, i int")
    first = _items(spark, folder).select("item_key").orderBy("item_key").limit(10)
    numbered = first.withColumn("i", F.row_number().over(Window.partitionBy().orderBy("item_key")) - 1)
    return F.broadcast(wanted).join(numbered, "i").select("pos", "item_key")


@MORE.add("F21_preview", "SELECT DISTINCT doc_id, title FROM documents ORDER BY doc_id LIMIT 10")
def f21(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "title").distinct().orderBy("doc_id").limit(10)


@MORE.add("F25_long_enough", f"SELECT doc_id FROM documents WHERE length({q.strip('text')}) >= 50")
def f25(spark, folder):
    return table(spark, folder, "documents").filter(F.length(t.strip(F.col("text"))) >= 50).select("doc_id")


@MORE.add("R03_subject_sample", f"WITH s AS (SELECT doc_id, keyword, row_number() OVER (PARTITION BY keyword ORDER BY md5(concat(doc_id, '#', 7)), doc_id) AS place FROM documents WHERE keyword IN ({', '.join(map(repr, SUBJECTS))})) SELECT doc_id, keyword FROM s WHERE place <= 5")
def r03(spark, folder):
    """A fixed number a subject, without remainder or top-up."""
    d = table(spark, folder, "documents").filter(F.col("keyword").isin(*SUBJECTS)).select("doc_id", "keyword")
    return top_per_group(d, ["keyword"], [_draw("doc_id"), F.col("doc_id")], 5, "doc_id")


@MORE.add("R06_R08_question_pool", f"WITH {q.ITEMS} SELECT item_key FROM items ORDER BY {_DRAW}, item_key LIMIT 20")
def r06(spark, folder):
    return _items(spark, folder).select("item_key").orderBy(_draw("item_key"), "item_key").limit(20)


@MORE.add("R05_sample_with_replacement", f"WITH {q.ITEMS}, p AS (SELECT item_key, row_number() OVER (ORDER BY {_DRAW}, item_key) - 1 AS i, count(*) OVER () AS total FROM items) SELECT d.n, item_key FROM range(20) d(n) JOIN p ON i = CAST('0x' || substr(md5(d.n || '#7'), 1, 15) AS BIGINT) % total")
def r05(spark, folder):
    """More draws than rows: each draw takes one of all items, rows repeat."""
    return sampling.with_replacement(_items(spark, folder).select("item_key"), [_draw("item_key"), F.col("item_key")], 20, 7).select("n", "item_key")


@MORE.add("R04_balanced_sample", f"WITH {q.ITEMS}, p AS (SELECT item_key, source_category, md5(concat(item_key, '#', 0)) AS draw FROM items), l AS (SELECT source_category, row_number() OVER (ORDER BY min(item_key)) - 1 AS i, count(*) OVER () AS n FROM p GROUP BY 1), r AS (SELECT p.*, row_number() OVER (PARTITION BY p.source_category ORDER BY draw, item_key) AS place, 60 // n + CASE WHEN i < 60 % n THEN 1 ELSE 0 END AS quota FROM p JOIN l ON l.source_category IS NOT DISTINCT FROM p.source_category) SELECT item_key, source_category FROM r ORDER BY place <= quota DESC, draw, item_key LIMIT 60")
def r04(spark, folder):
    """Sixty items, evenly over all categories."""
    return sampling.balanced_sample(_items(spark, folder).select("item_key", "source_category"), "source_category", "item_key", 60)


# No SQL: every step of the greedy order depends on the row before; `tests/test_whole_results.py` compares with brute force.
@MORE.add("R07_diversified_articles")
def r07(spark, folder):
    """At most a tenth of n a title, titles in turn, neighbours of different titles and statements."""
    n = 40
    cap = max(1, n // 10)
    i = _items(spark, folder).select("item_key", "title", F.coalesce(F.nullif("title", F.lit("")), F.lit("__unknown__")).alias("bucket"), F.substring(F.coalesce(b.statement(F.col("reference_answer")), F.lit("")), 1, 3).alias("prefix"))
    few = top_per_group(i, ["bucket"], [_draw("item_key"), F.col("item_key")], cap, "item_key")
    bucket = Window.partitionBy("bucket").orderBy(_draw("item_key"), "item_key")
    # Titles follow each other by their first items' draws in every turn.
    turns = few.withColumn("turn", F.row_number().over(bucket)).withColumn("first_key", F.first("item_key").over(bucket))
    pool = turns.orderBy("turn", _draw("first_key"), "first_key").limit(n)
    rows = [(r.item_key, r.title, r.turn) for r in sampling.declustered(pool.collect())]
    return spark.createDataFrame(rows, "item_key string, title string, turn int").coalesce(1)


@MORE.add("U11_prompts_of_templates", f"WITH {q.ITEMS} SELECT item_key, CASE lower(task_type) WHEN 'qa' THEN '請回答：' || prompt WHEN 'true_false' THEN '判斷對錯：' || prompt ELSE '任務：' || prompt END AS filled FROM items")
def u11(spark, folder):
    templates = spark.createDataFrame([("qa", "請回答：{x}"), ("true_false", "判斷對錯：{x}")], "task_type string, template string")
    i = _items(spark, folder).select("item_key", F.lower("task_type").alias("task_type"), "prompt")
    return i.join(F.broadcast(templates), "task_type", "left").select("item_key", F.replace(F.coalesce("template", F.lit("任務：{x}")), F.lit("{x}"), F.col("prompt")).alias("filled"))


@MORE.add("U13_mock_adapter", "SELECT doc_id, length(text) // 4 AS input_tokens, 5 + doc_id % 21 AS output_tokens FROM documents WHERE text IS NOT NULL")
def u13(spark, folder):
    d = table(spark, folder, "documents").filter("text is not null")
    return d.select("doc_id", F.floor(F.length("text") / 4).alias("input_tokens"), (F.col("doc_id") % 21 + 5).alias("output_tokens"))


@MORE.add("MP1_choices_rendered", f"WITH {q.ITEMS} SELECT item_key, coalesce(array_to_string(list_sort(list_transform(regexp_extract_all(prompt, '\\(([A-D])\\) ([^\\n(]+)'), lambda x: {q.strip('x')})), chr(10)), '') AS choices FROM items WHERE lower(task_type) = 'school_qa'")
def mp1(spark, folder):
    """Choices of multiple-choice prompts, by letter, as one text."""
    lines = F.regexp_extract_all("prompt", F.lit(r"\(([A-D])\) ([^\n(]+)"), F.lit(0))
    return _items(spark, folder).filter("lower(task_type) = 'school_qa'").select("item_key", F.array_join(F.array_sort(F.transform(lines, t.strip)), "\n").alias("choices"))


@MORE.add("X25_sparklines", "WITH d AS (SELECT board AS topic, month(posted_at) AS m, count(*) AS n FROM (SELECT DISTINCT article_id, board, posted_at FROM ptt_articles) WHERE posted_at IS NOT NULL GROUP BY 1, 2), a AS (SELECT topic, list(n ORDER BY m) AS v FROM d GROUP BY 1) SELECT topic, list_aggregate(list_transform(v, lambda x: substr('▁▂▃▄▅▆▇█', 1 + (x * 7 // greatest(list_max(v), 1))::INT, 1)), 'string_agg', '') AS line FROM a")
def x25(spark, folder):
    d = table(spark, folder, "ptt_articles").select("article_id", "board", "posted_at").distinct().filter("posted_at is not null").groupBy(F.col("board").alias("topic"), F.month("posted_at").alias("m")).agg(F.count("*").alias("n"))
    v = d.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "n"))), lambda x: x["n"]).alias("v"))
    return v.select("topic", t.sparkline(F.col("v")).alias("line"))


@MORE.add("M15_non_blank_lines", f"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: {q.strip('x')} <> '')) AS n_lines FROM documents WHERE text IS NOT NULL")
def m15(spark, folder):
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: t.strip(x) != "")).alias("n_lines"))


@MORE.add("M16_partial_update", "SELECT DISTINCT id, CASE WHEN status = 'failed' THEN 'retried' ELSE status END AS status FROM qual_runs")
def m16(spark, folder):
    """Only values that are there overwrite."""
    runs = table(spark, folder, "qual_runs").select("id", "status").distinct()
    new = runs.filter("status = 'failed'").select("id", F.lit("retried").alias("new_status"))
    return runs.join(new, "id", "left").select("id", F.coalesce("new_status", "status").alias("status"))


@MORE.add("M11_topics_of_busiest_day", "WITH d AS (SELECT CAST(posted_at AS DATE) AS date, board, count(*) AS n FROM (SELECT DISTINCT article_id, board, posted_at FROM ptt_articles) WHERE posted_at IS NOT NULL GROUP BY 1, 2), b AS (SELECT date FROM d GROUP BY 1 ORDER BY sum(n) DESC, date LIMIT 1) SELECT board, n FROM d WHERE date IN (SELECT date FROM b)")
def m11(spark, folder):
    d = table(spark, folder, "ptt_articles").select("article_id", "board", "posted_at").distinct().filter("posted_at is not null").groupBy(F.col("posted_at").cast("date").alias("date"), "board").agg(F.count("*").alias("n"))
    busiest = d.groupBy("date").agg(F.sum("n").alias("s")).orderBy(F.col("s").desc(), "date").limit(1)
    return d.join(F.broadcast(busiest.select("date")), "date", "left_semi").select("board", "n")


@MORE.add("O02_run_history", "SELECT DISTINCT id, created_at, status FROM qual_runs ORDER BY created_at DESC, id")
def o02(spark, folder):
    return table(spark, folder, "qual_runs").select("id", "created_at", "status").distinct().orderBy(F.col("created_at").desc(), "id")


@MORE.add("O09_first_details", f"WITH {q.RESULTS} SELECT id, model_key, task_type, score FROM results ORDER BY id LIMIT 10")
def o09(spark, folder):
    """A report's first ten details, in order."""
    return results(spark, folder).select("id", "model_key", "task_type", "score").orderBy("id").limit(10)


@MORE.add("O10_models_by_count", f"WITH {q.RESULTS} SELECT model_key AS model, count(*) AS n, max(finished_at) AS latest FROM results GROUP BY 1 ORDER BY n DESC, model")
def o10(spark, folder):
    return results(spark, folder).groupBy(F.col("model_key").alias("model")).agg(F.count("*").alias("n"), F.max("finished_at").alias("latest")).orderBy(F.col("n").desc(), "model")


@MORE.add("O11_articles_of_a_day", "SELECT DISTINCT article_id, comment_count FROM tds_articles WHERE date = '2024-03-05' ORDER BY comment_count DESC NULLS LAST, article_id")
def o11(spark, folder):
    a = table(spark, folder, "tds_articles").filter("date = '2024-03-05'").select("article_id", "comment_count").distinct()
    return a.orderBy(F.col("comment_count").desc_nulls_last(), "article_id")


@MORE.add("S21_articles_of_a_week", "SELECT DISTINCT article_id, date, comment_count FROM tds_articles WHERE date BETWEEN '2024-02-26' AND '2024-03-03' ORDER BY comment_count DESC NULLS LAST, article_id, date LIMIT 50")
def s21(spark, folder):
    """The top fifty of a week that spans two months; the range reaches the scan."""
    a = table(spark, folder, "tds_articles").filter(F.col("date").between("2024-02-26", "2024-03-03")).select("article_id", "date", "comment_count").distinct()
    return a.orderBy(F.col("comment_count").desc_nulls_last(), "article_id", "date").limit(50)


@MORE.add("M10_date_keys", "SELECT DISTINCT article_id, coalesce(strftime(posted_at, '%Y%m'), '') AS month, coalesce(strftime(posted_at, '%Y-%m-%d'), '') AS date FROM ptt_articles")
def m10(spark, folder):
    own = table(spark, folder, "ptt_articles")
    return own.select("article_id", F.coalesce(F.date_format("posted_at", "yyyyMM"), F.lit("")).alias("month"), F.coalesce(F.date_format("posted_at", "yyyy-MM-dd"), F.lit("")).alias("date")).distinct()


@MORE.add("M19_items_by_type", f"WITH {q.ITEMS} SELECT lower(task_type) AS task_type, count(*) AS n FROM items GROUP BY 1")
def m19(spark, folder):
    return _items(spark, folder).groupBy(F.lower("task_type").alias("task_type")).agg(F.count("*").alias("n"))


@MORE.add("X22_M22_label_lists", f"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(title, '[,，\\n]'), lambda x: {q.strip('x')}), lambda x: x <> '')[1] AS first_label FROM documents WHERE title IS NOT NULL")
def x22(spark, folder):
    """The first label of a list between commas."""
    d = table(spark, folder, "documents").filter("title is not null")
    return d.select("doc_id", F.get(t.label_list(F.col("title")), F.lit(0)).alias("first_label"))


@MORE.add("K11_benchmark_export", "SELECT scenario, server, concurrency_level, count(*) AS requests, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens FROM request_records GROUP BY 1, 2, 3")
def k11(spark, folder):
    """Rows of the export; nulls are 0. `sinks` write them as CSV, JSON or a Markdown table."""
    r = table(spark, folder, "request_records")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return r.groupBy("scenario", "server", "concurrency_level").agg(F.count("*").alias("requests"), total("output_tokens"), total("input_tokens"))
