"""Queries over items, responses and scores."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from strandmill.functions import text as t
from strandmill.functions.keys import comparable_key
from strandmill.functions.text import iso_time, json_text, strip, unfenced
from strandmill.operators import bank as b
from strandmill.plans import fragments as q
from strandmill.plans.registry import Registry
from strandmill.session import table

BANK = Registry()


def results(spark, folder):
    return b.result_rows(*(table(spark, folder, n) for n in ("benchmark_items", "llm_responses", "judge_scores")))


@BANK.add("J02_result_rows", f"WITH {q.RESULTS} SELECT id, item_key, model_key, task_type, title, response_text, error, score FROM results")
def j02(spark, folder):
    return results(spark, folder).select("id", "item_key", "model_key", "task_type", "title", "response_text", "error", "score")


@BANK.add("J01_scores_with_task", f"WITH {q.ITEMS}, {q.SCORES} SELECT s.id, s.model_key, coalesce(lower(i.task_type), 'unknown') AS task_type, s.score FROM scores s LEFT JOIN items i USING (item_key)")
def j01(spark, folder):
    s, i = b.latest_scores(table(spark, folder, "judge_scores")), b.latest_items(table(spark, folder, "benchmark_items")).select("item_key", "task_type")
    return s.join(i, "item_key", "left").select("id", "model_key", F.coalesce(F.lower("task_type"), F.lit("unknown")).alias("task_type"), "score")


@BANK.add("J04_responses_without_item", f"WITH {q.RESPONSES} SELECT id FROM responses WHERE item_key IS NOT NULL AND item_key NOT IN (SELECT {q.norm('id')} FROM benchmark_items)")
def j04(spark, folder):
    r = b.latest_responses(table(spark, folder, "llm_responses")).filter("item_key is not null")
    return r.join(table(spark, folder, "benchmark_items").select(comparable_key("id").alias("item_key")), "item_key", "left_anti").select("id")


@BANK.add("J05_missing_pairs", f"WITH {q.ITEMS}, {q.RESPONSES}, pairs AS (SELECT i.item_key, m.model_key FROM items i, (SELECT DISTINCT model_key FROM responses) m) SELECT model_key, count(*) AS n FROM (SELECT item_key, model_key FROM pairs EXCEPT SELECT item_key, model_key FROM responses) GROUP BY 1")
def j05(spark, folder):
    """Items without a response, by model: all items less those answered, so that no product of items and models is made."""
    items = table(spark, folder, "benchmark_items").select(comparable_key("id").alias("item_key")).distinct()
    r = b.latest_responses(table(spark, folder, "llm_responses")).select("item_key", F.lower("model_name").alias("model_key"))
    total = items.agg(F.count("*").alias("total"))
    done = r.distinct().join(items.withColumn("there", F.lit(1)), "item_key", "left").groupBy("model_key").agg(F.count("there").alias("done"))
    return done.crossJoin(F.broadcast(total)).select("model_key", (F.col("total") - F.col("done")).alias("n")).filter("n > 0")


@BANK.add("J08_items_by_position", f"WITH {q.ITEMS}, o AS (SELECT item_key, row_number() OVER (PARTITION BY lower(task_type) ORDER BY loaded_at, item_key) AS place, lower(task_type) AS task_type FROM items) SELECT task_type, place, item_key FROM o WHERE place IN (1, 3, 7)")
def j08(spark, folder):
    from strandmill.operators.topk import top_per_group

    i = b.latest_items(table(spark, folder, "benchmark_items")).select("item_key", F.lower("task_type").alias("task_type"), "loaded_at")
    few = top_per_group(i, ["task_type"], [F.col("loaded_at"), F.col("item_key")], 7, "item_key")
    return few.withColumn("place", F.row_number().over(Window.partitionBy("task_type").orderBy("loaded_at", "item_key"))).filter(F.col("place").isin(1, 3, 7)).select("task_type", "place", "item_key")


@BANK.add("J12_unanswered_items", f"WITH {q.RESULTS}, m AS (SELECT min(model_key) AS model_key FROM results), done AS (SELECT DISTINCT prompt, reference_answer FROM results JOIN m USING (model_key) WHERE coalesce(error, '') = '' AND {q.strip('response_text')} <> '') SELECT min(item_key) AS item_key FROM items i WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.prompt IS NOT DISTINCT FROM i.prompt AND d.reference_answer IS NOT DISTINCT FROM i.reference_answer) GROUP BY prompt, reference_answer")
def j12(spark, folder):
    """Questions (prompt and reference answer) that one model, here the first by name, hasn't answered; its failed answers don't count."""
    rows = results(spark, folder)
    model = F.broadcast(rows.agg(F.min("model_key").alias("model_key")))
    key = F.struct("prompt", "reference_answer").alias("question")
    done = rows.join(model, "model_key").filter((F.coalesce(F.col("error"), F.lit("")) == "") & (strip(F.col("response_text")) != "")).select(key)
    questions = b.latest_items(table(spark, folder, "benchmark_items")).groupBy(key).agg(F.min("item_key").alias("item_key"))
    return questions.join(done, "question", "left_anti").select("item_key")


@BANK.add("J14_runs_with_items", f"SELECT r.id AS run_id, count(DISTINCT {q.norm('i.id')}) AS n_items, min(lower(i.task_type)) AS first_task FROM (SELECT DISTINCT id FROM qual_runs) r JOIN benchmark_items i ON {q.norm('i.run_id')} = {q.norm('r.id')} GROUP BY 1")
def j14(spark, folder):
    runs = table(spark, folder, "qual_runs").select(F.col("id").alias("run_id")).distinct().withColumn("k", comparable_key("run_id"))
    items = table(spark, folder, "benchmark_items").select(comparable_key("run_id").alias("k"), comparable_key("id").alias("item_key"), F.lower("task_type").alias("task_type"))
    return runs.join(items, "k").groupBy("run_id").agg(F.count_distinct("item_key").alias("n_items"), F.min("task_type").alias("first_task"))


# A word's neighbours as the Spark side has them: no letter, digit or underscore of any script.
_SAID = "upper(coalesce(nullif(response_text, ''), error, ''))"
_TRUTH = f"regexp_extract({_SAID}, '(?:^|[^\\p{{L}}\\p{{N}}_])(TRUE|FALSE)(?:$|[^\\p{{L}}\\p{{N}}_])', 1)"
_OUTSIDE = "[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]"
_OPTION = f"upper(regexp_extract(coalesce(nullif(response_text, ''), error, ''), '(?:^|{_OUTSIDE})([A-Da-d])(?:$|{_OUTSIDE})', 1))"
_RIGHT = f"upper({q.strip(q.json_text('reference_answer', 'answer'))})"
_RULE_TRUTH = f"CASE WHEN task_type = 'true_false' AND {_RIGHT} IN ('TRUE', 'FALSE') THEN CASE WHEN {_TRUTH} = {_RIGHT} THEN 5 ELSE 1 END END"
_RULE_OPTION = f"CASE WHEN task_type = 'school_qa' AND {q.json_text('reference_answer', 'type')} IN ('choice', '選擇題') AND {_RIGHT} <> '' AND contains('ABCD', {_RIGHT}) THEN CASE WHEN {_OPTION} = {_RIGHT} THEN 5 ELSE 1 END END"


@BANK.add("U01_true_false_scores", f"WITH {q.RESULTS} SELECT id, {_RULE_TRUTH} AS rule_score FROM results")
def u01(spark, folder):
    """Every response."""
    return results(spark, folder).select("id", b.rule_score_true_false(F.col("task_type"), F.col("reference_answer"), F.col("response_text"), F.col("error")).alias("rule_score"))


#: The tables' name of multiple-choice questions beside the usual one.
CHOICE = ("choice", "選擇題")


@BANK.add("U02_choice_scores", f"WITH {q.RESULTS} SELECT id, rule_score FROM (SELECT id, {_RULE_OPTION} AS rule_score FROM results) WHERE rule_score IS NOT NULL")
def u02(spark, folder):
    r = results(spark, folder)
    return r.select("id", b.rule_score_choice(F.col("task_type"), F.col("reference_answer"), F.col("response_text"), F.col("error"), CHOICE).alias("rule_score")).filter("rule_score is not null")


@BANK.add("U03_final_scores", f"WITH {q.RESULTS} SELECT id, coalesce({_RULE_TRUTH}, {_RULE_OPTION}, valid, 3) AS final_score FROM results")
def u03(spark, folder):
    """True/false rule, then the choice rule, then the judge, then 3."""
    r = results(spark, folder)
    args = [F.col(c) for c in ("task_type", "reference_answer", "response_text", "error")]
    return r.select("id", F.coalesce(b.rule_score_true_false(*args), b.rule_score_choice(*args, CHOICE), b.valid_score(F.col("score")), F.lit(3)).alias("final_score"))


@BANK.add("W01_A14_leaderboard", f"WITH {q.RESULTS}, m AS (SELECT model_key AS model, count(*) AS n, count(valid) AS n_scored, round(avg(valid), 3) AS avg_score, round(avg(latency_ms), 1) AS avg_latency_ms, count(*) FILTER (WHERE error <> '') AS error_count FROM results GROUP BY 1) SELECT *, row_number() OVER (ORDER BY avg_score DESC NULLS LAST, error_count, model) AS position FROM m")
def w01(spark, folder):
    return b.leaderboard(results(spark, folder))


@BANK.add("A15_overall_pass", f"WITH {q.RESULTS} SELECT round(avg(valid), 6) AS overall, avg(valid) >= 3.0 AS passed FROM results")
def a15(spark, folder):
    return results(spark, folder).agg(F.round(F.avg(b.valid_score(F.col("score"))), 6).alias("overall"), (F.avg(b.valid_score(F.col("score"))) >= 3.0).alias("passed"))


@BANK.add("A08_mean_scores", f"WITH {q.RESULTS} SELECT 'model' AS kind, model_key AS name, round(avg(valid), 3) AS mean, count(valid) AS n FROM results GROUP BY 2 UNION ALL SELECT 'task', task_type, round(avg(valid), 3), count(valid) FROM results GROUP BY 2")
def a08(spark, folder):
    """Means by model and by task, to three places."""
    rows = results(spark, folder).select("model_key", "task_type", b.valid_score(F.col("score")).alias("s"))
    by = lambda kind, c: rows.groupBy(F.col(c).alias("name")).agg(F.round(F.avg("s"), 3).alias("mean"), F.count("s").alias("n")).withColumn("kind", F.lit(kind))
    return by("model", "model_key").unionByName(by("task", "task_type"))


@BANK.add("A10_task_model_cells", f"WITH {q.RESULTS}, c AS (SELECT t.task_type, m.model_key FROM (SELECT DISTINCT task_type FROM results) t, (SELECT DISTINCT model_key FROM results) m) SELECT c.task_type, c.model_key AS model, count(valid) AS n, round(avg(valid), 6) AS mean, max(valid) AS highest, min(valid) AS lowest FROM c LEFT JOIN results r ON c.task_type IS NOT DISTINCT FROM r.task_type AND c.model_key IS NOT DISTINCT FROM r.model_key GROUP BY 1, 2")
def a10(spark, folder):
    """Every task with every model, also the cells without a score."""
    s = b.valid_score(F.col("score"))
    cells = results(spark, folder).groupBy("task_type", "model_key").agg(F.count(s).alias("n"), F.round(F.avg(s), 6).alias("mean"), F.max(s).alias("highest"), F.min(s).alias("lowest"))
    # Aggregated rows: one a task and model.
    cells = cells.select("*", F.struct("task_type", "model_key").alias("cell"))
    spine = cells.select("task_type").distinct().crossJoin(F.broadcast(cells.select("model_key").distinct())).select(F.struct("task_type", "model_key").alias("cell"))
    both = spine.join(cells.drop("task_type", "model_key"), "cell", "left")
    return both.select("cell.task_type", F.col("cell.model_key").alias("model"), F.coalesce("n", F.lit(0)).alias("n"), "mean", "highest", "lowest")


_TASKS = ("qa", "true_false", "school_qa", "classification", "summarization", "sentiment", "stance_analysis")


@BANK.add("A09_model_task_matrix", f"WITH {q.RESULTS} SELECT model_key AS model, " + ", ".join(f"coalesce(round(avg(valid) FILTER (WHERE task_type = '{t}'), 6), 0.0) AS {t}" for t in _TASKS) + " FROM results GROUP BY 1")
def a09(spark, folder):
    rows = results(spark, folder).select(F.col("model_key").alias("model"), "task_type", b.valid_score(F.col("score")).alias("s"))
    return rows.groupBy("model").pivot("task_type", list(_TASKS)).agg(F.round(F.avg("s"), 6)).fillna(0.0)


@BANK.add("A11_score_histogram", "WITH c AS (SELECT score, count(*) AS n FROM judge_scores WHERE score BETWEEN 1 AND 5 GROUP BY 1), s AS (SELECT CAST(g AS INT) AS score, coalesce(n, 0) AS n FROM range(1, 6) t(g) LEFT JOIN c ON c.score = g) SELECT score, n, round(coalesce(n / nullif(sum(n) OVER (), 0), 0), 6) AS share FROM s")
def a11(spark, folder):
    return b.score_histogram(table(spark, folder, "judge_scores"))


def _difficulty_sql(keyed: str, where: str, shown: str) -> str:
    return f"""WITH {q.RESULTS}, s AS (SELECT {keyed} AS statement, model_key, score, loaded_at, id FROM results), f AS (SELECT * FROM s WHERE statement IS NOT NULL {where} QUALIFY row_number() OVER (PARTITION BY statement, model_key ORDER BY loaded_at, id) = 1), t AS (SELECT statement, count(*) FILTER (WHERE score >= 4) AS correct, count(*) AS total FROM f GROUP BY 1), p AS (SELECT *, {shown} AS p_value FROM t)
SELECT *, CASE WHEN p_value > 0.7 THEN 'easy' WHEN p_value < 0.4 THEN 'hard' ELSE 'ideal' END AS category FROM p"""


_STATEMENT = f"nullif({q.json_text('reference_answer', 'statement')}, '')"
_LINES = "regexp_split_to_array(" + q.strip("prompt") + ", '" + q.LINE_END + "')"
_LAST_LINE = f"nullif({q.strip(f'list_last({_LINES})')}, '')"


@BANK.add("A12_question_list_difficulty", _difficulty_sql(f"coalesce({_STATEMENT}, {_LAST_LINE})", "", "round(correct / total, 3)"))
def a12_list(spark, folder):
    return b.difficulty(results(spark, folder), "question_list")


@BANK.add("A12_export_difficulty", _difficulty_sql(f"coalesce({_STATEMENT}, {_LAST_LINE})", "AND model_key <> ''", "correct / total"))
def a12_export(spark, folder):
    return b.difficulty(results(spark, folder), "export")


@BANK.add("A12_A13_p_values", _difficulty_sql(_STATEMENT, "AND model_key <> '' AND score IS NOT NULL", "round(correct / total, 3)"))
def a12_p(spark, folder):
    return b.difficulty(results(spark, folder), "p_values")


@BANK.add("F20_hard_questions", "SELECT statement, p_value FROM (" + _difficulty_sql(_STATEMENT, "AND model_key <> '' AND score IS NOT NULL", "round(correct / total, 3)") + ") WHERE category = 'hard'")
def f20(spark, folder):
    return b.difficulty(results(spark, folder), "p_values").filter("category = 'hard'").select("statement", "p_value")


@BANK.add("A17_distinct_sources", f"SELECT count(*) AS n FROM (SELECT DISTINCT lower(task_type) AS t, title, {q.json_text('reference_answer', 'topic')} AS topic, content, reference_answer FROM benchmark_items)")
def a17(spark, folder):
    own = table(spark, folder, "benchmark_items").select(F.lower("task_type").alias("t"), "title", json_text(F.col("reference_answer"), "topic").alias("topic"), "content", "reference_answer")
    return own.distinct().agg(F.count("*").alias("n"))


@BANK.add("A20_test_runs", f"WITH {q.RESPONSES}, {q.SCORES} SELECT run_id AS challenge, model_key AS model, coalesce(strftime(try_cast(finished_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H'), 'unknown') AS hour, count(*) AS n, count(*) FILTER (WHERE error <> '') AS errors, round(avg(CASE WHEN score BETWEEN 1 AND 5 THEN score END), 3) AS avg_score, min(finished_at) AS first_at, max(finished_at) AS last_at FROM responses LEFT JOIN (SELECT item_key, model_key, score FROM scores) USING (item_key, model_key) GROUP BY 1, 2, 3")
def a20(spark, folder):
    """Groups of one challenge, model and hour."""
    r = b.latest_responses(table(spark, folder, "llm_responses")).select("run_id", "item_key", F.lower("model_name").alias("model_key"), "error", "finished_at")
    rows = r.join(b.latest_scores(table(spark, folder, "judge_scores")).select("item_key", "model_key", "score"), ["item_key", "model_key"], "left")
    hour = F.coalesce(F.date_format(iso_time(F.col("finished_at")), "yyyy-MM-dd HH"), F.lit("unknown"))
    return rows.groupBy(F.col("run_id").alias("challenge"), F.col("model_key").alias("model"), hour.alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("error") != "").alias("errors"), F.round(F.avg(b.valid_score(F.col("score"))), 3).alias("avg_score"), F.min("finished_at").alias("first_at"), F.max("finished_at").alias("last_at"))


@BANK.add("A42_mean_of_run_means", f"WITH {q.RESULTS}, m AS (SELECT task_type, model_key, avg(valid) AS a FROM results GROUP BY 1, 2) SELECT task_type, round(avg(a), 6) AS mean FROM m WHERE a IS NOT NULL GROUP BY 1")
def a42(spark, folder):
    m = results(spark, folder).groupBy("task_type", "model_key").agg(F.avg(b.valid_score(F.col("score"))).alias("a")).filter("a is not null")
    return m.groupBy("task_type").agg(F.round(F.avg("a"), 6).alias("mean"))


@BANK.add("A21_status_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'pending') AS pending FROM qual_runs")
def a21(spark, folder):
    s = lambda x: F.count_if(F.col("status") == x).alias(x)
    return table(spark, folder, "qual_runs").agg(F.count("*").alias("total"), s("completed"), s("failed"), s("running"), s("pending"))


@BANK.add("A23_dataset_quality", f"WITH {q.ITEMS} SELECT lower(task_type) AS task_type, count(*) AS n, count(*) FILTER (WHERE {q.strip('content')} = '') AS empty_content, count(*) FILTER (WHERE coalesce({q.strip('reference_answer')}, '') = '') AS missing_reference FROM items GROUP BY 1")
def a23(spark, folder):
    i = b.latest_items(table(spark, folder, "benchmark_items"))
    return i.groupBy(F.lower("task_type").alias("task_type")).agg(F.count("*").alias("n"), F.count_if(strip(F.col("content")) == "").alias("empty_content"), F.count_if(F.coalesce(strip(F.col("reference_answer")), F.lit("")) == "").alias("missing_reference"))


@BANK.add("A23_repeated_titles", f"WITH {q.ITEMS} SELECT count(*) AS n_titles FROM (SELECT title FROM items GROUP BY 1 HAVING count(*) > 1)")
def a23_titles(spark, folder):
    return b.latest_items(table(spark, folder, "benchmark_items")).groupBy("title").count().filter("count > 1").agg(F.count("*").alias("n_titles"))


@BANK.add("A24_response_completeness", f"WITH {q.RESPONSES} SELECT model_key, count(*) AS n, count(*) FILTER (WHERE error <> '') AS errors, count(*) FILTER (WHERE coalesce(error, '') = '' AND coalesce({q.strip('response_text')}, '') = '') AS empty_text FROM responses GROUP BY 1")
def a24(spark, folder):
    r = b.latest_responses(table(spark, folder, "llm_responses"))
    none = F.coalesce(F.col("error"), F.lit("")) == ""
    return r.groupBy(F.lower("model_name").alias("model_key")).agg(F.count("*").alias("n"), F.count_if(~none).alias("errors"), F.count_if(none & (F.coalesce(strip(F.col("response_text")), F.lit("")) == "")).alias("empty_text"))


@BANK.add("A25_scoring_consistency", "WITH s AS (SELECT CASE WHEN score BETWEEN 1 AND 5 THEN score END AS v FROM judge_scores), a AS (SELECT count(v) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS deviation, min(v) AS lowest, max(v) AS highest, greatest(count(*) FILTER (WHERE v = 1), count(*) FILTER (WHERE v = 5)) AS most FROM s) SELECT n, round(mean, 6) AS mean, round(deviation, 6) AS deviation, lowest, highest, lowest = highest AS identical, n > 1 AND deviation < 0.3 AS narrow, most > 0.9 * n AS extreme FROM a")
def a25(spark, folder):
    return b.scoring_consistency(table(spark, folder, "judge_scores"))


@BANK.add("A26_pass_rule", f"WITH {q.ITEMS}, {q.RESPONSES}, i AS (SELECT count(*) AS n_items, coalesce(bool_and(coalesce(lower(task_type) = 'qa', false)), false) AS all_qa FROM items), r AS (SELECT count(*) AS n_responses, count(*) FILTER (WHERE error <> '') AS errors FROM responses), v AS (SELECT CASE WHEN score BETWEEN 1 AND 5 THEN score END AS v FROM judge_scores), s AS (SELECT count(v) AS n_scores, stddev_samp(v) AS d, count(*) FILTER (WHERE v = 5) AS fives, count(*) FILTER (WHERE v = 1) AS ones FROM v), a AS (SELECT n_items, n_responses, errors, n_scores, all_qa, CASE WHEN n_items = 0 THEN 'no items' WHEN n_responses > 0 AND errors = n_responses THEN 'all errors' WHEN n_responses > 0 AND n_scores = 0 THEN 'no scores' WHEN n_scores >= 2 AND NOT all_qa AND d = 0 THEN 'identical' WHEN n_scores >= 2 AND NOT all_qa AND fives > 0.9 * n_scores THEN 'all high' WHEN n_scores >= 2 AND NOT all_qa AND ones > 0.9 * n_scores THEN 'all low' ELSE '' END AS reason FROM i, r, s) SELECT *, reason = '' AS passed FROM a")
def a26(spark, folder):
    return b.passes(*(table(spark, folder, n) for n in ("benchmark_items", "llm_responses", "judge_scores")))


@BANK.add("J04_reject_reasons", f"WITH k AS (SELECT DISTINCT {q.norm('id')} AS item_key FROM benchmark_items), r AS (SELECT {q.norm('benchmark_item_id')} AS item_key, response_text, error FROM llm_responses), j AS (SELECT CASE WHEN coalesce(r.item_key, '') = '' THEN 'no_item' WHEN k.item_key IS NULL THEN 'unknown_item' WHEN coalesce(error, '') <> '' THEN 'error' WHEN coalesce({q.strip('response_text')}, '') = '' THEN 'empty' ELSE 'accepted' END AS reason FROM r LEFT JOIN k USING (item_key)) SELECT s.reason, count(j.reason) AS n FROM (VALUES ('no_item'), ('unknown_item'), ('error'), ('empty'), ('accepted')) s(reason) LEFT JOIN j USING (reason) GROUP BY 1")
def j04_reasons(spark, folder):
    return b.reject_reasons(table(spark, folder, "llm_responses"), table(spark, folder, "benchmark_items"))


_MARKED = lambda x: "(" + " OR ".join(f"contains({x}, '{m}')" for m in t.TOPIC_MARKERS) + ")"


def rejected_topic_sql(topic: str, content: str) -> str:
    a, c = q.strip(f"coalesce({topic}, '')"), q.strip(f"coalesce({content}, '')")
    return f"(length({a}) < 8 OR lower({a}) IN {t.TOPIC_NAMES} OR {_MARKED(f'lower({a})')} OR ({c} <> '' AND lower({a}) = lower({c})) OR ({_MARKED(f'lower({c})')} AND (contains({a}, '描述') OR contains(lower({a}), 'prompt'))))"


_COUNTS = r"""len(regexp_extract_all(post, '[\x{4e00}-\x{9fff}]')) AS zh, len(regexp_extract_all(post, '[A-Za-z]')) AS en, len(regexp_extract_all(post, '[\x{0600}-\x{06ff}]')) AS ar"""


@BANK.add("F17_stance_reject_reasons", f"""WITH {q.ITEMS}, s AS (SELECT {q.json_text('reference_answer', 'topic')} AS topic, {q.json_text('reference_answer', 'stance')} AS stance, content FROM items WHERE lower(task_type) = 'stance_analysis'), p AS (SELECT *, {q.strip("coalesce(topic, '')")} AS post FROM s), c AS (SELECT *, coalesce(nullif(content, ''), post) AS whole, {_COUNTS} FROM p),
j AS (SELECT CASE WHEN {rejected_topic_sql('topic', 'whole')} THEN 'invalid_topic' WHEN lower({q.strip("coalesce(stance, '')")}) NOT IN {t.STANCES} THEN 'unsupported_stance' WHEN {q.strip("coalesce(content, '')")} = '' THEN 'no_replies' WHEN NOT (zh + en + ar > 0 AND ar <= greatest(zh, en) AND (zh + en) * 10 >= (zh + en + ar) * 6) THEN 'unsupported_language' ELSE 'kept' END AS reason FROM c)
SELECT x.reason, count(j.reason) AS n FROM (VALUES ('invalid_topic'), ('unsupported_stance'), ('no_replies'), ('unsupported_language'), ('kept')) x(reason) LEFT JOIN j USING (reason) GROUP BY 1""")
def f17(spark, folder):
    """The first reason to leave out a stance item, with 0 for reasons that don't occur; an item's content stands for its replies."""
    own = b.latest_items(table(spark, folder, "benchmark_items")).filter("lower(task_type) = 'stance_analysis'")
    topic, stance = json_text(F.col("reference_answer"), "topic"), json_text(F.col("reference_answer"), "stance")
    reason = F.coalesce(t.stance_reject_reason(topic, F.col("content"), stance, topic, F.col("content")), F.lit("kept"))
    counts = own.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    spine = spark.createDataFrame([(x,) for x in ("invalid_topic", "unsupported_stance", "no_replies", "unsupported_language", "kept")], "reason string")
    return F.broadcast(spine).join(counts, "reason", "left").fillna(0, ["n"])


@BANK.add("J02_item_model_rows", f"WITH {q.ITEMS}, {q.RESPONSES}, {q.SCORES}, one AS (SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY item_key, model_key ORDER BY loaded_at DESC, id DESC) = 1), m AS (SELECT DISTINCT lower(model_name) AS model_key FROM llm_responses WHERE model_name IS NOT NULL) SELECT i.item_key, m.model_key, r.id, r.response_text, r.error, s.score FROM items i CROSS JOIN m LEFT JOIN one r ON r.item_key = i.item_key AND r.model_key = m.model_key LEFT JOIN scores s ON s.item_key = i.item_key AND s.model_key = m.model_key")
def j02_spine(spark, folder):
    """Every item with every model, also where there is no response."""
    rows = b.item_model_rows(*(table(spark, folder, n) for n in ("benchmark_items", "llm_responses", "judge_scores")))
    return rows.select("item_key", "model_key", "id", "response_text", "error", "score")


_LOADED = "pushes AS (SELECT article_id, sum(sign) AS pushes FROM (SELECT DISTINCT push_id, article_id, CASE WHEN starts_with(" + q.strip("tag") + ", '推') THEN 1 WHEN starts_with(" + q.strip("tag") + ", '噓') THEN -1 ELSE 0 END AS sign FROM ptt_pushes) GROUP BY 1), a AS (SELECT article_id, posted_at, content, CASE WHEN coalesce(pushes, 0) < 1 THEN 'min_push_count' WHEN regexp_matches(lower(" + q.strip("coalesce(title, '')") + "), '^(re:|fw:|\\[公告\\]|公告)') THEN 'title_prefix' WHEN coalesce(content, '') = '' THEN 'empty_content' WHEN strftime(posted_at, '%Y-%m-%d') < '2024-01-15' THEN 'date_start' WHEN strftime(posted_at, '%Y-%m-%d') > '2024-11-30' THEN 'date_end' WHEN length(content) < 40 THEN 'min_text_length' END AS reason FROM ptt_articles LEFT JOIN pushes USING (article_id)), k AS (SELECT article_id, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY article_id, reason IS NULL ORDER BY posted_at, content) > 1 THEN 'duplicate' ELSE coalesce(reason, 'accepted') END AS reason FROM a)"


def _loaded(spark, folder):
    pushes = table(spark, folder, "ptt_pushes").select("push_id", "article_id", t.push_sign(F.col("tag")).alias("sign")).distinct()
    return b.load_articles(table(spark, folder, "ptt_articles"), pushes, least_pushes=1, start="2024-01-15", end="2024-11-30", least_length=40)


@BANK.add("A35_load_report", f"WITH {_LOADED} SELECT s.reason, count(k.reason) AS n FROM (VALUES " + ", ".join(f"('{x}')" for x in (*b.ARTICLE_REASONS, "accepted")) + ") s(reason) LEFT JOIN k USING (reason) GROUP BY 1")
def a35(spark, folder):
    return b.load_report(_loaded(spark, folder))


@BANK.add("S15_loaded_articles", f"WITH {_LOADED} SELECT article_id FROM k WHERE reason = 'accepted'")
def s15(spark, folder):
    return _loaded(spark, folder).filter("reason is null").select("article_id")


@BANK.add("A39_model_failures", f"WITH {q.RESPONSES} SELECT model_key, count(*) AS n, count(*) FILTER (WHERE error <> '') AS failures, round(avg(latency_ms), 6) AS mean_latency FROM responses GROUP BY 1")
def a39(spark, folder):
    return b.latest_responses(table(spark, folder, "llm_responses")).groupBy(F.lower("model_name").alias("model_key")).agg(F.count("*").alias("n"), F.count_if(F.col("error") != "").alias("failures"), F.round(F.avg("latency_ms"), 6).alias("mean_latency"))


@BANK.add("D01_first_materials", "SELECT title, substr(content, 1, 100) AS head, min(id) AS first_id, count(*) AS n FROM benchmark_items GROUP BY 1, 2")
def d01(spark, folder):
    return table(spark, folder, "benchmark_items").groupBy("title", F.substring("content", 1, 100).alias("head")).agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


@BANK.add("D05_first_true_false_results", f"WITH {q.RESULTS}, s AS (SELECT *, {_STATEMENT} AS statement FROM results WHERE task_type = 'true_false') SELECT id FROM s QUALIFY statement IS NULL OR row_number() OVER (PARTITION BY statement, model_key ORDER BY loaded_at, id) = 1")
def d05(spark, folder):
    """An empty statement is never dropped."""
    rows = results(spark, folder).filter("task_type = 'true_false'").select("id", "model_key", "loaded_at", b.statement(F.col("reference_answer")).alias("statement"))
    first = b.keep(rows.filter("statement is not null"), ["statement", "model_key"], [F.col("loaded_at"), F.col("id")])
    return first.select("id").unionByName(rows.filter("statement is null").select("id"))


@BANK.add("D06_question_list", f"WITH {q.ITEMS}, s AS (SELECT item_key, lower(task_type) AS task_type, title, source_category, content, prompt, reference_answer, loaded_at, {_STATEMENT} AS statement FROM items), a AS (SELECT * FROM s QUALIFY task_type <> 'true_false' OR statement IS NULL OR contains(statement, '{{') OR row_number() OVER (PARTITION BY task_type, statement ORDER BY loaded_at, item_key) = 1) SELECT item_key FROM a QUALIFY row_number() OVER (PARTITION BY task_type, title, content, prompt, reference_answer ORDER BY loaded_at, item_key) = 1")
def d06(spark, folder):
    i = b.latest_items(table(spark, folder, "benchmark_items")).withColumn("task_type", F.lower("task_type")).withColumn("statement", b.statement(F.col("reference_answer")))
    order = [F.col("loaded_at"), F.col("item_key")]
    keyed = (F.col("task_type") == "true_false") & F.col("statement").isNotNull() & ~F.contains(F.coalesce("statement", F.lit("")), F.lit("{"))
    columns = ["item_key", "task_type", "title", "content", "prompt", "reference_answer", "loaded_at", "statement"]
    by_statement = b.keep(i.filter(keyed).select(columns), ["task_type", "statement"], order).select(columns)
    rest = i.filter(~F.coalesce(keyed, F.lit(False))).select(columns)
    return b.keep(by_statement.unionByName(rest), ["task_type", "title", "content", "prompt", "reference_answer"], order).select("item_key")


@BANK.add("D07_D08_statements_with_repeats", f"WITH {q.ITEMS} SELECT statement, count(*) - 1 AS dropped, min(item_key) AS first_key FROM (SELECT item_key, {_STATEMENT} AS statement FROM items) WHERE statement IS NOT NULL GROUP BY 1")
def d07(spark, folder):
    i = b.latest_items(table(spark, folder, "benchmark_items")).select("item_key", b.statement(F.col("reference_answer")).alias("statement")).filter("statement is not null")
    return i.groupBy("statement").agg((F.count("*") - 1).alias("dropped"), F.min("item_key").alias("first_key"))


@BANK.add("D09_recovered_materials", "SELECT DISTINCT title, source_category, content FROM benchmark_items")
def d09(spark, folder):
    return table(spark, folder, "benchmark_items").select("title", "source_category", "content").distinct()


@BANK.add("D11_pairs_without_score", f"WITH {q.RESPONSES}, {q.SCORES} SELECT item_key, model_key FROM responses WHERE item_key <> '' EXCEPT SELECT item_key, model_key FROM scores")
def d11(spark, folder):
    r = b.latest_responses(table(spark, folder, "llm_responses")).select("item_key", F.lower("model_name").alias("model_key")).filter("item_key <> ''").distinct()
    return r.join(b.latest_scores(table(spark, folder, "judge_scores")).select("item_key", "model_key"), ["item_key", "model_key"], "left_anti")


@BANK.add("D12_all_materials", "SELECT 'item' AS kind, id AS k, content AS text FROM benchmark_items UNION ALL SELECT 'article', article_id, content FROM tds_articles")
def d12(spark, folder):
    a = table(spark, folder, "benchmark_items").select(F.lit("item").alias("kind"), F.col("id").alias("k"), F.col("content").alias("text"))
    return a.unionByName(table(spark, folder, "tds_articles").select(F.lit("article").alias("kind"), F.col("article_id").alias("k"), F.col("content").alias("text")))


@BANK.add("F01_completed_runs", "SELECT DISTINCT id, created_at, status FROM qual_runs WHERE status = 'completed' ORDER BY created_at DESC, id LIMIT 20 OFFSET 2")
def f01(spark, folder):
    return table(spark, folder, "qual_runs").select("id", "created_at", "status").filter("status = 'completed'").distinct().orderBy(F.col("created_at").desc(), "id").offset(2).limit(20)


@BANK.add("F02_items_light", "SELECT id, lower(task_type) AS task_type, title FROM benchmark_items WHERE lower(task_type) = 'qa'")
def f02(spark, folder):
    return table(spark, folder, "benchmark_items").filter(F.lower("task_type") == "qa").select("id", F.lower("task_type").alias("task_type"), "title")


_CUT = lambda c, n: f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '…' ELSE {c} END AS {c}"


@BANK.add("F22_light_results", f"WITH {q.ITEMS}, {q.RESPONSES} SELECT id, {_CUT('content', 300)}, {_CUT('response_text', 500)} FROM responses r LEFT JOIN (SELECT item_key, content FROM items) i USING (item_key)")
def f22(spark, folder):
    """Heavy fields cut: content at 300 characters, responses at 500; prompts and references are left out."""
    i = b.latest_items(table(spark, folder, "benchmark_items")).select("item_key", "content")
    rows = b.latest_responses(table(spark, folder, "llm_responses")).select("id", "item_key", "response_text").join(i, "item_key", "left")
    return rows.select("id", t.cut_text(F.col("content"), 300).alias("content"), t.cut_text(F.col("response_text"), 500).alias("response_text"))


@BANK.add("F22_light_reasons", f"SELECT DISTINCT id, {_CUT('reasoning', 300)} FROM judge_scores")
def f22_reasons(spark, folder):
    return table(spark, folder, "judge_scores").select("id", t.cut_text(F.col("reasoning"), 300).alias("reasoning")).distinct()


@BANK.add("F23_F24_valid_references", f"WITH {q.ITEMS}, a AS (SELECT item_key, lower(task_type) AS task_type, upper({q.strip(q.json_text('reference_answer', 'answer'))}) AS answer FROM items) SELECT item_key, CASE WHEN task_type = 'true_false' THEN coalesce(answer IN ('TRUE', 'FALSE'), false) WHEN task_type = 'school_qa' THEN coalesce(answer <> '' AND contains('ABCD', answer), false) ELSE true END AS valid FROM a")
def f23(spark, folder):
    answer = F.upper(strip(json_text(F.col("reference_answer"), "answer")))
    t = F.lower("task_type")
    valid = F.when(t == "true_false", F.coalesce(answer.isin("TRUE", "FALSE"), F.lit(False))).when(t == "school_qa", F.coalesce((answer != "") & F.contains(F.lit("ABCD"), answer), F.lit(False))).otherwise(True)
    return b.latest_items(table(spark, folder, "benchmark_items")).select("item_key", valid.alias("valid"))


@BANK.add("O03_runs_by_finish", f"WITH {q.RESPONSES} SELECT id, finished_at FROM responses ORDER BY coalesce(finished_at, '') DESC, id LIMIT 50")
def o03(spark, folder):
    return b.latest_responses(table(spark, folder, "llm_responses")).select("id", "finished_at").orderBy(F.coalesce("finished_at", F.lit("")).desc(), "id").limit(50)


@BANK.add("JS1_question_types", f"WITH {q.ITEMS} SELECT {q.json_text('reference_answer', 'type')} AS kind, count(*) AS n FROM items GROUP BY 1")
def js1(spark, folder):
    return b.latest_items(table(spark, folder, "benchmark_items")).groupBy(json_text(F.col("reference_answer"), "type").alias("kind")).agg(F.count("*").alias("n"))


_BARE = q.strip("response_text")
_UNFENCED = f"CASE WHEN starts_with({_BARE}, '```') THEN " + q.strip(f"regexp_replace(regexp_replace({_BARE}, '^```[^\\n]*\\n?', ''), '```$', '')") + f" ELSE {_BARE} END"


@BANK.add("JS2_unfenced_categories", f"WITH {q.RESPONSES}, u AS (SELECT {_UNFENCED} AS body FROM responses) SELECT {q.json_text('body', 'category')} AS category, count(*) AS n FROM u GROUP BY 1")
def js2(spark, folder):
    """Categories in responses' JSON, with or without a code fence."""
    r = b.latest_responses(table(spark, folder, "llm_responses"))
    return r.groupBy(json_text(unfenced(F.col("response_text")), "category").alias("category")).agg(F.count("*").alias("n"))


@BANK.add("JS3_judged_scores", "SELECT DISTINCT id, CASE WHEN score IS NOT NULL THEN greatest(1, least(5, score)) END AS judged, CASE WHEN score IS NULL THEN 'no score' ELSE coalesce(reasoning, '') END AS reason FROM judge_scores")
def js3_judged(spark, folder):
    """Scores and reasons out of judges' JSON."""
    own = table(spark, folder, "judge_scores").select("id", t.judged_score(F.to_json(F.struct("score", "reasoning"))).alias("j"))
    return own.select("id", F.col("j.score").alias("judged"), F.col("j.reason").alias("reason")).distinct()


@BANK.add("M24_judge_messages", f"WITH {q.RESULTS} SELECT id, '題目：' || coalesce(prompt, '') || chr(10) || '參考答案：' || coalesce(nullif(reference_answer, ''), '（無參考答案）') || chr(10) || '回答：' || coalesce(nullif(response_text, ''), '（呼叫失敗：' || coalesce(error, 'None') || '）') AS message FROM results")
def m24(spark, folder):
    """A judge's message: a failed response is replaced by its error."""
    r = results(spark, folder)
    said = F.coalesce(F.nullif("response_text", F.lit("")), F.concat(F.lit("（呼叫失敗："), F.coalesce("error", F.lit("None")), F.lit("）")))
    return r.select("id", F.concat(F.lit("題目："), F.coalesce("prompt", F.lit("")), F.lit("\n參考答案："), F.coalesce(F.nullif("reference_answer", F.lit("")), F.lit("（無參考答案）")), F.lit("\n回答："), said).alias("message"))


@BANK.add("O05_hardest_first", "SELECT statement, p_value FROM (" + _difficulty_sql(_STATEMENT, "AND model_key <> '' AND score IS NOT NULL", "round(correct / total, 3)") + ") ORDER BY p_value ASC NULLS LAST, statement LIMIT 50")
def o05(spark, folder):
    return b.difficulty(results(spark, folder), "p_values").select("statement", "p_value").orderBy(F.col("p_value").asc_nulls_last(), "statement").limit(50)


@BANK.add("W07_numbered_questions", f"WITH {q.ITEMS}, v AS (SELECT item_key, {_STATEMENT} AS statement FROM items) SELECT item_key, row_number() OVER (ORDER BY item_key) AS number FROM v WHERE statement IS NOT NULL")
def w07(spark, folder):
    """Questions with a statement, numbered from 1; numbers come from a range sort."""
    from strandmill.operators.sampling import numbered

    own = b.latest_items(table(spark, folder, "benchmark_items")).select("item_key", b.statement(F.col("reference_answer")).alias("statement")).filter("statement is not null").select("item_key")
    return numbered(own, [F.col("item_key")])[0].select("item_key", (F.col("i") + 1).alias("number"))


@BANK.add("A40_run_fingerprints", "SELECT DISTINCT id, sha256(config_json) AS fingerprint FROM qual_runs")
def a40(spark, folder):
    return table(spark, folder, "qual_runs").select("id", F.sha2("config_json", 256).alias("fingerprint")).distinct()
