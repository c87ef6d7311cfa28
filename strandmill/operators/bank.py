"""Operators of the question bank: latest and first rows by key, result rows, scores, difficulty, leaderboards, quality checks.

Rows are kept by aggregates of structs, which combine before the shuffle, so that a key with a third of all rows is no hot
group; windows are used only over aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandmill.functions.keys import comparable_key
from strandmill.functions.text import excluded_title, first_option, first_truth, json_text, last_line, strip


def keep(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by `order`, which should tell all different rows apart; a null key is a key."""
    pick = F.max_by if last else F.min_by
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*others), F.struct(*order)).alias("kept")).select(*keys, "kept.*")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def latest_items(items: DataFrame) -> DataFrame:
    """One row an item: the last loaded; item_key is its comparable id."""
    own = items.withColumn("item_key", comparable_key("id"))
    return keep(own, ["item_key"], [F.col("loaded_at"), text_or_empty("prompt"), text_or_empty("reference_answer")], last=True)


def latest_responses(responses: DataFrame) -> DataFrame:
    own = responses.withColumn("item_key", comparable_key("benchmark_item_id"))
    return keep(own, ["id"], [F.col("loaded_at"), text_or_empty("response_text")], last=True)


def latest_scores(scores: DataFrame) -> DataFrame:
    """One row for each item and model (compared without case): the last loaded, then the greatest id."""
    own = scores.select(comparable_key("benchmark_item_id").alias("item_key"), F.lower("model_name").alias("model_key"), "id", "score", "judge_model", "loaded_at").filter("item_key <> ''")
    return keep(own, ["item_key", "model_key"], [F.col("loaded_at"), F.col("id")], last=True)


def result_rows(items: DataFrame, responses: DataFrame, scores: DataFrame) -> DataFrame:
    """Each response with its item's fields and its score: item x model x score; a response without a score has a null one."""
    i = latest_items(items).select("item_key", F.lower("task_type").alias("task_type"), "title", "prompt", "reference_answer", "source_category")
    r = latest_responses(responses).select("id", "item_key", F.lower("model_name").alias("model_key"), "response_text", "error", "latency_ms", "finished_at", "loaded_at")
    s = latest_scores(scores).select("item_key", "model_key", "score")
    return r.join(i, "item_key").join(s, ["item_key", "model_key"], "left")


def item_model_rows(items: DataFrame, responses: DataFrame, scores: DataFrame) -> DataFrame:
    """Every item once for each model that answered any: fields of the item, the response and the score, null where there is none.

    The result has items x models rows by definition; there is a row for each model name, which are configured, not data that grow.
    """
    i = latest_items(items).select("item_key", F.lower("task_type").alias("task_type"), "title", "prompt", "reference_answer")
    r = latest_responses(responses).select("item_key", F.lower("model_name").alias("model_key"), "id", "response_text", "error", "loaded_at")
    r = keep(r, ["item_key", "model_key"], [F.col("loaded_at"), F.col("id")], last=True).drop("loaded_at")
    models = responses.select(F.lower("model_name").alias("model_key")).filter("model_key is not null").distinct()
    pairs = i.crossJoin(F.broadcast(models))
    s = latest_scores(scores).select("item_key", "model_key", "score")
    return pairs.join(r, ["item_key", "model_key"], "left").join(s, ["item_key", "model_key"], "left")


def passes(items: DataFrame, responses: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: n_items, n_responses, errors, n_scores, all_qa, reason ('' if passed), passed; the first rule that fails gives the reason."""
    i = latest_items(items).agg(F.count("*").alias("n_items"), F.coalesce(F.bool_and(F.coalesce(F.lower("task_type") == "qa", F.lit(False))), F.lit(False)).alias("all_qa"))
    r = latest_responses(responses).agg(F.count("*").alias("n_responses"), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"))
    v = valid_score(F.col("score"))
    s = scores.agg(F.count(v).alias("n_scores"), F.coalesce(F.min(v) == F.max(v), F.lit(False)).alias("identical"), F.count_if(v == 5).alias("fives"), F.count_if(v == 1).alias("ones"))
    # Three single rows.
    one = i.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(s))
    skewed = (F.col("n_scores") >= 2) & ~F.col("all_qa")
    reason = F.when(F.col("n_items") == 0, "no items").when((F.col("n_responses") > 0) & (F.col("errors") == F.col("n_responses")), "all errors").when((F.col("n_responses") > 0) & (F.col("n_scores") == 0), "no scores")
    reason = reason.when(skewed & F.col("identical"), "identical").when(skewed & (F.col("fives") > 0.9 * F.col("n_scores")), "all high").when(skewed & (F.col("ones") > 0.9 * F.col("n_scores")), "all low").otherwise("")
    return one.withColumn("reason", reason).select("n_items", "n_responses", "errors", "n_scores", "all_qa", "reason", (F.col("reason") == "").alias("passed"))


def valid_score(c: Column) -> Column:
    return F.when(c.between(1, 5), c)


def statement(reference: Column, prompt: Column | None = None) -> Column:
    """The statement of a reference answer, else the last line of the prompt (if given), else null."""
    own = json_text(reference, "statement")
    fallback = last_line(prompt) if prompt is not None else F.lit(None).cast("string")
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(fallback, F.lit("")))


def difficulty_class(p: Column) -> Column:
    """Both bounds belong to ideal."""
    return F.when(p.isNull(), "unknown").when(p > 0.7, "easy").when(p < 0.4, "hard").otherwise("ideal")


def difficulty(rows: DataFrame, variant: str) -> DataFrame:
    """statement, correct, total, p_value, category in one of three variants that differ on purpose.

    question_list: rows without a model are one model, a null score is a wrong answer, the prompt's last line stands in
      for a missing statement, the rounded value is classified;
    export: as before, but rows without a model don't count, and the exact value is classified;
    p_values: rows without a model or a score and without a statement don't count, the rounded value is classified.
    A (model, statement) counts once: its first row by (loaded_at, id).
    """
    own = rows.withColumn("statement", statement(F.col("reference_answer"), None if variant == "p_values" else F.col("prompt"))).filter("statement is not null")
    if variant == "question_list":
        own = own.withColumn("model_key", F.coalesce("model_key", F.lit("__unknown__")))
    else:
        own = own.filter("model_key is not null and model_key <> ''")
    if variant == "p_values":
        own = own.filter("score is not null")
    first = keep(own.select("statement", "model_key", "score", "loaded_at", "id"), ["statement", "model_key"], [F.col("loaded_at"), F.col("id")])
    totals = first.groupBy("statement").agg(F.count_if(F.col("score") >= 4).alias("correct"), F.count("*").alias("total"))
    exact = F.col("correct") / F.col("total")
    shown = exact if variant == "export" else F.round(exact, 3)
    return totals.withColumn("p_value", shown).withColumn("category", difficulty_class(F.col("p_value")))


def rule_score_true_false(task: Column, reference: Column, response: Column, error: Column) -> Column:
    """5, 1, or null where the rule doesn't apply."""
    right = F.upper(strip(json_text(reference, "answer")))
    said = first_truth(F.coalesce(F.nullif(response, F.lit("")), error, F.lit("")))
    return F.when((task == "true_false") & right.isin("TRUE", "FALSE"), F.when(said == right, 5).otherwise(1))


def rule_score_choice(task: Column, reference: Column, response: Column, error: Column, kinds: tuple[str, ...] = ("選擇題",)) -> Column:
    """The right answer may be any part of 'ABCD'."""
    right = F.upper(strip(json_text(reference, "answer")))
    said = first_option(F.coalesce(F.nullif(response, F.lit("")), error, F.lit("")))
    return F.when((task == "school_qa") & json_text(reference, "type").isin(*kinds) & (right != "") & F.contains(F.lit("ABCD"), right), F.when(said == right, 5).otherwise(1))


def leaderboard(rows: DataFrame) -> DataFrame:
    """model, n, n_scored, avg_score (3 places), avg_latency_ms (1), error_count, position: best average first (null last), then fewer errors, then name."""
    s = valid_score(F.col("score"))
    models = rows.groupBy(F.col("model_key").alias("model")).agg(F.count("*").alias("n"), F.count(s).alias("n_scored"), F.round(F.avg(s), 3).alias("avg_score"), F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("error_count"))
    # One row a model.
    return models.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(F.col("avg_score").desc_nulls_last(), "error_count", "model")))


def score_histogram(rows: DataFrame) -> DataFrame:
    """score 1 to 5, n, share: absent scores have 0."""
    spine = rows.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("score"))
    counts = rows.groupBy(valid_score(F.col("score")).alias("score")).agg(F.count("*").alias("n")).filter("score is not null")
    both = F.broadcast(spine).join(counts, "score", "left").fillna(0, ["n"])
    return both.select("score", "n", F.round(F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy())), F.lit(0.0)), 6).alias("share"))


def scoring_consistency(rows: DataFrame) -> DataFrame:
    """One row: n, mean, sample deviation (0 for one score), least and greatest, identical, narrow, extreme (over nine tenths at 1 or 5)."""
    s = valid_score(F.col("score"))
    a = rows.agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("deviation"), F.min(s).alias("lowest"), F.max(s).alias("highest"), F.greatest(F.count_if(F.col("score") == 1), F.count_if(F.col("score") == 5)).alias("most"))
    return a.select("n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "lowest", "highest", (F.col("lowest") == F.col("highest")).alias("identical"), ((F.col("n") > 1) & (F.col("deviation") < 0.3)).alias("narrow"), (F.col("most") > 0.9 * F.col("n")).alias("extreme"))


ARTICLE_REASONS = ("duplicate", "min_push_count", "title_prefix", "title_contains", "empty_content", "date_start", "date_end", "min_text_length", "text_contains")


def article_reject_reason(title: Column, content: Column, date: Column, pushes: Column, least_pushes: int = 0, prefixes: tuple[str, ...] = (), title_part: str = "", text_part: str = "", start: str = "", end: str = "", least_length: int = 0) -> Column:
    """The first of the loader's reasons to leave out an article, null for one that is kept; an article without a date passes the dates."""
    held = F.coalesce(content, F.lit(""))
    rules = [("min_push_count", F.coalesce(pushes, F.lit(0)) < least_pushes), ("title_prefix", excluded_title(title, prefixes))]
    if title_part:
        rules.append(("title_contains", ~F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(title_part.lower()))))
    rules.append(("empty_content", held == ""))
    if start:
        rules.append(("date_start", F.coalesce(date < start, F.lit(False))))
    if end:
        rules.append(("date_end", F.coalesce(date > end, F.lit(False))))
    rules.append(("min_text_length", F.length(held) < least_length))
    if text_part:
        rules.append(("text_contains", ~F.contains(F.lower(held), F.lit(text_part.lower()))))
    out = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        out = F.when(fails, name).otherwise(out)
    return out


def load_articles(articles: DataFrame, pushes: DataFrame, **options) -> DataFrame:
    """article_id, title, content, month, pushes, reason of every delivery; of those without a reason of their own all but the first (by posted_at, content) are duplicates.

    `articles` has article_id, title, content, posted_at; `pushes` article_id and sign. Only accepted articles count as seen.
    """
    n = pushes.groupBy("article_id").agg(F.sum("sign").alias("pushes"))
    a = articles.join(n, "article_id", "left").withColumn("pushes", F.coalesce("pushes", F.lit(0)))
    date = F.date_format("posted_at", "yyyy-MM-dd")
    a = a.select("article_id", "title", "content", F.coalesce(F.date_format("posted_at", "yyyyMM"), F.lit("")).alias("month"), "posted_at", "pushes", article_reject_reason(F.col("title"), F.col("content"), date, F.col("pushes"), **options).alias("reason"))
    taken = a.filter("reason is null").groupBy("article_id").agg(F.min(F.struct("posted_at", "content", "title", "month", "pushes")).alias("first"), F.count("*").alias("n"))
    kept = taken.select("article_id", "first.title", "first.content", "first.month", "first.pushes", F.lit(None).cast("string").alias("reason"), F.lit(1).cast("long").alias("n"))
    twice = taken.filter("n > 1").select("article_id", "first.title", "first.content", "first.month", "first.pushes", F.lit("duplicate").alias("reason"), (F.col("n") - 1).alias("n"))
    refused = a.filter("reason is not null").groupBy("article_id", "title", "content", "month", "pushes", "reason").agg(F.count("*").alias("n"))
    return kept.unionByName(twice).unionByName(refused)


def load_report(loaded: DataFrame) -> DataFrame:
    """Reason, n: how many deliveries each reason left out, 0 for reasons that don't occur, and 'accepted'."""
    counts = loaded.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.sum("n").alias("n"))
    spine = loaded.sparkSession.createDataFrame([(x,) for x in (*ARTICLE_REASONS, "accepted")], "reason string")
    return F.broadcast(spine).join(counts, "reason", "left").fillna(0, ["n"])


def reject_reasons(responses: DataFrame, items: DataFrame) -> DataFrame:
    """reason, n: the first reason that holds for a response, with 0 for reasons that don't occur."""
    known = items.select(comparable_key("id").alias("item_key")).distinct().withColumn("there", F.lit(True))
    r = responses.select(comparable_key("benchmark_item_id").alias("item_key"), "response_text", "error").join(known, "item_key", "left")
    reason = F.when(F.coalesce(F.col("item_key"), F.lit("")) == "", "no_item").when(F.col("there").isNull(), "unknown_item").when(F.coalesce(F.col("error"), F.lit("")) != "", "error").when(F.coalesce(strip(F.col("response_text")), F.lit("")) == "", "empty").otherwise("accepted")
    counts = r.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    spine = responses.sparkSession.createDataFrame([(x,) for x in ("no_item", "unknown_item", "error", "empty", "accepted")], "reason string")
    return F.broadcast(spine).join(counts, "reason", "left").fillna(0, ["n"])
