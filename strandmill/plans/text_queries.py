"""Text, number, date and topic queries over articles, documents, pushes and events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from strandmill.functions import text as t
from strandmill.operators import sampling, trend
from strandmill.plans import fragments as q
from strandmill.plans.registry import Registry
from strandmill.session import table

TEXT = Registry()

# The queries' own facets: a parameter of the operator, chosen for the words of the test tables.
FACETS = {"culture": ("影評", "電影", "漫畫", "museum", "festival", "詩集", "祭典"), "society": ("社區", "教室", "hospital", "志工", "clinic", "長者"), "technology": ("模型", "演算法", "伺服器", "algorithm", "chip", "晶片"), "politics": ("選區", "法案", "議會", "council", "policy")}
TITLE_FACETS = {"夜市": "culture", "廟會": "culture", "保險": "society", "太陽能": "technology", "預算": "politics"}


def _scalar(name: str, source: str, key: str, column, sql: str | None, doc: str) -> None:
    def run(spark, folder):
        return table(spark, folder, source).select(F.col(key).alias("k"), column().alias("value"))

    run.__doc__ = doc
    TEXT.add(name, f"SELECT {key} AS k, {sql} AS value FROM {source}" if sql else None)(run)


def _lines(c: str) -> str:
    return f"regexp_split_to_array({q.strip(c)}, '{q.LINE_END}')"


def _c():
    return F.col("content")


_scalar("X01_title", "ptt_articles", "article_id", lambda: t.first_line_title(_c()), f"substr({_lines('content')}[1], 1, 60)", "First line, at most 60 characters.")
_scalar("X02_collapsed_space", "documents", "doc_id", lambda: t.collapse_space(F.col("text")), q.strip(f"regexp_replace(text, '{q.SPACE}+', ' ', 'g')"), "White space collapsed.")
_scalar("X03_newlines", "documents", "doc_id", lambda: t.normal_newlines(F.col("text")), q.strip("regexp_replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"), "Newlines made one kind, three and more of them two.")
_scalar("X05_tags_stripped", "tds_articles", "article_id", lambda: t.strip_tags(_c(), 100), q.strip("substr(regexp_replace(content, '<[^>]+>', '', 'g'), 1, 100)"), "Without tags, cut, trimmed.")
_scalar("X10_clean_topic", "benchmark_items", "id", lambda: t.clean_topic(F.col("title")), f"trim({q.strip('regexp_replace(' + q.strip('''replace(''' * len(t.STANCE_PHRASES) + q.strip('title') + ''.join(f''', '{p}', '')''' for p in t.STANCE_PHRASES)) + f''', '{q.SPACE}+', ' ', 'g')''')}, '，。；：、 ')", "Stance topic without 15 phrases.")
_scalar("X13_substring_count", "tds_articles", "article_id", lambda: t.substring_count(_c(), "，"), "(length(content) - length(replace(content, '，', ''))) // 1", "Occurrences of a literal.")
_scalar("X17_error_category", "llm_responses", "id", lambda: t.error_category(F.col("error")), "CASE WHEN contains(lower(error), 'timeout') THEN 'timeout' WHEN contains(lower(error), '429') THEN 'http_429' WHEN contains(error, '5') AND contains(lower(error), 'http') THEN 'http_5xx' WHEN contains(lower(error), 'connect') THEN 'connection' WHEN contains(lower(error), 'json') AND contains(lower(error), 'decode') THEN 'parse' WHEN contains(lower(error), 'simulated transient failure') THEN 'transient' ELSE 'other' END", "First matching category.")
_scalar("X18_approx_tokens", "documents", "doc_id", lambda: t.approx_tokens(F.col("text")), "CAST(length(text) // 4 AS INT)", "A quarter of the characters.")
_scalar("X20_brief", "judge_scores", "id", lambda: t.brief(F.col("reasoning"), 30), "CASE WHEN length(replace(reasoning, chr(10), ' ')) > 30 THEN substr(replace(reasoning, chr(10), ' '), 1, 27) || '...' ELSE replace(reasoning, chr(10), ' ') END", "One line, cut with three dots.")
_scalar("X21_options", "benchmark_items", "id", lambda: t.normal_option(F.col("prompt")), f"translate(prompt, '{t.FULL_WIDTH_OPTIONS[0]}', '{t.FULL_WIDTH_OPTIONS[1]}')", "Full-width options made ASCII.")
_scalar("X24_ideographs", "documents", "doc_id", lambda: t.ideographs(F.col("text")), r"len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]'))", "Number of ideographs.")
_scalar("X26_script_escaped", "benchmark_items", "id", lambda: t.script_escaped(F.col("prompt")), "replace(replace(replace(prompt, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')", "Escaped for a quoted script string.")
_scalar("X27_last_line", "benchmark_items", "id", lambda: t.last_line(F.col("prompt")), q.strip(f"list_last({_lines('prompt')})"), "Last line of the prompt.")
_scalar("F09_emoji_only", "ptt_pushes", "push_id", lambda: t.is_emoji_only(_c()), q.strip(r"regexp_replace(content, '[\x{1F000}-\x{1FFFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}\x{200D}]+', '', 'g')") + " = ''", "Nothing but emoji.")
_scalar("F10_excluded_title", "ptt_articles", "article_id", lambda: t.excluded_title(F.col("title")), f"regexp_matches(lower({q.strip('coalesce(title, chr(32))')}), '^(re:|fw:|\\[公告\\]|公告)')", "Replies, forwards and announcements.")
_scalar("F15_supported_language", "documents", "doc_id", lambda: t.supported_language(F.col("text")), r"coalesce((len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) + len(regexp_extract_all(text, '[A-Za-z]')) + len(regexp_extract_all(text, '[\x{0600}-\x{06ff}]'))) > 0 AND len(regexp_extract_all(text, '[\x{0600}-\x{06ff}]')) <= greatest(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')), len(regexp_extract_all(text, '[A-Za-z]'))) AND (len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) + len(regexp_extract_all(text, '[A-Za-z]'))) * 10 >= 6 * (len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) + len(regexp_extract_all(text, '[A-Za-z]')) + len(regexp_extract_all(text, '[\x{0600}-\x{06ff}]'))), false)", "Mostly ideographs or Latin letters.")
_Q = q.strip("prompt")
_NAMED = "[A-Za-z0-9\\x{4E00}-\\x{9FFF}]{2,}"
_F18 = f"({_Q} <> '') AND regexp_matches({_Q}, '[《〈「『].+[》〉」』]|{_NAMED}(?:{'|'.join(t.SUBJECT_NOUNS)})|^{_NAMED}') AND NOT (" + " OR ".join([f"starts_with({_Q}, '{x}')" for x in t.BANNED_QUESTION_STARTS] + [f"contains({_Q}, '{x}')" for x in t.BANNED_QUESTION_PHRASES]) + ")"
_scalar("F18_complete_question", "benchmark_items", "id", lambda: t.complete_question(F.col("prompt")), _F18, "Questions with a named subject.")
_scalar("N02_push_sign", "ptt_pushes", "push_id", lambda: t.push_sign(F.col("tag")), f"CASE WHEN starts_with({q.strip('tag')}, '推') THEN 1 WHEN starts_with({q.strip('tag')}, '噓') THEN -1 ELSE 0 END", "+1, -1 or 0.")
_scalar("N03_clamped_score", "judge_scores", "id", lambda: t.clamp(F.col("score"), 1, 5), "CASE WHEN score IS NOT NULL THEN greatest(least(score, 5), 1) END", "Scores within 1 and 5.")
_scalar("N04_rounded_latency", "llm_responses", "id", lambda: F.bround("latency_ms", 1), "round_even(latency_ms, 1)", "Rounded to one place, halves to even.")
_scalar("T1_month_of_epoch", "request_records", "request_id", lambda: F.date_format(F.timestamp_seconds(F.floor("start_ts")), "yyyyMM"), "strftime(make_timestamp(CAST(floor(start_ts) AS BIGINT) * 1000000), '%Y%m')", "Month of epoch seconds in UTC.")
_scalar("T3_taipei_time", "documents", "doc_id", lambda: F.date_format(F.from_utc_timestamp(F.col("collected_at").cast("timestamp"), "Asia/Taipei"), "yyyy-MM-dd HH:mm"), "strftime(collected_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M')", "UTC shown in Taipei.")
_scalar("T4_iso_time", "llm_responses", "id", lambda: F.date_format(t.iso_time(F.col("requested_at")), "yyyy-MM-dd HH:mm:ss"), "strftime(try_cast(requested_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')", "ISO text in UTC, null if broken.")
_scalar("T5_month_end", "ptt_articles", "article_id", lambda: F.date_format(F.last_day("posted_at"), "yyyy-MM-dd"), "strftime(last_day(posted_at), '%Y-%m-%d')", "Last day of the month.")


def _hits(words) -> str:
    return " + ".join(f"((length(c) - length(replace(c, '{w.lower()}', ''))) // {len(w)})" for w in words)


_SCORES = ", ".join(f"{_hits(words)} AS s_{label}" for label, words in FACETS.items())
_BEST = "greatest(" + ", ".join(f"s_{x}" for x in FACETS) + ")"
_FACET_SQL = f"""f AS (SELECT *, CASE {' '.join(f"WHEN contains(title, '{p}') THEN '{a}'" for p, a in TITLE_FACETS.items())} WHEN {_BEST} = 0 THEN 'society' {' '.join(f"WHEN s_{x} = {_BEST} THEN '{x}'" for x in FACETS)} END AS facet FROM (SELECT doc_id, title, c, {_SCORES} FROM (SELECT doc_id, coalesce(title, '') AS title, lower(concat_ws(' ', title, text, keyword)) AS c FROM documents)))"""


def _facet_case(c: str, titled: str, default: str, bonus: int, floor: int) -> str:
    """The facet of a text in SQL; c is the name of the lower-case text, titled a title's patterns."""
    scores = [f"({_hits(words)}" + (f" + CASE WHEN contains(c, '{x.lower()}') THEN {bonus} ELSE 0 END)" if bonus else ")") for x, words in FACETS.items()]
    best = f"greatest({', '.join(scores)})"
    return f"CASE {titled} WHEN {q.strip('c')} = '' THEN '{default}' WHEN {best} <= {floor} THEN '{default}' " + " ".join(f"WHEN {score} = {best} THEN '{x}'" for x, score in zip(FACETS, scores)) + " END"


_TITLED = " ".join(f"WHEN contains(head, '{p}') THEN '{a}'" for p, a in TITLE_FACETS.items())
TEXT.add("X11_facet", f"SELECT k, {_facet_case('c', _TITLED, 'society', 0, 0)} AS value FROM (SELECT article_id AS k, substr(content, 1, 20) AS head, lower(coalesce(content, '')) AS c FROM tds_articles)")(lambda spark, folder: table(spark, folder, "tds_articles").select(F.col("article_id").alias("k"), t.facet(F.substring("content", 1, 20), F.coalesce("content", F.lit("")), TITLE_FACETS, FACETS, "society").alias("value")))
TEXT.add("X12_facet_with_own_name", f"SELECT k, {_facet_case('c', '', 'culture', 2, -1)} AS value FROM (SELECT doc_id AS k, lower(coalesce(text, '')) AS c FROM documents)")(lambda spark, folder: table(spark, folder, "documents").select(F.col("doc_id").alias("k"), t.facet(F.col("title"), F.coalesce("text", F.lit("")), {}, FACETS, "culture", 2, -1).alias("value")))


def _faceted(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", t.facet(F.coalesce("title", F.lit("")), F.concat_ws(" ", "title", "text", "keyword"), TITLE_FACETS, FACETS, "society").alias("facet"))


@TEXT.add("F13_facet_filter", f"WITH {_FACET_SQL} SELECT doc_id, facet FROM f WHERE facet IN ('technology', 'politics')")
def f13(spark, folder):
    return _faceted(spark, folder).filter(F.col("facet").isin("technology", "politics"))


@TEXT.add("A18_facet_counts", f"WITH {_FACET_SQL} SELECT l.facet, count(f.doc_id) AS n FROM (VALUES " + ", ".join(f"('{x}')" for x in FACETS) + ") l(facet) LEFT JOIN f USING (facet) GROUP BY 1")
def a18(spark, folder):
    counts = _faceted(spark, folder).groupBy("facet").agg(F.count("*").alias("n"))
    spine = spark.createDataFrame([(x,) for x in FACETS], "facet string")
    return F.broadcast(spine).join(counts, "facet", "left").fillna(0, ["n"])


_DRAW = "md5(concat(doc_id, '#', 0))"


@TEXT.add("R02_quota_sample", f"""WITH {_FACET_SQL}, l AS (SELECT * FROM (VALUES {', '.join(f"('{x}', {30 // len(FACETS) + (i < 30 % len(FACETS))})" for i, x in enumerate(FACETS))}) v(facet, quota)), p AS (SELECT doc_id, facet, quota, {_DRAW} AS draw, row_number() OVER (PARTITION BY facet ORDER BY {_DRAW}, doc_id::VARCHAR) AS place FROM f JOIN l USING (facet)), r AS (SELECT doc_id, facet, row_number() OVER (ORDER BY (place <= quota) DESC, draw, doc_id::VARCHAR) AS rank FROM p WHERE place <= 30) SELECT doc_id, facet FROM r WHERE rank <= 30""")
def r02(spark, folder):
    return sampling.quota_sample(_faceted(spark, folder), "facet", "doc_id", list(FACETS), 30).select("doc_id", "facet")


@TEXT.add("R01_guaranteed_sample", f"""WITH {_FACET_SQL}, p AS (SELECT doc_id, facet, {_DRAW} AS draw, row_number() OVER (PARTITION BY facet ORDER BY {_DRAW}, doc_id::VARCHAR) AS place FROM f), r AS (SELECT doc_id, facet, row_number() OVER (ORDER BY (place = 1) DESC, draw, doc_id::VARCHAR) AS rank FROM p WHERE place <= 20) SELECT doc_id, facet FROM r WHERE rank <= 20""")
def r01(spark, folder):
    return sampling.guaranteed_sample(_faceted(spark, folder), "facet", "doc_id", list(FACETS), 20).select("doc_id", "facet")


@TEXT.add("R09_cycled_runs", "WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM qual_runs)) SELECT run, id FROM range(50) t(run) JOIN p ON p.place = run % n")
def r09(spark, folder):
    return sampling.cycled(table(spark, folder, "qual_runs").select("id").distinct(), "id", 50).select("run", "id")


# --- Threads, subjects, topics ------------------------------------------------------------------------------------------


@TEXT.add("X07_threads", f"""WITH a AS (SELECT DISTINCT article_id, content FROM ptt_articles WHERE {q.strip('content')} <> ''), p AS (SELECT article_id, push_no, push_id, {q.strip('content')} AS reply FROM (SELECT DISTINCT article_id, push_no, push_id, content FROM ptt_pushes) WHERE {q.strip('content')} <> ''), n AS (SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY push_no, push_id, reply) AS i, reply FROM p), r AS (SELECT article_id, count(*) AS k, string_agg(i || '. ' || reply, chr(10) ORDER BY i) AS lines FROM n GROUP BY 1)
SELECT a.article_id, '【主題】' || chr(10) || {q.strip('a.content')} || CASE WHEN r.k > 0 THEN chr(10) || chr(10) || '【留言（共 ' || r.k || ' 則）】' || chr(10) || r.lines ELSE '' END AS thread FROM a LEFT JOIN r USING (article_id)""")
def x07(spark, folder):
    """Posts with their numbered replies; a thread's text is made of all of its replies."""
    a = table(spark, folder, "ptt_articles").select("article_id", "content").filter(t.strip(F.col("content")) != "").distinct()
    p = table(spark, folder, "ptt_pushes").select("article_id", "push_no", "push_id", t.strip(F.col("content")).alias("reply")).filter("reply <> ''").distinct()
    r = p.groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("push_no", "push_id", "reply"))), lambda x: x["reply"]).alias("replies"))
    return a.join(r, "article_id", "left").select("article_id", t.thread_text(F.col("content"), F.coalesce("replies", F.array().cast("array<string>"))).alias("thread"))


_RAW = q.strip("text")
_BODY = q.strip(f"regexp_extract({_RAW}, '(?s)【主題】(.*)', 1)")
_REPLIES = f"CASE WHEN regexp_matches({_BODY}, '\\n\\s*【留言[^】]*】') THEN " + q.strip(f"regexp_extract({_BODY}, '(?s)^.*?\\n\\s*【留言[^】]*】\\n?(.*)', 1)") + " ELSE '' END"


@TEXT.add("X08_split_threads", f"SELECT doc_id, CASE WHEN regexp_matches({_BODY}, '\\n\\s*【留言[^】]*】') THEN " + q.strip(f"regexp_extract({_BODY}, '(?s)^(.*?)\\n\\s*【留言[^】]*】', 1)") + f" ELSE {_BODY} END AS post, {_REPLIES} AS replies FROM documents WHERE contains(text, '【主題】')")
def x08(spark, folder):
    """Post and replies of documents that are threads."""
    parts = t.split_thread(F.col("text"))
    return table(spark, folder, "documents").filter(F.contains("text", F.lit("【主題】"))).select("doc_id", parts["post"].alias("post"), parts["replies"].alias("replies"))


@TEXT.add("AR2_replies_as_rows", f"WITH r AS (SELECT doc_id, list_filter(string_split({_REPLIES}, chr(10)), lambda x: length(x) > 0) AS l FROM documents WHERE contains(text, '【主題】')) SELECT doc_id, unnest(range(len(l))) AS place, unnest(l) AS reply FROM r")
def ar2(spark, folder):
    """A row a reply, of documents that are threads."""
    lines = F.filter(F.split(t.split_thread(F.col("text"))["replies"], "\n"), lambda x: F.length(x) > 0)
    return table(spark, folder, "documents").filter(F.contains("text", F.lit("【主題】"))).select("doc_id", F.posexplode(lines).alias("place", "reply"))


@TEXT.add("AR3_first_pushes", f"WITH p AS (SELECT DISTINCT article_id, push_no, push_id, {q.strip('tag')} AS tag, {q.strip('content')} AS content FROM ptt_pushes WHERE content <> '' AND {q.strip('content')} <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY push_no, push_id, content, tag) AS place FROM p) SELECT article_id, place, {q.strip("coalesce(tag, '') || ' ' || content")} AS line FROM n WHERE place <= 10")
def ar3(spark, folder):
    """The first ten pushes of an article, as lines of tag and text."""
    from strandmill.operators.topk import top_per_group

    p = table(spark, folder, "ptt_pushes").select("article_id", "push_no", "push_id", t.strip(F.col("tag")).alias("tag"), t.strip(F.col("content")).alias("content")).filter("content <> ''").distinct()
    order = [F.col("push_no"), F.col("push_id"), F.col("content"), F.col("tag")]
    few = top_per_group(p, ["article_id"], order, 10, "push_id").withColumn("place", F.row_number().over(Window.partitionBy("article_id").orderBy(*order)))
    return few.select("article_id", "place", t.strip(F.concat(F.coalesce("tag", F.lit("")), F.lit(" "), F.col("content"))).alias("line"))


@TEXT.add("F05_F08_article_filters", "SELECT DISTINCT article_id, date FROM tds_articles WHERE coalesce(comment_count, 0) >= 5 AND length(content) >= 100 AND contains(lower(content), lower('MODEL')) AND (date IS NULL OR date BETWEEN '2024-02-01' AND '2024-05-31')")
def f05(spark, folder):
    a = table(spark, folder, "tds_articles")
    return a.filter((F.coalesce("comment_count", F.lit(0)) >= 5) & (F.length("content") >= 100) & F.contains(F.lower("content"), F.lower(F.lit("MODEL"))) & (F.col("date").isNull() | F.col("date").between("2024-02-01", "2024-05-31"))).select("article_id", "date").distinct()


@TEXT.add("K09_first_written_articles", "SELECT article_id, date, min(coalesce(fetched_at, '')) AS first_fetched FROM tds_articles GROUP BY 1, 2")
def k09(spark, folder):
    return table(spark, folder, "tds_articles").groupBy("article_id", "date").agg(F.min(F.coalesce("fetched_at", F.lit(""))).alias("first_fetched"))


@TEXT.add("A32_store_status", "SELECT count(*) AS n_rows, count(DISTINCT date) AS n_dates, count(DISTINCT article_id) AS n_articles, count(*) FILTER (WHERE coalesce(content, '') = '') AS n_empty FROM tds_articles")
def a32(spark, folder):
    return table(spark, folder, "tds_articles").agg(F.count("*").alias("n_rows"), F.count_distinct("date").alias("n_dates"), F.count_distinct("article_id").alias("n_articles"), F.count_if(F.coalesce("content", F.lit("")) == "").alias("n_empty"))


@TEXT.add("A33_A34_most_common", "SELECT source, keyword, n FROM (SELECT lower(trim(source)) AS source, keyword, count(*) AS n FROM documents WHERE keyword IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, keyword) = 1")
def a33(spark, folder):
    counts = table(spark, folder, "documents").filter("keyword is not null").groupBy(F.lower(F.trim("source")).alias("source"), "keyword").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.min_by(F.struct("keyword", "n"), F.struct(-F.col("n"), F.col("keyword"))).alias("m")).select("source", "m.keyword", "m.n")


_TOPICS = "t AS (SELECT board AS topic, CAST(posted_at AS DATE) AS date, sum(length(content)) AS total, count(*) AS n FROM (SELECT DISTINCT article_id, board, posted_at, content FROM ptt_articles) WHERE posted_at IS NOT NULL GROUP BY 1, 2)"
_FIRST, _LAST = "2024-02-01", "2024-03-31"


def _topics(spark, folder):
    a = table(spark, folder, "ptt_articles").select("article_id", "board", "posted_at", "content").distinct()
    return trend.topic_days(a, "board", F.col("posted_at").cast("date"), F.length("content").cast("long"))


@TEXT.add("A27_topic_series", f"WITH {_TOPICS} SELECT topic, date, CAST(total AS BIGINT) AS total, n FROM t")
def a27(spark, folder):
    return _topics(spark, folder)


_SPINE = f"d AS (SELECT CAST(g AS DATE) AS date FROM generate_series(DATE '{_FIRST}', DATE '{_LAST}', INTERVAL 1 DAY) s(g)), z AS (SELECT topic, date, CAST(coalesce(total, 0) AS BIGINT) AS total FROM (SELECT DISTINCT topic FROM t WHERE date BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}') CROSS JOIN d LEFT JOIN t USING (topic, date))"


@TEXT.add("J15_filled_series", f"WITH {_TOPICS}, {_SPINE} SELECT topic, date, total FROM z")
def j15(spark, folder):
    return trend.filled(_topics(spark, folder), _FIRST, _LAST)


_TREND = f"WITH {_TOPICS}, {_SPINE}, a AS (SELECT topic, avg(total) FILTER (WHERE date < DATE '{_FIRST}' + 30) AS e, avg(total) FILTER (WHERE date >= DATE '{_FIRST}' + 30) AS r, CAST(sum(total) AS BIGINT) AS total, count(*) FILTER (WHERE total > 0) AS active_days FROM z GROUP BY 1), s AS (SELECT topic, round((r - e) / (e + 1), 6) AS score, round(e, 6) AS early_avg, round(r, 6) AS recent_avg, total, active_days FROM a WHERE active_days >= 2)"


@TEXT.add("A28_trend_scores", _TREND + " SELECT * FROM s")
def a28(spark, folder):
    return trend.trend_scores(_topics(spark, folder), _FIRST, _LAST)


@TEXT.add("O04_cooling_topics", _TREND + " SELECT * FROM (SELECT * FROM s ORDER BY score, topic LIMIT 10) WHERE score < -0.2")
def o04(spark, folder):
    return trend.cooling(trend.trend_scores(_topics(spark, folder), _FIRST, _LAST))


_WEEKS = "w AS (SELECT topic, CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(total) AS BIGINT) AS total FROM t GROUP BY 1, 2), r AS (SELECT CAST(min(date_trunc('week', date)) AS DATE) AS a, CAST(max(date_trunc('week', date)) AS DATE) AS b FROM t), sp AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS week FROM r), sn AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS i, count(*) OVER () AS n FROM sp), z AS (SELECT x.topic, sn.week, i, n, coalesce(w.total, 0) AS total FROM (SELECT DISTINCT topic FROM w) x CROSS JOIN sn LEFT JOIN w ON w.topic = x.topic AND w.week = sn.week)"
_PERCENT = "CAST(round_even((total - b) / b * 100, 0) AS BIGINT)"


@TEXT.add("A29_weekly_changes", f"WITH {_TOPICS}, {_WEEKS}, c AS (SELECT *, lag(total) OVER (PARTITION BY topic ORDER BY week) AS b FROM z) SELECT topic, week, CAST(total AS BIGINT) AS total, CASE WHEN b IS NULL THEN '—' WHEN b = 0 THEN CASE WHEN total > 0 THEN 'new' ELSE '—' END ELSE (CASE WHEN total >= b THEN '+' WHEN {_PERCENT} = 0 THEN '-' ELSE '' END) || CAST({_PERCENT} AS VARCHAR) || '%' END AS label FROM c")
def a29(spark, folder):
    return trend.weekly_changes(_topics(spark, folder))


_KINDS = " ".join(f"WHEN ratio >= {least} THEN '{name}'" for least, name in trend.MOMENTUM)


@TEXT.add("A30_A31_momentum", f"WITH {_TOPICS}, {_WEEKS}, a AS (SELECT topic, sum(CASE WHEN i < n // 2 THEN total ELSE 0 END) AS e, sum(CASE WHEN i < n // 2 THEN 0 ELSE total END) AS l, max(n) AS n, arg_max(week, total * 100000 - i) AS peak_week FROM z GROUP BY 1), q AS (SELECT *, l / CASE WHEN e = 0 THEN 1 ELSE e END AS ratio FROM a) SELECT topic, round(ratio, 6) AS ratio, CASE WHEN n < 2 THEN '' {_KINDS} END AS momentum, peak_week FROM q")
def a30(spark, folder):
    return trend.momentum(_topics(spark, folder))


@TEXT.add("A37_W09_quiet_months", "WITH m AS (SELECT DISTINCT month FROM documents WHERE month IS NOT NULL), s AS (SELECT strftime(g, '%Y%m') AS month FROM generate_series(DATE '2023-10-01', DATE '2025-03-01', INTERVAL 1 MONTH) x(g)), h AS (SELECT s.month, CASE WHEN m.month IS NULL THEN 0 ELSE 1 END AS has FROM s LEFT JOIN m USING (month)) SELECT month, has, sum(has) OVER (ORDER BY month DESC ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 0 AS three_quiet FROM h")
def a37(spark, folder):
    spine = spark.sql("SELECT explode(sequence(DATE'2023-10-01', DATE'2025-03-01', INTERVAL 1 MONTH)) AS d").select(F.date_format("d", "yyyyMM").alias("month"))
    there = table(spark, folder, "documents").filter("month is not null").select("month").distinct().withColumn("there", F.lit(1))
    h = F.broadcast(spine).join(there, "month", "left").select("month", F.coalesce("there", F.lit(0)).alias("has"))
    # A row a month.
    return h.withColumn("three_quiet", F.sum("has").over(Window.partitionBy().orderBy(F.col("month").desc()).rowsBetween(-2, 0)) == 0)


@TEXT.add("J13_chain_roots", "WITH RECURSIVE walk AS (SELECT o_orderkey AS k, o_orderkey AS root, 0 AS depth FROM orders WHERE o_orderkey // 2 = o_orderkey OR o_orderkey // 2 NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT o.o_orderkey, w.root, w.depth + 1 FROM orders o JOIN walk w ON o.o_orderkey // 2 = w.k AND o.o_orderkey <> w.k) SELECT k, root, depth FROM walk")
def j13(spark, folder):
    """The root of each record's chain of parents, by pointer doubling: log(depth) rounds, checkpointed."""
    from strandmill.operators.lineage import chain_roots

    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / 2).cast("long").alias("parent"))
    return chain_roots(orders)


@TEXT.add("D10_label_lists", "SELECT DISTINCT source, lower(trim(source)) AS label FROM documents WHERE trim(source) <> ''")
def d10(spark, folder):
    return table(spark, folder, "documents").select("source", F.lower(F.trim("source")).alias("label")).filter("label <> ''").distinct()


@TEXT.add("JS3_event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def js3(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@TEXT.add("F04_tail_after", "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def f04(spark, folder):
    return table(spark, folder, "events").filter("event_id > 500").select("event_id", "event_type").orderBy("event_id").limit(100)


@TEXT.add("S18_top_articles_of_range", "SELECT DISTINCT article_id, date, comment_count FROM tds_articles WHERE date BETWEEN '2024-03-01' AND '2024-04-30' AND comment_count IS NOT NULL ORDER BY comment_count DESC, article_id, date LIMIT 100")
def s18(spark, folder):
    a = table(spark, folder, "tds_articles").filter(F.col("date").between("2024-03-01", "2024-04-30") & F.col("comment_count").isNotNull())
    return a.select("article_id", "date", "comment_count").distinct().orderBy(F.col("comment_count").desc(), "article_id", "date").limit(100)
