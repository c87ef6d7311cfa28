import pytest
from pyspark.sql import functions as F

from strandmill.functions import text as t


def value(spark, x, f, kind="string"):
    return spark.createDataFrame([(x,)], f"c {kind}").select(f(F.col("c")).alias("v")).first().v


@pytest.mark.parametrize(
    "f,x,expected",
    [
        (t.first_line_title, "　一行\r\n二行", "一行"),
        (t.collapse_space, " a 　\n b ", "a b"),
        (t.normal_newlines, "a\r\n\r\n\r\n\rb", "a\n\nb"),
        (t.strip_markdown, "---\nx: 1\n---\n# A <b>c</b>", "# A c"),
        (lambda c: t.strip_tags(c, 4), "<p>ab cd", "ab c"),
        (t.article_body, "作者\n作者在片中說得很好\n二\n--簽名\n三", "作者在片中說得很好\n二"),
        (t.clean_question, "根據文章，誰在文中出現？", "誰在出現？"),
        (t.clean_topic, "作者對「核電」的看法，", "「核電」的"),
        (t.error_category, "HTTP 503", "http_5xx"),
        (t.error_category, "Timeout 429", "timeout"),
        (t.error_category, None, "other"),
        (lambda c: t.brief(c, 10), "a\nbcdefghijkl", "a bcdef..."),
        (t.normal_option, "Ａ②ｃ", "A2C"),
        (t.script_escaped, 'a"\\\n', 'a\\"\\\\\\n'),
        (t.last_line, "a\nb \n", "b"),
        (t.push_count, "爆", 100), (t.push_count, "X3", -3), (t.push_count, "", 0), (t.push_count, "12", 12), (t.push_count, "XX", 0), (t.push_count, None, 0),
        (t.push_sign, "推 ", 1), (t.push_sign, "噓", -1), (t.push_sign, None, 0),
        (t.unfenced, "```json\n{}\n```", "{}"),
        (lambda c: t.json_text(c, "a"), '{"a": "x"}', "x"), (lambda c: t.json_text(c, "a"), "[1]", None), (lambda c: t.json_text(c, "a"), "broken", None),
        (t.first_truth, "答案是TRUE", ""), (t.first_truth, "it is true.", "TRUE"), (t.first_option, "a pear", "A"), (t.first_option, "（Ｂ）", ""),
        (t.is_emoji_only, "😀 🎬", True), (t.is_emoji_only, "a😀", False),
        (t.excluded_title, "Re: x", True), (t.excluded_title, None, False),
        (t.supported_language, "مرحبا", False), (t.supported_language, "hello 你好", True), (t.supported_language, "", False), (t.supported_language, None, False),
        (t.push_count, "X", 0), (t.push_count, " 7 ", 7), (t.push_count, "7.5", 0), (t.push_count, "-4", -4),
        (t.article_body, None, None), (t.article_body, "", ""), (t.article_body, "一\n※ 發信站: 批踢踢實業坊(x)\n二", "一"),
        (t.clean_text, "a &amp; b&nbsp;c &hellip;\r\nd", "a & b\u00a0c …\nd"), (t.clean_text, None, None),
        (lambda c: t.judged_score(c)["score"], '{"score": 9, "reasoning": "x"}', 5), (lambda c: t.judged_score(c)["score"], '{"score": "2"}', 2), (lambda c: t.judged_score(c)["reason"], '{"score": "two"}', "score is no number"), (lambda c: t.judged_score(c)["reason"], "{broken", "not JSON"), (lambda c: t.judged_score(c)["reason"], "{}", "no score"), (lambda c: t.judged_score(c)["score"], None, None),
        (lambda c: t.rate_limit_delay(c, F.lit("2025-01-01 00:00:00").cast("timestamp")), "Limit resets at: 2025-01-01 00:00:09 UTC", 10.0), (lambda c: t.rate_limit_delay(c, F.lit("2025-01-01 00:00:00").cast("timestamp")), "429", 5.0), (lambda c: t.rate_limit_delay(c, F.lit("2025-01-01 00:00:00").cast("timestamp")), "Limit resets at: 2025-01-01 00:09:00 UTC", 30.0),
        (lambda c: t.percent(c.cast("double")), "0.1234", "12.3%"), (t.path_list, '"a, b", c\n\'d\'', ["a, b", "c", "d"]), (t.mount_path, "C:\\x\\y z", "/mnt/c/x/y z"), (t.mount_path, "/data", "/data"), (t.label_list, "b, a，b,,c", ["b", "a", "c"]), (lambda c: t.label_list(c, ("a",)), "b,a", ["a"]), (t.label_list, None, []),
        (lambda c: t.rejected_topic(c, F.lit("")), "short", True), (lambda c: t.rejected_topic(c, F.lit("content")), "a long enough topic", False), (lambda c: t.rejected_topic(c, F.lit("a cinematic view")), "這張圖片的內容描述", True), (lambda c: t.rejected_topic(c, F.lit("x")), "Stable Diffusion tricks", True), (lambda c: t.rejected_topic(c, F.lit("Same Topic Text")), "same topic text", True),
        (t.complete_question, "《海》的導演是誰？", True), (t.complete_question, "其作者是誰？", False),
    ],
)
def test_text_functions(spark, f, x, expected):
    assert value(spark, x, f) == expected


def test_threads_round_trip(spark):
    df = spark.createDataFrame([("主文", [" 一 ", None, "", "二"])], "c string, r array<string>")
    whole = df.select(t.thread_text(F.col("c"), F.col("r")).alias("v"))
    parts = whole.select(t.split_thread(F.col("v")).alias("p")).first().p
    assert (parts.post, parts.replies) == ("主文", "1. 一\n2. 二")
    assert value(spark, "無標", t.split_thread).post == "無標"


def test_times(spark):
    assert str(value(spark, "Wed Jan 1 12:34:56 2025", t.forum_time)) == "2025-01-01 12:34:56" and value(spark, "x", t.forum_time) is None
    assert value(spark, "2024-01-01T00:00:00Z", t.iso_time) == value(spark, "2024-01-01T08:00:00+08:00", t.iso_time) and value(spark, "bad", t.iso_time) is None


def test_facets(spark):
    words = {"a": ("xx",), "b": ("yy", "zz")}
    f = lambda title, text, **o: spark.range(1).select(t.facet(F.lit(title), F.lit(text), {"標": "m"}, words, "none", **o).alias("v")).first().v
    assert [f("標題", "xx"), f("", "xx yy"), f("", "yy zz xx"), f("", "q"), f("", "")] == ["m", "a", "b", "none", "none"]
    assert f("", "q", own_name_bonus=2, floor=-1) == "a" and f("", "b", own_name_bonus=2, floor=-1) == "b"


def test_sparkline(spark):
    assert value(spark, [0, 7, 14], t.sparkline, "array<int>") == "▁▄█" and value(spark, [], t.sparkline, "array<int>") == ""
