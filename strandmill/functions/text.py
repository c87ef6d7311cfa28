"""Text, number, date and JSON functions as column expressions; all run inside the JVM."""

from __future__ import annotations

import unicodedata
from html import unescape

import pandas as pd
from pyspark.sql import Column, functions as F

# Phrases, prefixes and markers that results must share with the compatible pipeline.
QUESTION_PHRASES = ("根據文章內容，", "根據文章，", "依據文章內容，", "依據文章，", "根據本文，", "依據本文，", "在文章中，", "在文中，", "文章中", "文中", "本文", "這篇文章")
STANCE_PHRASES = ("作者對", "作者將", "作者", "其", "看法", "想法", "態度", "立場", "觀點", "正面", "負面", "讚賞", "批評", "支持", "反對")
EXCLUDED_TITLES = ("re:", "fw:", "[公告]", "公告")
BANNED_QUESTION_STARTS = ("主角", "上映日期", "提到的", "這部", "這篇", "這則", "該文", "該篇", "其")
BANNED_QUESTION_PHRASES = ("文章中", "文中", "本文", "根據文章", "依據本文", "這篇文章")
TOPIC_NAMES = ("prompt", "threads", "post", "tweet", "ai", "chatgpt", "gemini")
TOPIC_MARKERS = ("a high-resolution", "cinematic", "saved face reference", "style & attire", "black canvas utility jacket", "voluminous dark espresso hair", "sharp, angular jawline", "prompt", "midjourney", "stable diffusion")
STANCES = ("pro", "con", "支持", "反對")
BODY_LABELS = ("看板 Movie", "作者", "標題", "時間")
BODY_ENDS = ("※ 發信站: 批踢踢實業坊", "--")
QUESTION_LEADS, QUESTION_SOURCES = ("根據", "依據"), ("文章內容", "文章", "本文")
QUESTION_PLACES = ("文章中", "文中")
SUBJECT_NOUNS = ("公司", "電影", "影集", "作品", "球隊", "學校", "政府", "事件", "計畫", "政策", "平台", "品牌", "角色", "主角")
# Options' marks by rule: small letters, full-width letters, circled and full-width digits.
_MARKS = "abcd" + "".join(chr(first + i) for first in (0xFF21, 0xFF41, 0x2460, 0xFF11) for i in range(4))
FULL_WIDTH_OPTIONS = (_MARKS, unicodedata.normalize("NFKC", _MARKS).upper())
EMOJI = r"[\x{1F000}-\x{1FFFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}\x{200D}]+"


def strip(c: Column) -> Column:
    """Without surrounding Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_line_title(c: Column, size: int = 60) -> Column:
    """The first line, at most `size` characters."""
    return F.substring(F.get(F.split(strip(c), r"\R"), F.lit(0)), 1, size)


def collapse_space(c: Column) -> Column:
    """X02."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normal_newlines(c: Column) -> Column:
    """X03 without entities: \\r\\n and \\r become \\n, three and more of them two."""
    return strip(F.regexp_replace(F.regexp_replace(c, "\r\n|\r", "\n"), "\n{3,}", "\n\n"))


def strip_markdown(c: Column) -> Column:
    """Front matter, tags and runs of empty lines taken away."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\A---\n(?s:.*?)\n---\n", ""), r"<[^>]+>", ""), "\n{3,}", "\n\n"))


def strip_tags(c: Column, size: int) -> Column:
    """Without tags, cut, then trimmed."""
    return strip(F.substring(F.regexp_replace(c, "<[^>]+>", ""), 1, size))


def article_body(c: Column, ends: tuple[str, ...] = BODY_ENDS, labels: tuple[str, ...] = BODY_LABELS) -> Column:
    """Lines up to the first that begins with an end mark, without lines that are nothing but a label; trailing space of lines and runs of empty lines go."""
    lines = F.transform(F.split(normal_newlines(c), "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    ended = lambda x: F.startswith(strip(x), F.lit(ends[0])) | F.startswith(strip(x), F.lit(ends[1]))
    stop = F.array_position(F.transform(lines, lambda x: F.when(ended(x), 1).otherwise(0)), 1)
    kept = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
    return normal_newlines(F.array_join(F.filter(kept, lambda x: ~strip(x).isin(*labels)), "\n"))


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unescape(t))


def clean_text(c: Column) -> Column:
    """HTML entities (the standard library's table), then newlines; only texts with an ampersand go to Python."""
    return normal_newlines(F.coalesce(F.pandas_udf(_unescaped, "string")(F.when(F.contains(c, F.lit("&")), c)), c))


def thread_text(post: Column, replies: Column) -> Column:
    """A post and its numbered replies, empty ones left out."""
    kept = F.filter(F.transform(replies, strip), lambda r: F.coalesce(r, F.lit("")) != "")
    lines = F.array_join(F.transform(kept, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r)), "\n")
    return F.concat(F.lit("【主題】\n"), strip(post), F.when(F.size(kept) > 0, F.concat(F.lit("\n\n【留言（共 "), F.size(kept).cast("string"), F.lit(" 則）】\n"), lines)).otherwise(F.lit("")))


def split_thread(c: Column) -> Column:
    """Struct (post, replies) of a thread's text."""
    raw = strip(c)
    body = strip(F.regexp_extract(raw, r"(?s)【主題】(.*)", 1))
    has = F.contains(raw, F.lit("【主題】"))
    parted = body.rlike(r"\n\s*【留言[^】]*】")
    return F.struct(F.when(~has, raw).when(parted, strip(F.regexp_extract(body, r"(?s)\A(.*?)\n\s*【留言[^】]*】", 1))).otherwise(body).alias("post"), F.when(has & parted, strip(F.regexp_extract(body, r"(?s)\A.*?\n\s*【留言[^】]*】\n?(.*)", 1))).otherwise(F.lit("")).alias("replies"))


def _without(c: Column, phrases: tuple[str, ...]) -> Column:
    for p in phrases:
        c = F.replace(c, F.lit(p), F.lit(""))
    return c


def clean_question(c: Column) -> Column:
    """Without phrases that point at the article, wherever and then at the beginning."""
    gap = r"[，,、]?\s*"
    c = _without(strip(c), QUESTION_PHRASES)
    c = F.regexp_replace(c, f"^(?:{'|'.join(QUESTION_LEADS)})(?:{'|'.join(QUESTION_SOURCES)}){gap}", "")
    c = F.regexp_replace(c, f"^在?(?:{'|'.join(QUESTION_PLACES)}){gap}", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^[ ，,、]+|[ ，,、]+$", "")


def clean_topic(c: Column) -> Column:
    """X10."""
    return F.regexp_replace(collapse_space(_without(strip(c), STANCE_PHRASES)), "^[，。；：、 ]+|[，。；：、 ]+$", "")


def substring_count(text: Column, part: str) -> Column:
    """Occurrences of a literal, without overlaps."""
    return F.regexp_count(text, F.lit("\\Q" + part + "\\E"))


def facet(title: Column, text: Column, title_map: dict[str, str], keywords: dict[str, tuple[str, ...]], default: str, own_name_bonus: int = 0, floor: int = 0) -> Column:
    """The first title pattern that occurs, else the label with most keyword hits; a tie goes to the earlier label.

    With own_name_bonus and floor -1 a label's own name counts, too, and no hit at all gives the first label.
    """
    lower = F.lower(text)
    scores = [sum((substring_count(lower, k.lower()) for k in words), F.lit(0)) + F.when(F.contains(lower, F.lit(label.lower())), own_name_bonus).otherwise(0) for label, words in keywords.items()]
    labels = F.array(*map(F.lit, keywords))
    # A lambda's variable holds the scores, so each is counted once.
    pick = lambda a: F.when(F.array_max(a) > floor, F.element_at(labels, F.array_position(a, F.array_max(a)).cast("int"))).otherwise(F.lit(default))
    by_hits = F.get(F.transform(F.array(F.array(*scores)), pick), F.lit(0))
    by_title = F.coalesce(*[F.when(F.contains(title, F.lit(p)), F.lit(a)) for p, a in title_map.items()], F.lit(None).cast("string")) if title_map else F.lit(None).cast("string")
    return F.coalesce(by_title, F.when(F.coalesce(strip(lower), F.lit("")) == "", F.lit(default)).otherwise(by_hits))


def error_category(c: Column) -> Column:
    """First match."""
    m = F.lower(c)
    has = lambda x: F.contains(m, F.lit(x))
    return F.when(has("timeout"), "timeout").when(has("429"), "http_429").when(has("5") & has("http"), "http_5xx").when(has("connect"), "connection").when(has("json") & has("decode"), "parse").when(has("simulated transient failure"), "transient").otherwise("other")


def approx_tokens(c: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(c) / 4).cast("int")


def brief(c: Column, size: int = 80) -> Column:
    """One line; longer ones end with three dots."""
    line = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > size, F.concat(F.substring(line, 1, size - 3), F.lit("..."))).otherwise(line)


def cut_text(c: Column, size: int) -> Column:
    """longer texts are cut and end with an ellipsis."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def normal_option(c: Column) -> Column:
    """Full-width and circled options."""
    return F.translate(c, *FULL_WIDTH_OPTIONS)


def ideographs(c: Column) -> Column:
    """Number of ideographs."""
    return F.regexp_count(c, F.lit(r"[\x{4E00}-\x{9FFF}]"))


def sparkline(values: Column) -> Column:
    """Eight heights, relative to the greatest value."""
    top = F.greatest(F.array_max(values), F.lit(1))
    return F.array_join(F.transform(values, lambda v: F.substring(F.lit("▁▂▃▄▅▆▇█"), 1 + F.floor(v * 7 / top).cast("int"), F.lit(1))), "")


def script_escaped(c: Column) -> Column:
    """For a quoted string of a script."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def last_line(c: Column) -> Column:
    """X27."""
    return strip(F.element_at(F.split(strip(c), r"\R"), -1))


def is_emoji_only(c: Column) -> Column:
    """F09."""
    return strip(F.regexp_replace(c, EMOJI, "")) == ""


def excluded_title(c: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """an empty list means the defaults."""
    own = [p.strip().lower() for p in (prefixes or EXCLUDED_TITLES) if p.strip()]
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = F.lit(False)
    for p in own:
        out = out | F.startswith(t, F.lit(p))
    return out


def supported_language(c: Column) -> Column:
    """mostly ideographs or Latin letters, and not mostly Arabic ones."""
    zh, en, ar = (F.regexp_count(c, F.lit(p)) for p in (r"[\x{4E00}-\x{9FFF}]", "[A-Za-z]", r"[\x{0600}-\x{06FF}]"))
    return F.coalesce((zh + en + ar > 0) & (ar <= F.greatest(zh, en)) & ((zh + en) * 10 >= (zh + en + ar) * 6), F.lit(False))


def complete_question(c: Column) -> Column:
    """F18."""
    q = strip(c)
    banned = F.lit(False)
    for p in BANNED_QUESTION_STARTS:
        banned = banned | F.startswith(q, F.lit(p))
    for p in BANNED_QUESTION_PHRASES:
        banned = banned | F.contains(q, F.lit(p))
    word = r"[A-Za-z0-9\x{4E00}-\x{9FFF}]{2,}"
    named = q.rlike(f"[《〈「『].+[》〉」』]|{word}(?:{'|'.join(SUBJECT_NOUNS)})|^{word}")
    return (q != "") & named & ~banned


def push_count(c: Column) -> Column:
    """Blank 0, a burst 100, X and digits that number below 0, else the whole number or 0."""
    t = collapse_space(F.coalesce(c, F.lit("")))
    below = F.when(t.rlike(r"^X[0-9]+$"), -F.substring(t, 2, 9).try_cast("int"))
    return F.when(t == "", 0).when(t == "爆", 100).otherwise(F.coalesce(below, F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int")), F.lit(0)))


def push_sign(c: Column) -> Column:
    """N02."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(F.startswith(t, F.lit("推")), 1).when(F.startswith(t, F.lit("噓")), -1).otherwise(0)


def clamp(c: Column, low: int, high: int) -> Column:
    """N03; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def iso_time(c: Column) -> Column:
    """T-4: an ISO text with Z or an offset, in UTC; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def forum_time(c: Column) -> Column:
    """T-2: 'Wed Jan 01 12:34:56 2025'; null if it isn't one."""
    p = F.split(collapse_space(c), " ")
    return F.try_to_timestamp(F.concat_ws(" ", F.get(p, F.lit(1)), F.lpad(F.get(p, F.lit(2)), 2, "0"), F.get(p, F.lit(3)), F.get(p, F.lit(4))), F.lit("MMM dd HH:mm:ss yyyy"))


def json_text(c: Column, key: str) -> Column:
    """JS-1: a field of a JSON object; null for broken JSON, other values and absent keys."""
    return F.get_json_object(F.when(F.startswith(F.ltrim(c), F.lit("{")), c), f"$.{key}")


def unfenced(c: Column) -> Column:
    """JS-2: without the lines of a code fence."""
    t = strip(c)
    return F.when(F.startswith(t, F.lit("```")), strip(F.regexp_replace(F.regexp_replace(t, r"\A```[^\n]*\n?", ""), r"```\z", ""))).otherwise(t)


def first_option(c: Column) -> Column:
    """The first letter A to D that stands alone, in capitals; '' if there is none."""
    return F.upper(F.regexp_extract(c, r"(?U)\b([A-Da-d])\b", 1))


def first_truth(c: Column) -> Column:
    """The first TRUE or FALSE without a letter, digit or underscore of any script beside it; '' if there is none."""
    return F.regexp_extract(F.upper(c), r"(?<![\p{L}\p{N}_])(TRUE|FALSE)(?![\p{L}\p{N}_])", 1)


def rejected_topic(topic: Column, content: Column) -> Column:
    """F16: too short, a name of a service, a marker of image prompts in it, the content itself, or a prompt about such a content."""
    t, c = strip(F.coalesce(topic, F.lit(""))), strip(F.coalesce(content, F.lit("")))
    low, body = F.lower(t), F.lower(c)
    marked = lambda x: F.exists(F.array(*map(F.lit, TOPIC_MARKERS)), lambda m: F.contains(x, m))
    about = F.contains(t, F.lit("描述")) | F.contains(low, F.lit("prompt"))
    return (F.length(t) < 8) | low.isin(*TOPIC_NAMES) | marked(low) | ((c != "") & (low == body)) | (marked(body) & about)


def stance_reject_reason(topic: Column, content: Column, stance: Column, post: Column, replies: Column) -> Column:
    """the first of four reasons that holds; null for a row that is kept."""
    post = strip(F.coalesce(F.nullif(post, F.lit("")), topic, F.lit("")))
    whole = F.coalesce(F.nullif(content, F.lit("")), post)
    reasons = F.when(rejected_topic(topic, whole), "invalid_topic").when(~F.lower(strip(F.coalesce(stance, F.lit("")))).isin(*STANCES), "unsupported_stance")
    return reasons.when(strip(F.coalesce(replies, F.lit(""))) == "", "no_replies").when(~supported_language(post), "unsupported_language")


def judged_score(text: Column) -> Column:
    """JS-3: struct (score, reason): a judge's JSON with a whole score, kept within 1 and 5; else a null score and why."""
    body = unfenced(text)
    ok = F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False)) & F.startswith(F.ltrim(body), F.lit("{"))
    raw = F.get_json_object(body, "$.score")
    number = F.when(raw.rlike(r"^\s*[+-]?[0-9]+\s*$"), raw.try_cast("int")).when(raw.rlike(r"^[+-]?[0-9]+\.[0-9]+$"), raw.try_cast("double").cast("int"))
    reason = F.when(~ok, "not JSON").when(raw.isNull(), "no score").when(number.isNull(), "score is no number").otherwise(F.coalesce(F.get_json_object(body, "$.reasoning"), F.lit("")))
    return F.struct(F.when(ok, clamp(number, 1, 5)).alias("score"), reason.alias("reason"))


def rate_limit_delay(error: Column, now: Column) -> Column:
    """T-6: seconds to the time after 'Limit resets at:' and one more, within 1 and 30; 5 where there is none."""
    told = F.try_to_timestamp(F.regexp_extract(error, r"Limit resets at:\s*([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    wait = told.cast("double") - now.cast("double") + 1.0
    return F.when(wait.isNull(), 5.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(30.0), wait)))


def percent(c: Column, places: int = 1) -> Column:
    """A share as a percent text."""
    return F.format_string(f"%.{places}f%%", F.round(c * 100, places))


def path_list(c: Column) -> Column:
    """The entries of a list of paths: quoted ones as they are, others between commas and lines; empty ones go."""
    found = F.regexp_extract_all(c, F.lit(r"\"([^\"]*)\"|'([^']*)'|([^,\n\"']+)"), F.lit(0))
    return F.filter(F.transform(found, lambda x: strip(F.regexp_replace(strip(x), r"^[\"']|[\"']$", ""))), lambda x: x != "")


def mount_path(c: Column) -> Column:
    """A drive letter's path as a path below /mnt; others stay."""
    drive = F.regexp_extract(c, r"^([A-Za-z]):[\\/]", 1)
    return F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.lit("/"), F.translate(F.substring(c, 4, 1 << 20), "\\", "/"))).otherwise(c)


def label_list(c: Column, known: tuple[str, ...] = ()) -> Column:
    """M22 (and D10 with `known`): labels between commas in order, each once; labels that aren't known go only where some are given."""
    own = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,，\n]"), strip), lambda x: x != ""))
    return F.filter(own, lambda x: x.isin(*known)) if known else own
