"""Visually identical text with different characters: skeletons, and one consistent form.

The skeleton of a text is made by decomposing it, replacing every character by its prototype in the look-alike table and
decomposing again; texts with equal skeletons look the same. Skeletons are stored composed, which keeps them equal or
different as they are. The table has these parts:

* by rule, from Unicode's compatibility decompositions: full-width letters and digits, half-width katakana, letter
  ligatures and digraphs, Kangxi radicals and compatibility ideographs; for skeletons also mathematical letters and digits;
* supplementary radicals that are drawn like an ordinary ideograph, and Greek and Cyrillic letters that are drawn like a
  Latin one (fixed values; the letters are those whose prototype is a Latin letter or digit in the confusables of Unicode
  Technical Standard 39, as far as fonts in common use draw them alike; its file isn't read, as the box has none);
* invisible format characters, which vanish, and space characters, which become U+0020.

The consistent form applies the table only where a character is disguised, so that ordinary text stays as it is: Greek and
Cyrillic letters only in words that also hold a Latin letter (to the script of most letters of the word), joiners and
variation selectors only outside emoji, and full-width punctuation, U+3000 and line breaks never.

`find_disguised` takes its rows by skeletons: a text that is its own skeleton is ordinary; of the others the classes of
their characters and the scripts of their words then tell whether they are disguised, as whole words of another script
have other skeletons, too, and are ordinary. Texts without any character that the table or a decomposition changes
(`CANDIDATE`, `CHANGED`: tests in the JVM) are their own skeletons and don't go to Python.

Defined results: null stays null with no kinds; empty text stays empty. Ties and repeated rows are ordinary. The forms are
idempotent. Very long texts are handled whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Greek and Cyrillic letters and the Latin letters that they look like; fixed values.
_GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "ω": "w"}
_CYRILLIC = {"А": "A", "В": "B", "Е": "E", "З": "3", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "а": "a", "в": "b", "г": "r", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l", "ь": "b"}
# Supplementary radicals without a decomposition and the ideographs that they look like; fixed values.
_RADICALS = {"⺁": "厂", "⺄": "乙", "⺇": "几", "⺈": "刀", "⺊": "卜", "⺋": "卩", "⺌": "小", "⺎": "兀", "⺏": "尣", "⺐": "尢", "⺓": "幺", "⺔": "彑", "⺕": "彐", "⺗": "心", "⺘": "手", "⺙": "攵", "⺛": "旡", "⺜": "日", "⺝": "月", "⺞": "歹", "⺠": "民", "⺡": "水", "⺢": "水", "⺣": "火", "⺤": "爪", "⺥": "爪", "⺦": "丬", "⺨": "犭", "⺩": "王", "⺪": "疋", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺰": "糸", "⺱": "网", "⺲": "罒", "⺶": "羊", "⺷": "羊", "⺸": "羊", "⺹": "老", "⺻": "聿", "⺼": "月", "⺽": "臼", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻇": "角", "⻈": "讠", "⻉": "贝", "⻊": "足", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "邑", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻕": "阜", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻞": "食", "⻟": "飠", "⻠": "饣", "⻡": "首", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀", "⻳": "龟"}
CROSS_SCRIPT = _GREEK | _CYRILLIC

_SPACES = "   -   "
# Format characters, and fillers and joiners that are as invisible.
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U0001d173-\U0001d17a\U000e0001-\U000e007f\U000e0100-\U000e01ef"


@lru_cache
def prototypes() -> dict[int, str]:
    """The table's part by rule: code points of disguised forms and the ordinary text that they look like."""
    table = {ord(a): b for a, b in _RADICALS.items()}
    ranges = [(0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0xFF9F), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x0132, 0x0133), (0x0149, 0x0149), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2E80, 0x2FD5), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
    for first, last in ranges:
        for c in range(first, last + 1):
            if (form := unicodedata.normalize("NFKC", chr(c))) != chr(c):
                table[c] = form
    table[0xFF9E], table[0xFF9F] = "゙", "゚"
    return table


def _ranges(points) -> str:
    out, run = [], []
    for p in [*sorted(points), None]:
        if run and p != run[-1] + 1:
            out.append((run[0], run[-1]))
            run = []
        run.append(p)
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def candidate() -> str:
    """A regular expression of the JVM: any character that can be a disguise, or can make a text not composed."""
    own = _ranges(prototypes())
    spaces = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}"
    invisible = r"\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{1D173}-\x{1D17A}\x{E0001}-\x{E007F}\x{E0100}-\x{E01EF}"
    # Marks, conjoining jamo and characters with a canonical decomposition to one character.
    composing = r"\p{M}\x{1100}-\x{11FF}\x{37E}\x{387}\x{1F00}-\x{1FFF}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}\x{FB1D}-\x{FB4E}\x{374}"
    greek = r"\x{370}-\x{52F}"
    latin = r"A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}"
    # Intersections are tested from the left: ASCII and ordinary CJK text is through after a few comparisons.
    ordinary = r"\x{3001}-\x{303F}\x{3041}-\x{3096}\x{309B}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF1F}"
    return f"[\\x{{80}}-\\x{{10FFFF}}&&[^{ordinary}]&&[{own}{spaces}{invisible}{composing}]]|[{greek}](?:(?=[{latin}])|(?<=[{latin}][{greek}]))"


CANDIDATE = candidate()

_OWN = {
    "full-width": re.compile("[０-９Ａ-Ｚａ-ｚ]"),
    "half-width katakana": re.compile("[ｦ-ﾟ]"),
    "ligature": re.compile("[ﬀ-ﬆﬓ-ﬗĲĳŉǄ-ǌǱ-ǳ]"),
}
_KANA = re.compile("[ｦ-ﾟ]+")
_SPACE = re.compile(f"[{_SPACES}]")
_HIDDEN = re.compile(f"[{_INVISIBLE}]+")
_ACCENTED = re.compile("[^\\W\\d_][̀-ͯ]")
_WORD = re.compile("[A-Za-zÀ-ɏḀ-ỿ\u0300-\u036f\u0370-\u052f\u1f00-\u1fff]+")
_CROSSING = re.compile("[\u0370-\u052f\u1f00-\u1fff]")
_LATIN = re.compile("[A-Za-zÀ-ɏḀ-ỿ]")
_TO_LATIN = str.maketrans(CROSS_SCRIPT)
_TO_CYRILLIC = str.maketrans({b: a for a, b in reversed(_CYRILLIC.items()) if b.isalpha() and a != "ӏ" and b not in "bnrhsijdqwvl"})
_TO_GREEK = str.maketrans({b: a for a, b in reversed(_GREEK.items()) if b not in "nuwcyCj"})


@lru_cache
def _compatible() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(c)) for c in prototypes() if c < 0xFB00 and c > 0x2000 or 0xFB17 < c < 0xFF00 or c > 0x1FFFF) + "]")


@lru_cache
def _table() -> dict[int, str]:
    return {c: p for c, p in prototypes().items() if not 0xFF66 <= c <= 0xFF9F}


def _emoji(c: str) -> bool:
    return "‼" <= c <= "㊙" and unicodedata.category(c) in ("So", "Sm", "Po", "Pd") or "\U0001f000" <= c <= "\U0001faff" or c in "#*©®" or c.isdigit() and c < "\u0080"


def _hide(text: str) -> tuple[str, bool]:
    """Without invisible characters, but for joiners, selectors and tags inside emoji; whether any was taken away."""
    changed = False

    def put(m: re.Match) -> str:
        nonlocal changed
        before = text[m.start() - 1] if m.start() else ""
        after = text[m.end()] if m.end() < len(text) else ""
        kept = []
        for c in m.group():
            selector, joiner, tag = "︀" <= c <= "️", c == "‍", "\U000e0020" <= c <= "\U000e007f"
            if before and _emoji(before) and (selector and not kept or joiner and after and _emoji(after) or tag and before == "\U0001f3f4"):
                kept.append(c)
            else:
                changed = True
        return "".join(kept)

    return _HIDDEN.sub(put, text), changed


def _mapped(text: str, table: dict[int, str]) -> str:
    """Every letter's prototype under its own accents: decompose, map, compose."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(table))


def _one_script(m: re.Match) -> str:
    """A word of one script: that of most letters, Latin if even or where a letter has no look-alike."""
    word = m.group()
    if not _CROSSING.search(word) or not _LATIN.search(word):
        return word
    latin = len(_LATIN.findall(word))
    letters = sum(c.isalpha() for c in word)
    if latin * 2 < letters:
        other = _mapped(word, _TO_GREEK if sum("Ͱ" <= c < "Ѐ" or "\u1f00" <= c < "\u2000" for c in word) * 2 > letters - latin else _TO_CYRILLIC)
        if not _LATIN.search(other):
            return other
    return _mapped(word, _TO_LATIN)


def consistent(text: str) -> tuple[str, list[str]]:
    """The consistent form of a text, and the kinds of disguise in it."""
    kinds = [kind for kind, pattern in _OWN.items() if pattern.search(text)]
    if _compatible().search(text):
        kinds.append("radical or compatibility ideograph")
    if unicodedata.normalize("NFC", text) != text and kinds != ["radical or compatibility ideograph"] or _ACCENTED.search(text):
        kinds.append("not composed")
    form = _KANA.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    form, hidden = _hide(form.translate(_table()))
    if hidden:
        kinds.append("invisible")
    if _SPACE.search(form):
        kinds.append("space")
        form = _SPACE.sub(" ", form)
    form = unicodedata.normalize("NFC", form)
    joined = form
    if _CROSSING.search(form):
        joined = _WORD.sub(_one_script, form)
        if any(_CROSSING.search(w) and _LATIN.search(w) for w in _WORD.findall(form)):
            kinds.append("mixed scripts")
    return unicodedata.normalize("NFC", joined), kinds


@lru_cache
def _skeleton_table() -> dict[int, str]:
    table = dict(prototypes()) | {ord(a): b for a, b in CROSS_SCRIPT.items()} | {c: " " for c in range(0x3000) if _SPACE.match(chr(c))}
    for c in range(0x1D400, 0x1D800):
        if (form := unicodedata.normalize("NFKC", chr(c))) != chr(c):
            table[c] = form
    return table


def skeleton(text: str) -> str:
    """Decomposed, mapped, decomposed again (and stored composed)."""
    mapped = _HIDDEN.sub("", unicodedata.normalize("NFD", text)).translate(_skeleton_table())
    # Prototypes of mathematical Greek letters have prototypes themselves.
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", mapped.translate(_TO_LATIN)))


def _skeletons(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else skeleton(t))


#: A regular expression of the JVM: characters that only skeletons change.
CHANGED = r"[\x{370}-\x{52F}\x{1F00}-\x{1FFF}\x{1D400}-\x{1D7FF}]"


def skeleton_of(text: Column) -> Column:
    """The skeleton of a text column; texts that nothing changes stay in the JVM."""
    return F.coalesce(F.pandas_udf(_skeletons, "string")(F.when(text.rlike(f"{CANDIDATE}|{CHANGED}"), text)), text)


def _disguises(texts: pd.Series) -> pd.DataFrame:
    """Form and kinds of the texts that aren't their own skeletons; no kinds for the others."""
    done = [(t, []) if t is None or skeleton(t) == t else consistent(t) for t in texts]
    return pd.DataFrame({"form": [f for f, _ in done], "kinds": [k for _, k in done]})


def find_disguised(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, kinds, form of the rows whose text differs from its skeleton by a disguised character; form is the consistent form."""
    own = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(CANDIDATE))
    found = own.select("key", F.pandas_udf(_disguises, "form string, kinds array<string>")(F.col("text")).alias("d"))
    return found.select(F.col("key").alias(key), F.col("d.kinds").alias("kinds"), F.col("d.form").alias("form")).filter(F.size("kinds") > 0)


def with_forms(rows: DataFrame, text: str, form: str = "form", kinds: str = "kinds", skeleton: str = "skeleton") -> DataFrame:
    """`rows` with the consistent form, the kinds of disguise (empty for ordinary text) and the skeleton of a text column."""
    own = F.col(text)
    done = rows.withColumn(kinds, F.pandas_udf(_disguises, "form string, kinds array<string>")(F.when(own.rlike(CANDIDATE), own)))
    forms = done.withColumn(form, F.coalesce(F.col(f"{kinds}.form"), own)).withColumn(skeleton, skeleton_of(own))
    return forms.withColumn(kinds, F.coalesce(F.col(f"{kinds}.kinds"), F.array().cast("array<string>")))


def look_alike_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """skeleton_id, n_records, n_originals, first_key: groups of records that look the same and are written in more than one way.

    Rows are combined to (skeleton, text) digests first, so a skeleton that a third of all rows share is no hot group.
    """
    made = rows.filter(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), skeleton_of(F.col(text)).alias("skeleton"))
    digests = made.select("key", F.sha2(F.trim(F.regexp_replace("skeleton", r"(?U)\s+", " ")), 256).alias("skeleton_id"), F.xxhash64("text").alias("original"))
    each = digests.groupBy("skeleton_id", "original").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    return each.groupBy("skeleton_id").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_originals"), F.min("key").alias("first_key")).filter("n_originals > 1")
