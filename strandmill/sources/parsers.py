"""Parsers of exam papers, answer keys and forum pages, run in batches of Arrow rows.

Each takes one text and gives rows; a text that doesn't fit gives none. Null and empty texts give none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Words of exam papers that tell what a line is.
CHOICE_WORDS = ("選擇", "單選", "複選", "題組")
PASSAGE_WORDS = ("題文", "上文", "下文", "上述", "以下圖", "以下表", "以下資料")
PASSAGE_PHRASES = (("依據", "判斷"), ("根據", "回答"))
PASSAGE_MARK, NUMBER_ROW, ANSWER_ROW = "◎", "題號", "答案"

_NUMERALS = "一二三四五六七八九十百"
_VALID = frozenset("ABCD1234")


def plain(text: str) -> str:
    """Full-width and circled characters as ordinary ones, by Unicode's compatibility forms."""
    return unicodedata.normalize("NFKC", text)


def option(c: str) -> str:
    """The ASCII capital or digit of an option's mark."""
    return plain(c).upper()


def _heading(line: str) -> str | None:
    """The title of a section's first line, else null."""
    rest = line.lstrip(_NUMERALS)
    return rest[1:].strip()[:30] if rest != line and rest[:1] in tuple("、,，。") else None


def _numbered(line: str) -> tuple[int, str] | None:
    """Number and rest of a question's first line, else null."""
    digits = line[: len(line) - len(line.lstrip("0123456789"))]
    rest = line[len(digits) :]
    if not 1 <= len(digits) <= 3 or rest[:1] not in tuple(".．。"):
        return None
    rest = rest[1:].strip()
    if plain(rest[:1]) == "(" and plain(rest[1:].lstrip()[:1]) == ")":
        rest = rest[1:].lstrip()[1:].lstrip()
    return (int(digits), rest) if rest else None


def _choices(block: str) -> tuple[str, dict[str, str], str]:
    """Text before the first option, options by mark, and the lines after the last option's line."""
    places = [k for k in range(len(block) - 2) if plain(block[k]) == "(" and plain(block[k + 2]) == ")" and option(block[k + 1]) in _VALID]
    if not places:
        return block, {}, ""
    found, rest = {}, ""
    for k, end in zip(places, [*places[1:], len(block)]):
        value = block[k + 3 : end]
        if end == len(block):
            value, _, rest = value.partition("\n")
        if value.strip():
            found[option(block[k + 1])] = value.strip()
    return block[: places[0]], found, rest


def _refers(stem: str) -> bool:
    return any(w in stem for w in PASSAGE_WORDS) or any(a in line and b in line[line.index(a) :] for line in stem.split("\n") for a, b in PASSAGE_PHRASES)


def _page_mark(line: str) -> bool:
    """A line that only numbers pages or groups questions."""
    words = plain(line).replace("—", "-").strip()
    bare = words.replace(" ", "")
    core = bare.strip("-")
    counted = len(bare) > 1 and bare[0] in "第共" and bare[1:].split("頁")[0].isdigit() and "頁" in bare
    group = bare.partition("為題組")
    year = bare.partition("年學測")
    return (core.isdigit() and core != bare) or counted or bool(group[1]) and group[0].replace("-", "").isdigit() and "-" in group[0] or bool(year[1]) and year[0].isdigit()


def questions(text: str | None) -> list[dict]:
    """Number, question, choices of an exam paper, by number, the first of each number.

    Sections that are called multiple choice are read, or the whole paper if none is. A question has at least three choices.
    A passage of more than 20 characters before a question that refers to it is put in front of it.
    """
    if not text:
        return []
    sections: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        title = _heading(line)
        if title is None:
            sections[-1][1].append(line)
        else:
            sections.append((title, []))
    chosen = [lines for title, lines in sections if any(w in title for w in CHOICE_WORDS)] or [text.split("\n")]
    found: dict[int, dict] = {}
    for lines in chosen:
        blocks: list[tuple[int | None, list[str]]] = [(None, [])]
        for line in lines:
            head = _numbered(line)
            if head:
                blocks.append((head[0], [head[1]]))
            else:
                blocks[-1][1].append(line)
        passage = ""
        for number, own in blocks:
            block = "\n".join(own)
            stem, choices, rest = _choices(block) if number is not None else ("", {}, block)
            stem = stem.strip().rstrip("（(").strip()
            if number is not None and len(choices) >= 3 and stem and number not in found:
                found[number] = {"number": number, "question": f"{passage}\n\n{stem}" if len(passage) > 20 and _refers(stem) else stem, "choices": choices}
            if number is not None and not choices:
                rest = block
            after = rest[max(rest.find(PASSAGE_MARK), 0) :]
            passage = "\n".join(x for x in after.splitlines() if not _page_mark(x)).strip()
    return [found[n] for n in sorted(found)]


_PAIR = re.compile(r"(?<!\d)(\d{1,3})(?:\s*[.、:]\s*\(?\s*([A-D1-4])|[ \t]+([A-D]))(?![A-Z0-9])", re.I)


def _row(text: str, label: str) -> list[str]:
    """The words after a label, as far as they are numbers or options."""
    out: list[str] = []
    for word in text.partition(label)[2].split():
        if not (word.isdigit() and len(word) <= 3 or option(word) in _VALID):
            break
        out.append(option(word))
    return out


def answer_key(text: str | None) -> dict[int, str]:
    """Question number -> answer, by the first of five formats that gives any: table rows, '1. A', '1 A', rows of letters, and numbers and letters on lines in turn (five at least)."""
    if not text:
        return {}
    text = plain(text)
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    numbers, answers = _row(text, NUMBER_ROW), _row(text, ANSWER_ROW)
    pairs = [(int(n), dotted.upper(), spaced.upper()) for n, dotted, spaced in _PAIR.findall(text)]
    letters = [option(w) for x in lines if len(words := x.split()) >= 5 and all(option(w) in "ABCD" and len(w) == 1 for w in words) for w in words]
    formats: list[dict[int, str]] = [
        {int(n): a for n, a in zip(numbers, answers) if n.isdigit() and a in _VALID},
        {n: a for n, a, _ in pairs if a},
        {n: a for n, _, a in pairs if a},
        dict(enumerate(letters, 1)),
        _alternating(lines),
    ]
    return next((f for f in formats if f), {})


def _alternating(lines: list[str]) -> dict[int, str]:
    found = {int(a): option(b) for a, b in zip(lines, lines[1:]) if a.isdigit() and len(a) <= 3 and option(b) in _VALID}
    return found if len(found) >= 5 else {}


class _Tree(HTMLParser):
    """Events of a page with the classes of the open elements."""

    VOID = {"br", "img", "meta", "link", "input", "hr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.links: list[tuple[str, str]] = []
        self.texts: list[tuple[tuple[str, ...], str, str]] = []
        self.starts: list[int] = []
        self._href: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if a.get("class") == "r-ent":
            self.starts.append(len(self.texts))
        if tag not in self.VOID:
            self.open.append((tag, a.get("class") or a.get("id") or ""))
        if tag == "a":
            self._href.append(a.get("href") or "")
            self.links.append((a.get("href") or "", ""))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        if tag == "a" and self._href:
            self._href.pop()

    def handle_data(self, data):
        if self._href and self.links:
            href, before = self.links[-1]
            self.links[-1] = (href, before + data)
        self.texts.append((tuple(c for _, c in self.open), self._href[-1] if self._href else "", data))


def _parsed(html: str) -> _Tree:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree


def links(html: str | None) -> list[tuple[str, str]]:
    """(href, text) of a page's links, text collapsed, the first of each href."""
    out: dict[str, str] = {}
    for href, label in _parsed(html or "").links:
        if href and href not in out:
            out[href] = " ".join(label.split())
    return list(out.items())


def board_index(html: str | None) -> list[dict]:
    """Title, href, author, date, pushes of a board page's entries; an entry begins at an element of class r-ent."""
    tree = _parsed(html or "")
    names = {"title": "title", "author": "author", "date": "date", "nrec": "pushes"}
    entries: list[dict] = []
    for begin, end in zip(tree.starts, [*tree.starts[1:], len(tree.texts)]):
        entry = {"title": "", "href": "", "author": "", "date": "", "pushes": ""}
        for classes, href, data in tree.texts[begin:end]:
            own = next((names[c] for c in reversed(classes) if c in names), None) if "r-ent" in classes else None
            if own:
                entry[own] += data.strip()
                entry["href"] = href if own == "title" and href else entry["href"]
        entries.append(entry)
    return [e for e in entries if e["title"]]


def article(html: str | None) -> dict | None:
    """Meta values in order, body up to the signature, pushes (tag, user, content) of an article page; null without content."""
    metas: list[str] = []
    pushes: list[dict] = []
    body: list[str] = []
    for classes, _, data in _parsed(html or "").texts:
        if "article-meta-value" in classes:
            metas.append(data.strip())
        elif "push" in classes:
            own = next((c for c in reversed(classes) if c.startswith("push-") or "hl push-" in c), "")
            if "push-tag" in own:
                pushes.append({"tag": data.strip(), "user": "", "content": ""})
            elif pushes and "push-userid" in own:
                pushes[-1]["user"] += data.strip()
            elif pushes and "push-content" in own:
                pushes[-1]["content"] += data.strip().removeprefix(":").strip()
        elif "main-content" in classes and not any(c.startswith("article-meta") for c in classes):
            body.append(data)
    text = re.split(r"^--\s*$|^※ 發信站", unescape("".join(body)), maxsplit=1, flags=re.M)[0].strip()
    return {"metas": metas, "body": text, "pushes": pushes} if text or metas else None


def explode_with(rows: DataFrame, key: str, column: str, parse: Callable[[str | None], list[dict]], schema: str) -> DataFrame:
    """key and a row for each dict that a parser gives; `schema` lists the dict's fields."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, *(r.get(n) for n in names)) for k, x in zip(batch["key"], batch["value"]) for r in parse(x)]
            yield pd.DataFrame(found, columns=["key", *names])

    out = rows.select(F.col(key).alias("key"), F.col(column).alias("value")).mapInPandas(run, f"key {dict(rows.dtypes)[key]}, {schema}")
    return out.withColumnRenamed("key", key)


def exam_questions(papers: DataFrame, key: str, column: str, answers: str | None = None) -> DataFrame:
    """key, number, question, choices, answer (J09: '' if the key has none) of exam papers with their answer keys' text."""
    names = [key, column, *([answers] if answers else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key_of = answer_key(row[2]) if answers else {}
                out += [(row[0], q["number"], q["question"], q["choices"], key_of.get(q["number"], "")) for q in questions(row[1])]
            yield pd.DataFrame(out, columns=["key", "number", "question", "choices", "answer"])

    own = papers.select(*[F.col(n) for n in names])
    return own.mapInPandas(run, f"key {dict(papers.dtypes)[key]}, number int, question string, choices map<string,string>, answer string").withColumnRenamed("key", key)
