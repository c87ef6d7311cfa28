"""Text that was decoded with the wrong character encoding: finding it and, where nothing was lost, restoring it.

1. `pair_statistics` counts adjacent characters over the whole corpus, in a table of 2^bits slots. Pairs that are so rare
   that they score as improbable whatever their characters are left out of it; the table is made larger until at most a
   sixteenth of its slots is taken (2^25 slots at most), so that hardly a rare pair has a usual one's slot, however
   diverse the corpus is. Texts with an outright sign of damage (a replacement character, a C1 control, an accented letter
   before a Latin-1 symbol) are left out of the counts, or damage would look ordinary where it is frequent.
2. Each pair of a text is scored by its share of the corpus' mutual information, p(xy) * log(p(xy) / (p(x) p(y))): v > 0
   for an improbable pair, v < 0 for a usual one. Characters that sound text never holds (U+FFFD, C1 controls) score
   highest, also at a text's edge. All maximal scoring segments of v are the improbable runs.
3. Inverse mappings (encode with the wrong encoding, decode with the right one) are tested inside these runs only. One
   is taken if it decodes strictly and what it gives is usual by the same statistics. It is tried again on its result
   until none applies, for text that was decoded wrongly several times.

A text is a case if it has an improbable run that holds a replacement character or a C1 control, or one with an inverse mapping.

Defined results: null, empty and blank texts are no cases. Rows with a null id are kept if they are cases. Repeated rows
come out once each. `restored` is null where characters were lost. Very long texts are handled whole. Without any text
for the statistics only replacement characters, C1 controls and UTF-8 read as a Western encoding are found.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandmill.session import cut

BITS, MOST_BITS, CHARACTER_SLOTS = 21, 25, 1 << 17
#: A pair with less than this share of mutual information (nats) is improbable; a run's least score.
USUAL, LEAST = 1e-6, 3.5
#: Below this share of all pairs p * log(1 / p) is less than USUAL / e^2: the pair's v is 2 as if it were never seen.
NEGLIGIBLE = 5e-9
#: v of a pair with a character that sound text never holds.
UNHEARD = 4.0
_CHUNK = 400_000

# What cp1252 makes of the bytes 0x80 to 0x9F; fixed values. The five bytes without a character stay C1 controls.
_CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_TO_BYTE = {c: chr(0x80 + i) for i, c in enumerate(_CP1252)}
_VIEW = str.maketrans(_TO_BYTE)
_SPECIAL = re.escape("".join(c for c in _CP1252 if ord(c) > 0xFF))
#: Left out of the statistics.
DAMAGED = "[\\x{FFFD}\\x{80}-\\x{84}\\x{86}-\\x{9F}]|[\\x{C0}-\\x{FF}][\\x{A0}-\\x{BF}" + "".join(f"\\x{{{ord(c):X}}}" for c in _CP1252 if ord(c) > 0xFF) + "]"
_HARD = re.compile("[�\x80-\x84\x86-\x9f]")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_UTF8 = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_WESTERN_SPAN = re.compile(f"[\x20-\xff{_SPECIAL}]*[\x80-\xff{_SPECIAL}][\x20-\xff{_SPECIAL}]*")
_WIDE_SPAN = re.compile(r"[^\x00-\x7f]+(?:[\x20-\x7e]{0,2}[^\x00-\x7f]+)*")
# Encodings that are tried; fixed values. (wrong, right) pairs in the order of their frequency in the wild.
_WESTERN_RIGHT = ("big5hkscs", "gb18030", "cp932", "cp949", "cp1251", "koi8-r", "euc-jp")
_SINGLE_WRONG = ("mac-roman", "cp1251", "koi8-r", "cp437", "cp850", "cp1250")
_WIDE_WRONG = ("gb18030", "gbk", "big5hkscs", "cp950", "cp932", "cp949", "euc-jp")
_WIDE_RIGHT = ("utf-8", "big5hkscs", "gb18030", "cp932", "cp949")


def _slots(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    h = x.astype(np.uint32) * np.uint32(0x9E3779B1) + y.astype(np.uint32) * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _chunks(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of texts, in lists of at most _CHUNK characters (or one text)."""
    part: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if part and size + len(t) > _CHUNK:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(t) + 1
    if part:
        yield part


def _count(bits: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single = np.zeros(CHARACTER_SLOTS, np.int64)
        pairs = np.zeros(1 << bits, np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for part in _chunks(texts):
                points = _points("\n".join(texts[i] for i in part))
                single += np.bincount(points & (CHARACTER_SLOTS - 1), minlength=CHARACTER_SLOTS)
                if len(points) > 1 and bits <= BITS:
                    pairs += np.bincount(_slots(points[:-1], points[1:], bits), minlength=1 << bits)
                elif len(points) > 1:
                    slots, n = np.unique(_slots(points[:-1], points[1:], bits), return_counts=True)
                    pairs[slots] += n
        for kind, counts in ((0, pairs), (1, single)):
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"kind": np.full(len(at), kind, np.int32), "slot": at.astype(np.int32), "n": counts[at]})

    return count


@dataclass
class Statistics:
    """Counts of pairs (by slot) and characters of the corpus."""

    pairs: np.ndarray
    single: np.ndarray
    bits: int
    total: int = 1

    def improbable(self, points: np.ndarray) -> np.ndarray:
        """v of each pair: log of the usual share by its own, within -2 and 2."""
        total = max(1, self.total)
        c = self.pairs[_slots(points[:-1], points[1:], self.bits)].astype(np.float32)
        alone = self.single[points & (CHARACTER_SLOTS - 1)].astype(np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            information = np.log(c * np.float32(total) / (alone[:-1] * alone[1:]))
            share = c / np.float32(total) * np.maximum(information, np.float32(0.1))
            v = np.log(np.float32(USUAL) / share)
        return np.clip(np.nan_to_num(v, nan=2.0, posinf=2.0, neginf=-2.0), -2, 2)

    def strange(self, text: str) -> float:
        """Share of improbable pairs, white space and ASCII pairs aside; 0 for too short texts."""
        points = _points(text)
        if len(points) < 2:
            return 0.0
        wide = (points[:-1] > 127) | (points[1:] > 127)
        return float((self.improbable(points)[wide] > 0).mean()) if wide.any() else 0.0

    def known(self, text: str) -> bool:
        """Whether all characters occur in the corpus, or are emoji, their parts or common punctuation."""
        return all(self.single[ord(c) & (CHARACTER_SLOTS - 1)] > 0 or ord(c) >= 0x1F000 or 0x2000 <= ord(c) < 0x2C00 or 0xFE00 <= ord(c) <= 0xFE0F for c in text)


def pair_statistics(texts: DataFrame, text: str = "text", bits: int = BITS, most_bits: int = MOST_BITS) -> Statistics:
    """Counts over all texts of a column; at most 2^most_bits + 2^17 rows come to the driver, however large the corpus is."""
    clean = texts.select(F.col(text).alias("text")).filter((F.length("text") > 1) & ~F.col("text").rlike(DAMAGED))
    while True:
        counted = clean.mapInPandas(_count(bits), "kind int, slot int, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n"))
        counted = cut(counted)
        total = counted.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rows = counted.filter((F.col("kind") == 1) | (F.col("n") >= total * NEGLIGIBLE)).toPandas()
        own = rows[rows["kind"] == 0]
        if len(own) * 16 <= 1 << bits or bits >= most_bits:
            break
        bits = min(bits + 2, most_bits)
    out = Statistics(np.zeros(1 << bits, np.int64), np.zeros(CHARACTER_SLOTS, np.int64), bits, int(total))
    out.pairs[own["slot"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
    single = rows[rows["kind"] == 1]
    out.single[single["slot"].to_numpy(np.int64)] = single["n"].to_numpy(np.int64)
    return out


def maximal_segments(v: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of v, by Ruzzo and Tompa, in linear time."""
    # Start, end, sum before, sum at the end, the nearest earlier one with a lesser sum before.
    held: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, x in enumerate(v):
        start, before, total = i, total, total + x
        if x <= 0:
            continue
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= before:
                j = held[j][4]
            if j < 0 or held[j][3] >= total:
                held.append((start, i + 1, before, total, j))
                break
            start, before, last = held[j][0], held[j][2], held[j][4]
            del held[j:]
            j = last
    return [(a, b, right - left) for a, b, left, right, _ in held]


def improbable_runs(texts: list[str], stats: Statistics) -> list[list[tuple[int, int]]]:
    """Of each text: spans of all maximal scoring segments with at least the score LEAST."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    for part in _chunks(texts):
        lengths = np.array([len(texts[i]) for i in part])
        # Two line ends between texts, so that a run never goes from one text to the next.
        points = _points("\n\n".join(texts[i] for i in part))
        if len(points) < 2:
            found[part[0]] = [(0, len(points))] if _HARD.search(texts[part[0]]) else []
            continue
        starts = np.r_[0, np.cumsum(lengths + 2)[:-1]]
        ends = (starts + lengths)[:-1]
        v = stats.improbable(points).astype(np.float64)
        v[ends] = v[starts[1:] - 1] = v[np.maximum(ends - 1, 0)] = -1e6
        hard = np.flatnonzero((points == 0xFFFD) | (points >= 0x80) & (points <= 0x9F) & (points != 0x85))
        v[np.maximum(hard - 1, 0)] = v[np.minimum(hard, len(v) - 1)] = UNHEARD
        total = np.r_[0.0, np.cumsum(v)]
        above = total - np.minimum.accumulate(total)
        inside = above > 0
        inside[0] = False
        first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        if not len(first):
            continue
        last = np.flatnonzero(inside & ~np.r_[inside[1:], False])
        peaks = np.maximum.reduceat(above, np.c_[first, np.minimum(last + 1, len(above) - 1)].ravel())[::2]
        peaks = np.maximum(peaks, above[last])
        for a, b in zip(first[peaks >= LEAST], last[peaks >= LEAST]):
            top = a + int(np.argmax(above[a : b + 1]))  # pairs a-1 .. top-1
            i = int(np.searchsorted(starts, a, "right")) - 1
            found[part[i]].append((int(max(a - 1 - starts[i], 0)), int(min(top + 1 - starts[i], lengths[i]))))
            # A stretch's first segment ends at its peak; what follows can hold others.
            rest = total[top : b + 1]
            if len(rest) > 1 and (rest - np.minimum.accumulate(rest)).max() >= LEAST:
                for start, end, score in maximal_segments(v[top:b].tolist()):
                    if score >= LEAST:
                        found[part[i]].append((int(top + start - starts[i]), int(min(top + end + 1 - starts[i], lengths[i]))))
    return found


def _touches(span: tuple[int, int], runs: list[tuple[int, int]], slack: int = 1) -> bool:
    return any(a - slack < span[1] and span[0] < b + slack for a, b in runs)


def _plausible(text: str, stats: Statistics, before: float, most: float = 0.34) -> bool:
    if any(unicodedata.category(c) in ("Cn", "Co", "Cs") or "\x7f" <= c < "\xa0" for c in text):
        return False
    now = stats.strange(text)
    return now <= most and now < 0.6 * before


def _western(text: str, runs: list[tuple[int, int]], stats: Statistics) -> tuple[str, str | None]:
    """UTF-8 that was read as cp1252 or Latin-1, inside runs."""
    view, out, at, how = text.translate(_VIEW), [], 0, None
    for m in _UTF8.finditer(view):
        if not _touches(m.span(), runs):
            continue
        try:
            right = m.group().encode("latin-1").decode("utf-8")
        except UnicodeError:
            continue
        if not stats.known(right) and not re.search("[\xc2-\xf4][\x80-\xbf]", right.translate(_VIEW)):
            continue
        out += [text[at : m.start()], right]
        at, how = m.end(), "cp1252>utf-8"
    return ("".join(out) + text[at:], how) if how else (text, None)


def _spans(text: str, pattern: re.Pattern, runs: list[tuple[int, int]], encoders, rights: tuple[str, ...], stats: Statistics, least: int) -> tuple[str, str | None]:
    """Replace spans that touch a run by the best inverse mapping, where one is plausible."""
    out, at, how = [], 0, None
    for m in pattern.finditer(text):
        span = m.group()
        if sum(c > "\x7f" for c in span) < least or not _touches(m.span(), runs):
            continue
        before, best = stats.strange(span), (1.0, None, None)
        if before < 0.3:
            continue
        for wrong, encode in encoders:
            try:
                raw = encode(span)
            except UnicodeError:
                continue
            for right in rights:
                if right == wrong or raw.isascii():
                    continue
                try:
                    result = raw.decode(right)
                except UnicodeError:
                    continue
                if result != span and _plausible(result, stats, before) and stats.strange(result) < best[0]:
                    best = (stats.strange(result), result, f"{wrong}>{right}")
        if best[1] is not None:
            out += [text[at : m.start()], best[1]]
            at, how = m.end(), best[2]
    return ("".join(out) + text[at:], how) if how else (text, None)


_WESTERN_ENCODERS = [("cp1252", lambda s: s.translate(_VIEW).encode("latin-1"))]
_SINGLE_ENCODERS = [(w, lambda s, w=w: s.encode(w)) for w in _SINGLE_WRONG]
_WIDE_ENCODERS = [(w, lambda s, w=w: s.encode(w)) for w in _WIDE_WRONG]


def examine(text: str, runs: list[tuple[int, int]], stats: Statistics) -> tuple[bool, str | None, str]:
    """Whether a text is garbled, its restored form (null if something is lost) and the mappings that were undone."""
    lost = "�" in text
    now, path, seen = text, [], {text}
    while runs:
        # First the mappings of whole spans: bytes of other encodings can hold what looks like a sequence of UTF-8.
        step, how = _spans(now, _WESTERN_SPAN, runs, _WESTERN_ENCODERS, _WESTERN_RIGHT, stats, 4)
        if not how:
            step, how = _western(now, runs, stats)
        if not how and "�" not in now:
            step, how = _spans(now, _WIDE_SPAN, runs, _SINGLE_ENCODERS, ("utf-8",), stats, 2)
        if not how and "�" not in now:
            step, how = _spans(now, _WIDE_SPAN, runs, _WIDE_ENCODERS, _WIDE_RIGHT, stats, 4)
        # A text that was there before would be mapped in circles.
        if not how or step in seen:
            break
        path.append(how)
        now = step
        seen.add(now)
        runs = improbable_runs([now], stats)[0]
    garbled = lost or bool(path) or bool(_CONTROL.search(text))
    whole = garbled and bool(path) and not lost and not _HARD.search(now)
    return garbled, now if whole else None, ", ".join(path)


def _find(broadcast):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stats = broadcast.value
        for batch in batches:
            texts = batch["text"].tolist()
            rows, restored, mappings = [], [], []
            for i, (t, runs) in enumerate(zip(texts, improbable_runs(texts, stats))):
                if runs:
                    hit, good, path = examine(t, runs, stats)
                    if hit:
                        rows.append(i)
                        restored.append(good)
                        mappings.append(path)
            if rows:
                keys = [None if pd.isna(k) else k for k in batch["key"].iloc[rows]]
                yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "restored": pd.Series(restored, dtype=object), "mappings": pd.Series(mappings, dtype=object)})

    return find


def find_garbled(texts: DataFrame, key: str, text: str = "text", stats: Statistics | None = None) -> DataFrame:
    """key, restored, mappings of the garbled texts; the statistics are those of the same texts unless given."""
    stats = stats or pair_statistics(texts, text)
    kind = dict(texts.dtypes)[key]
    # Pure ASCII can't be garbled in these ways.
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike("[^\\x{00}-\\x{7F}]"))
    held = texts.sparkSession.sparkContext.broadcast(stats)
    return rows.mapInPandas(_find(held), f"key {kind}, restored string, mappings string").withColumnRenamed("key", key)
