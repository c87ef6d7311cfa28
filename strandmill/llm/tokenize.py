"""Byte-level BPE of a whole corpus by Spark's own expressions, from the files of a public tokenizer.

A text is cut into words by the tokenizer's pattern and each word's bytes are folded by ranked merges: a higher-order
`aggregate` looks up every adjacent pair in a literal rank map and merges the leftmost pair of the lowest rank, until no
pair has a rank. The rank map is a literal of two arrays, laid out by hash-and-displace so that a lookup is three array
reads (Spark's map type would be searched from end to end). There is no shuffle, no Python worker and no broadcast; the
literals' size is that of the tokenizer.

A run of ideographs is cut further, wherever no token of the vocabulary holds the bytes at both sides of the cut, so merges
never cross it and the ids stay the same; nearly all such pieces are single ideographs, whose ids are themselves a literal,
folded once from the 20,992 code points. Words that are tokens are looked up, too; all others are folded once for each text
in which they occur.

Defined results: null and empty texts have the empty list; blank texts are encoded as they are. Strings of special
tokens in a text are ordinary text. `decode` gives the text back; ids outside the vocabulary give null.
"""

from __future__ import annotations

import json
import os

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TOKENIZERS = "/opt/tokenizers"
FIRST, LAST = 0x4E00, 0x9FFF
#: The words of byte_bpe_50k; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 30


def _literal(values, kind: str) -> Column:
    """An array literal: folded by the optimiser, so a plan holds one constant and no thousands of expressions."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _bind(value: Column, body) -> Column:
    """body(value), with the value made once: a lambda's variable isn't computed again where it is used again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _layout(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and displace: a shift for each group of hashes, by which each hash has a slot of its own; and these slots."""
    size, groups = 1 << bits, 1 << (bits - 2)
    group, slot = hashes & (groups - 1), (hashes >> 24) & (size - 1)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(groups + 1))
    shifts, taken, slots = np.zeros(groups, np.int64), np.zeros(size, bool), np.zeros(len(hashes), np.int64)
    for g in np.argsort(-np.diff(cuts), kind="stable"):
        own = order[cuts[g] : cuts[g + 1]]
        if not len(own):
            break
        for shift in range(size):
            at = (slot[own] + shift) & (size - 1)
            if not taken[at].any() and len(set(at.tolist())) == len(at):
                break
        else:
            raise ValueError("no layout; take more bits")
        shifts[g], taken[at], slots[own] = shift, True, at
    return shifts, slots


class _Table:
    """A literal hash table of longs, one slot a key; `entry` gives the only slot in which a key can be.

    hash_of(keys, i) is the i-th of a family of hashes of 48 bits, of numpy arrays and of columns; the first with a layout is taken.
    """

    def __init__(self, keys: np.ndarray, entries: np.ndarray, hash_of, bits: int = 17) -> None:
        self.size, self.groups, self.hash_of = 1 << bits, 1 << (bits - 2), hash_of
        for self.i in range(16):
            try:
                shifts, slots = _layout(hash_of(keys, self.i), bits)
                break
            except ValueError:
                if self.i == 15:
                    raise
        held = np.full(self.size, -1, np.int64)
        held[slots] = entries
        self.shifts, self.held = _literal(shifts, "int"), _literal(held, "bigint")

    def entry(self, key: Column) -> Column:
        def of(h: Column) -> Column:
            shift = F.get(self.shifts, h.bitwiseAND(self.groups - 1).cast("int"))
            return F.get(self.held, (F.shiftright(h, 24) + shift).bitwiseAND(self.size - 1).cast("int"))

        return _bind(self.hash_of(key, self.i), of)


def _product(keys, i: int):
    """A product modulo a prime above all keys, different for different keys; it never leaves 63 bits, so Spark's longs follow."""
    return keys * (1103515245 + 2 * i) % 281474976710597


def _window(hashes, i: int):
    """48 of a hash's 64 bits."""
    return hashes >> i & 0xFFFFFFFFFFFF if isinstance(hashes, np.ndarray) else F.shiftright(hashes, i).bitwiseAND(0xFFFFFFFFFFFF)


class RankMap:
    """(a, b) -> merged id; ids are in the order of their ranks and below 2^16."""

    def __init__(self, merges: dict[tuple[int, int], int]) -> None:
        if max(map(max, merges)) >= 1 << 16 or max(merges.values()) >= 1 << 16:
            raise ValueError("ids of 16 bits at most")
        self.merges = merges
        keys = np.array([a << 16 | b for a, b in merges], dtype=np.int64)
        self.table = _Table(keys, keys << 16 | np.array(list(merges.values()), dtype=np.int64), _product)

    def lookup(self, left: Column, right: Column) -> Column:
        """The merged id of a pair, or a number above all ids."""
        key = F.shiftleft(left.cast("long"), 16).bitwiseOR(right.cast("long"))
        return _bind(self.table.entry(key), lambda e: F.when(F.shiftright(e, 16) == key, e.bitwiseAND(0xFFFF).cast("int")).otherwise(F.lit(_NONE)))

    def fold(self, ids: list[int]) -> list[int]:
        """The same on the driver."""
        ids = list(ids)
        while len(ids) > 1:
            best, at = min((self.merges.get(pair, _NONE), i) for i, pair in enumerate(zip(ids, ids[1:])))
            if best == _NONE:
                break
            ids[at : at + 2] = [best]
        return ids


class Tokenizer:
    """A byte-level BPE of the folder of public tokenizers (a .json of the tokenizers library).

    Pieces are handled as strings of the characters U+0000 to U+00FF that stand for their bytes.
    """

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> None:
        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = _byte_of_character()
        self.pieces: list[bytes] = [b""] * (max(model["vocab"].values()) + 1)
        for text, i in model["vocab"].items():
            if all(c in to_byte for c in text):
                self.pieces[i] = bytes(to_byte[c] for c in text)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in merges]
        if any(x >= y for (_, _, x), (_, _, y) in zip(ids, ids[1:])):
            raise ValueError("ids don't follow the ranks")
        self.byte_ids = [model["vocab"][c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        self.ranks = RankMap({(a, b): c for a, b, c in ids})
        # Pieces that are a token: only those that folding gives, so that the shortcut never changes a result.
        whole = [i for i, p in enumerate(self.pieces) if p and self.ranks.fold([self.byte_ids[b] for b in p]) == [i]]
        named = [self.pieces[i].decode("latin-1") for i in whole]
        hashes = np.array([xxhash.xxh64(p.encode(), seed=42).intdigest() for p in named], dtype=np.uint64).view(np.int64)
        self.words = _Table(hashes, np.array(whole, dtype=np.int64), _window)
        self.names = F.split(F.lit("\u0100".join(p.decode("latin-1") for p in self.pieces)), "\u0100")
        self._ideographs: Column | None = None

    def cut(self) -> str:
        """Where a run of ideographs (U+4000 to U+9FFF, as bytes) may be cut: no token holds the bytes at both sides."""
        across = sorted({(t[:p][-3:], t[p : p + 3]) for t in self.pieces for p in range(1, len(t)) if 0xE4 <= t[p] <= 0xE9 and t[p - 1] >= 0x80})
        short = {(a, b) for a, b in across if not any((a.endswith(c) and b.startswith(d)) and (a, b) != (c, d) for c, d in across)}
        code = lambda x: "".join(f"\\x{{{c:02X}}}" for c in x)
        unsafe = "".join(f"(?!(?<={code(a)}){code(b)})" for a, b in sorted(short))
        return rf"(?<=[\x{{E4}}-\x{{E9}}][\x{{80}}-\x{{BF}}]{{2}})(?=[\x{{E4}}-\x{{E9}}]){unsafe}"

    def split(self, text: Column) -> Column:
        """Pieces of a text, as bytes' characters: words of the tokenizer's pattern, runs of ideographs cut where no merge can cross."""
        words = F.regexp_extract_all(text, F.lit(f"(?U)({PATTERN})"), F.lit(1))
        view = lambda w: F.decode(F.encode(w, "utf-8"), "iso-8859-1")
        return F.flatten(F.transform(words, lambda w: F.when(w.rlike("[\\x{4000}-\\x{9FFF}]{2}"), F.split(view(w), self.cut())).otherwise(F.array(view(w)))))

    def fold(self, ids: Column) -> Column:
        """Ids after all merges: each step merges the leftmost pair of the lowest rank."""
        none = F.array().cast("array<int>")

        def step(state: Column, _: Column) -> Column:
            held, best = state["ids"], state["best"]

            def merge(low: Column, at: Column) -> Column:
                merged = F.concat(F.slice(held, F.lit(1), at - 1), F.array(low), F.slice(held, at + 2, F.size(held)))
                left = F.when(at > 1, F.array(self.ranks.lookup(F.get(held, at - 2), low))).otherwise(none)
                right = F.when(at < F.size(best), F.array(self.ranks.lookup(low, F.get(held, at + 1)))).otherwise(none)
                again = F.concat(F.slice(best, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(best, at + 2, F.size(best)))
                return F.struct(merged.alias("ids"), again.alias("best"))

            return _bind(F.coalesce(F.array_min(best), F.lit(_NONE)), lambda low: F.when(low == _NONE, state).otherwise(_bind(F.array_position(best, low).cast("int"), lambda at: merge(low, at))))

        first = F.zip_with(F.slice(ids, F.lit(1), F.size(ids) - 1), F.slice(ids, F.lit(2), F.size(ids)), lambda a, b: self.ranks.lookup(a, b))
        start = F.struct(ids.alias("ids"), first.alias("best"))
        return F.aggregate(F.sequence(F.lit(2), F.size(ids)), start, step)["ids"]

    def known(self, piece: Column) -> Column:
        """The id of a piece that is a token; null of any other."""
        return _bind(F.coalesce(self.words.entry(F.xxhash64(piece)), F.lit(-1)).cast("int"), lambda i: F.when(F.get(self.names, i) == piece, i))

    def fold_piece(self, piece: Column) -> Column:
        """Ids of a piece by folding its bytes."""
        codes = _literal(self.byte_ids, "int")
        return _bind(F.transform(F.split(piece, ""), lambda c: F.get(codes, F.ascii(c))), self.fold)

    def ideographs(self, spark: SparkSession) -> Column:
        """The ids of each ideograph, as a literal in code point order: first + (second + 1) * 2^16 + (third + 1) * 2^32."""
        if self._ideographs is None:
            p = F.col("id")
            octets = [F.shiftright(p, 12).bitwiseOR(0xE0), F.shiftright(p, 6).bitwiseAND(0x3F).bitwiseOR(0x80), p.bitwiseAND(0x3F).bitwiseOR(0x80)]
            rows = spark.range(FIRST, LAST + 1, 1, 1).select("id", self.fold_piece(F.concat(*[F.char(o) for o in octets])).alias("ids")).collect()
            ids = [[*r["ids"], -1, -1][:3] for r in sorted(rows, key=lambda r: r["id"])]
            self._ideographs = _literal([a | b + 1 << 16 | c + 1 << 32 for a, b, c in ids], "bigint")
        return self._ideographs

    def _packed(self, single: Column, piece: Column) -> Column:
        """The packed ids of an ideograph or a token; null of any other piece."""
        bits = lambda i: F.ascii(F.substring(piece, i, 1)).bitwiseAND(0x3F)
        at = F.shiftleft(F.ascii(piece).bitwiseAND(0x0F), 12) + F.shiftleft(bits(2), 6) + bits(3) - FIRST
        lead = F.ascii(piece)
        return F.when((F.length(piece) == 3) & (lead >= 0xE4) & (lead <= 0xE9), _bind(at, lambda i: F.when(i >= 0, F.get(single, i)))).otherwise(self.known(piece).cast("long"))

    def encode(self, df: DataFrame, text: str, ids: str = "ids") -> DataFrame:
        """`df` with the column of ids of a text column."""
        single = self.ideographs(df.sparkSession)

        def unpacked(x: Column) -> Column:
            low = x.bitwiseAND(0xFFFF).cast("int")
            two = lambda: F.shiftright(x, 16).bitwiseAND(0xFFFF).cast("int") - 1
            return F.when(x < 1 << 16, F.array(low)).when(x < 1 << 32, F.array(low, two())).otherwise(F.array(low, two(), F.shiftright(x, 32).cast("int") - 1))

        def of(pieces: Column) -> Column:
            def join(c: Column) -> Column:
                rest = F.array_distinct(F.filter(pieces, lambda p, i: F.get(c, i).isNull()))
                folded = lambda r: F.flatten(F.transform(pieces, lambda p, i: F.when(F.get(c, i).isNotNull(), unpacked(F.get(c, i))).otherwise(F.element_at(r, p))))
                plain = F.flatten(F.transform(c, unpacked))
                return F.when(F.exists(c, lambda x: x.isNull()), _bind(_bind(rest, lambda o: F.map_from_arrays(o, F.transform(o, self.fold_piece))), folded)).otherwise(plain)

            return _bind(F.transform(pieces, lambda p: self._packed(single, p)), join)

        return df.withColumn(ids, F.when(F.length(text) > 0, _bind(self.split(F.col(text)), of)).otherwise(F.array().cast("array<int>")))

    def decode(self, ids: Column) -> Column:
        """The text of ids, from their binary pieces; null for null ids and for ids that aren't in the vocabulary.

        Ids that end inside a character give U+FFFD there.
        """
        pieces = F.transform(ids, lambda i: F.get(self.names, i))
        binary = F.aggregate(pieces, F.lit(b""), lambda have, p: F.concat(have, F.encode(p, "iso-8859-1")))
        octets = F.coalesce(binary, F.lit(b""))
        return F.when(ids.isNotNull() & ~F.exists(pieces, lambda p: F.coalesce(p, F.lit("")) == ""), F.when(F.is_valid_utf8(octets.cast("string")), octets.cast("string")).otherwise(F.make_valid_utf8(octets.cast("string"))))


def _byte_of_character() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: Latin-1's printable bytes are themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
