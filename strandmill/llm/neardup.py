"""Near-duplicate texts: banded candidates, sequential Bayesian pruning of signature batches, exact verification.

Similarity is the Jaccard coefficient of the sets of runs of `width` consecutive letters and digits of the lower-case
text. A text has `3 * bands` minhash values in bands of three, and a signature of 128 bits, one from each of 128 minhash
values. Two texts that share a band are a candidate; their signatures are compared in batches of 32 bits, and after each
batch the pair is dropped if the posterior probability of a similarity at the threshold (uniform prior) is below
`miss`. Survivors are verified exactly, on whole texts, so no wrong pair comes out; a right pair is missed with at most
the probability of sharing no band (`band_miss` at the threshold, less above it) plus that of the pruning.

Equal texts are one class. All pair work is done between classes; classes are expanded into pairs of ids only by
`expand_pairs`, which `p2_found` needs; for large corpora `groups` gives a row a text with its class and number of links.

A bucket that more than `split_over` classes share (boilerplate) is banded again: its rows get new buckets from further
minhash values, as many as keep the chance to lose a pair at `band_miss`. After `DEPTH` such rounds a bucket that is still
too large is cut into blocks, and each pair of blocks is a task of its own; nothing is capped. A large bucket's rows
(32 bytes each, no texts) stream through one task once, which passes them on and holds none of them.

Defined results: null texts and texts without a run of `width` letters or digits are in no pair. Rows with a null id are
dropped. An id may have several texts; it is never paired with itself. Repeated rows count once. Empty tables give no
rows. Inner columns are made by select, so names of the input don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandmill.session import cut

WIDTH, THRESHOLD, ROWS_PER_BAND, SIGNATURE, BATCH = 4, 0.6, 3, 128, 32
MISS, BAND_MISS, SPLIT_OVER, DEPTH = 1e-4, 3e-3, 3000, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters_and_digits(column):
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", "")


def bands_for(threshold: float, miss: float, rows: int = ROWS_PER_BAND) -> int:
    """Bands that leave at most `miss` of the pairs at the threshold without a common band."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows)))


@lru_cache
def least_matches(threshold: float, miss: float, size: int = SIGNATURE, batch: int = BATCH) -> tuple[int, ...]:
    """By batch: the fewest equal bits at which P(similarity >= threshold | bits so far) is still at least `miss`."""
    s = np.linspace(0.5, 1, 20001)
    out = []
    for n in range(batch, size + 1, batch):
        for m in range(n + 1):
            with np.errstate(divide="ignore"):
                weight = m * np.log(s) + np.where(n > m, (n - m) * np.log(np.maximum(1 - s, 1e-300)), 0)
            weight = np.exp(weight - weight.max())
            if weight[s >= (1 + threshold) / 2].sum() >= miss * weight.sum():
                out.append(m)
                break
    return tuple(out)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all runs of all texts, and where each text's begin; every text has at least one run."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(points) - width + 1, np.uint64)
    for i in range(width):
        h = (h + points[i : len(points) - width + 1 + i]) * _MIX
        h ^= h >> np.uint64(29)
    counts = lengths - width + 1
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    keep = np.ones(len(h), bool)
    ends = (starts + lengths)[:-1]
    for i in range(1, width):
        keep[ends - i] = False
    return (_mix64(h[keep]) >> np.uint64(32)).astype(np.uint32), np.r_[0, np.cumsum(counts)[:-1]]


def minhashes(hashes: np.ndarray, starts: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Rows of k minhash values; multipliers are fixed by their number and the family."""
    seeds = _mix64(np.arange(1 + family * 1_000_003, 2 * k + 1 + family * 1_000_003, dtype=np.uint64) * _MIX)
    a, b = (seeds[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[k:] >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), k), np.uint32)
    # Pieces that stay in the processor's cache.
    cuts = [0, *np.flatnonzero(np.diff(starts >> 15)) + 1, len(starts)]
    bounds = np.r_[starts, len(hashes)]
    for i, j in zip(cuts, cuts[1:]):
        own, at = hashes[bounds[i] : bounds[j]], starts[i:j] - bounds[i]
        buffer = np.empty_like(own)
        for c in range(k):
            np.multiply(own, a[c], out=buffer)
            np.add(buffer, b[c], out=buffer)
            out[i:j, c] = np.minimum.reduceat(buffer, at)
    return out


def _band_rows(width: int, bands: int):
    """Of batches of (cid, salt, norm): a row (bucket, cid, s1, s2) for each band of each text."""
    k = max(SIGNATURE, bands * ROWS_PER_BAND)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop_duplicates("cid")
            for i in range(0, len(batch), 2000):
                part = batch.iloc[i : i + 2000]
                values = minhashes(*run_hashes(part["norm"].tolist(), width), k)
                bits = ((values[:, :SIGNATURE] * np.uint32(2654435761)) >> np.uint32(31)).astype(np.uint8)
                signature = np.packbits(bits, axis=1).view(np.int64)
                salt = part["salt"].to_numpy(np.int64).astype(np.uint64)
                cid = part["cid"].to_numpy(np.int64)
                buckets = np.empty((len(part), bands), np.uint64)
                for b in range(bands):
                    h = salt + np.uint64((b + 1) * int(_MIX) & 0xFFFFFFFFFFFFFFFF)
                    for r in range(ROWS_PER_BAND):
                        h = _mix64((h + values[:, b * ROWS_PER_BAND + r].astype(np.uint64)) * _MIX)
                    buckets[:, b] = h
                yield pd.DataFrame({"bucket": buckets.view(np.int64).ravel(), "cid": np.repeat(cid, bands), "s1": np.repeat(signature[:, 0], bands), "s2": np.repeat(signature[:, 1], bands)})

    return rows


def _again(width: int, bands: int, family: int):
    """Of batches of (bucket, cid, s1, s2, norm): a row for each band of further minhash values inside the bucket."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 2000):
                part = batch.iloc[i : i + 2000]
                values = minhashes(*run_hashes(part["norm"].tolist(), width), bands * ROWS_PER_BAND, family)
                old = part["bucket"].to_numpy(np.int64).astype(np.uint64)
                buckets = np.empty((len(part), bands), np.uint64)
                for b in range(bands):
                    h = old + np.uint64((b + 1) * int(_MIX) & 0xFFFFFFFFFFFFFFFF)
                    for r in range(ROWS_PER_BAND):
                        h = _mix64((h + values[:, b * ROWS_PER_BAND + r].astype(np.uint64)) * _MIX)
                    buckets[:, b] = h
                yield pd.DataFrame({"bucket": buckets.view(np.int64).ravel(), **{c: np.repeat(part[c].to_numpy(np.int64), bands) for c in ("cid", "s1", "s2")}})

    return rows


def _survivors(s1a, s2a, s1b, s2b, least: tuple[int, ...]) -> np.ndarray:
    """Which pairs pass every batch; later batches look only at those that passed so far."""
    alive, got = np.arange(len(s1a)), np.zeros(len(s1a), np.int64)
    for i, need in enumerate(least):
        a, b = (s1a, s1b) if i < 2 else (s2a, s2b)
        differ = (a[alive] ^ b[alive]).view(np.uint64) >> np.uint64(32 * (i % 2)) & np.uint64(0xFFFFFFFF)
        got = got + BATCH - np.bitwise_count(differ).astype(np.int64)
        keep = got >= need
        alive, got = alive[keep], got[keep]
    return alive


_STEP = 1 << 20


def _pairs_of(i: np.ndarray, j: np.ndarray, cid, s1, s2, least) -> pd.DataFrame:
    keep = cid[i] != cid[j]
    i, j = i[keep], j[keep]
    ok = _survivors(s1[i], s2[i], s1[j], s2[j], least)
    x, y = cid[i[ok]], cid[j[ok]]
    return pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y)}).drop_duplicates()


def _bucket_pairs(least: tuple[int, ...], split_over: int):
    """Of rows in bucket order: surviving pairs of one bucket; of a bucket with too many classes its rows, numbered by block."""

    def flush(run: pd.DataFrame) -> Iterator[pd.DataFrame]:
        bucket, cid, s1, s2 = (run[c].to_numpy(np.int64) for c in ("bucket", "cid", "s1", "s2"))
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        room = np.repeat(starts + sizes, sizes) - np.arange(len(bucket)) - 1  # later rows of the same bucket
        at = np.flatnonzero(room)
        d = 1
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        while len(at):
            held.append((at, at + d))
            n += len(at)
            if n >= _STEP:
                yield _pairs_of(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), cid, s1, s2, least)
                held, n = [], 0
            d += 1
            at = at[room[at] >= d]
        if held:
            yield _pairs_of(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), cid, s1, s2, least)

    def tag(pairs: pd.DataFrame) -> pd.DataFrame:
        return pairs.assign(block=-1, s1=0, s2=0)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        big, block, filled = None, 0, 0  # the bucket whose rows are passed on, its present block and the rows in it
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            batch = batch[~batch.duplicated(["bucket", "cid"])]
            while len(batch):
                if big is not None:
                    own = batch["bucket"].to_numpy() == big
                    n = int(own.sum())
                    if n:
                        at = filled + np.arange(n)
                        yield pd.DataFrame({"x": batch["bucket"][:n], "y": batch["cid"][:n], "block": block + at // split_over, "s1": batch["s1"][:n], "s2": batch["s2"][:n]})
                        filled += n
                    if n == len(batch):
                        batch = batch.iloc[:0]
                        break
                    big, batch = None, batch.iloc[n:]
                bucket = batch["bucket"].to_numpy()
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                sizes = np.diff(np.r_[starts, len(bucket)])
                over = np.flatnonzero(sizes > split_over)
                if len(over):
                    head = batch.iloc[: starts[over[0]]]
                    if len(head):
                        yield from map(tag, flush(head))
                    batch = batch.iloc[starts[over[0]] :]
                    big, block, filled = batch["bucket"].iloc[0], 0, 0
                    continue
                last = starts[-1]  # may go on in the next batch
                if last:
                    yield from map(tag, flush(batch.iloc[:last]))
                batch = batch.iloc[last:]
                break
            rest = batch
        if rest is not None and len(rest):
            yield from map(tag, flush(rest.reset_index(drop=True)))

    return rows


def _block_pairs(least: tuple[int, ...]):
    """All pairs within one block or between two of one bucket; the group is two blocks at most."""

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        cid, s1, s2, left = group["cid"].to_numpy(np.int64), group["s1"].to_numpy(np.int64), group["s2"].to_numpy(np.int64), group["block"].to_numpy() == group["low"].to_numpy()
        same = bool((group["low"] == group["high"]).iloc[0])
        a, b = (np.arange(len(cid)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        out = []
        for at in range(0, len(a), max(1, _STEP // max(1, len(b)))):
            part = a[at : at + max(1, _STEP // max(1, len(b)))]
            i, j = np.repeat(part, len(b)), np.tile(b, len(part))
            if same:
                i, j = i[i < j], j[i < j]
            out.append(_pairs_of(i, j, cid, s1, s2, least))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"x": [], "y": []}, dtype="int64")

    return pairs


def keyed_texts(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """field, id, cid, norm of rows (field, id, text); cid names the class of equal normalised texts of a field."""
    norm = rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).select("field", F.col("id").cast("string").alias("id"), letters_and_digits(F.col("text")).alias("norm"))
    return norm.filter(F.length("norm") >= width).select("field", "id", F.xxhash64("field", "norm").alias("cid"), "norm")


_ROW = "bucket long, cid long, s1 long, s2 long"


def candidate_pairs(keyed: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, band_miss: float = BAND_MISS, width: int = WIDTH, split_over: int = SPLIT_OVER, depth: int = DEPTH) -> DataFrame:
    """x, y: classes of one field that share a band and survive the pruning."""
    least, bands = least_matches(threshold, miss), bands_for(threshold, band_miss)
    rows = keyed.select("cid", F.xxhash64("field").alias("salt"), "norm").mapInPandas(_band_rows(width, bands), _ROW)
    pairs, hot = None, None
    for family in range(depth + 1):
        found = cut(rows.repartition("bucket").sortWithinPartitions("bucket", "cid").mapInPandas(_bucket_pairs(least, split_over), "x long, y long, block int, s1 long, s2 long"))
        own = found.filter("block < 0").select("x", "y")
        pairs = own if pairs is None else pairs.unionByName(own)
        hot = found.filter("block >= 0").select(F.col("x").alias("bucket"), F.col("y").alias("cid"), "block", "s1", "s2")
        if hot.isEmpty():
            return pairs.distinct()
        if family < depth:
            texts = keyed.select("cid", "norm").groupBy("cid").agg(F.first("norm").alias("norm"))
            rows = hot.drop("block").join(texts, "cid").select("bucket", "cid", "s1", "s2", "norm").mapInPandas(_again(width, bands, family + 1), _ROW)
    blocks = hot.groupBy("bucket").agg(F.max("block").alias("last"))
    spread = hot.join(blocks, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return pairs.unionByName(spread.groupBy("bucket", "low", "high").applyInPandas(_block_pairs(least), "x long, y long")).distinct()


def _verify(threshold: float, width: int):
    parts, whole = round(threshold * 1_000_000), 1_000_000

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept: dict[int, set[str]] = {}

            def runs(cid: int, text: str) -> set[str]:
                if cid not in kept:
                    kept[cid] = {text[i : i + width] for i in range(len(text) - width + 1)}
                return kept[cid]

            both, union = [], []
            for x, y, a, b in zip(batch["x"], batch["y"], batch["a"], batch["b"]):
                s, t = runs(x, a), runs(y, b)
                n = len(s & t)
                both.append(n)
                union.append(len(s) + len(t) - n)
            n, u = np.asarray(both, np.int64), np.asarray(union, np.int64)
            keep = n * whole >= u * parts
            yield pd.DataFrame({"x": batch["x"][keep], "y": batch["y"][keep], "similarity": (n / np.maximum(u, 1))[keep]})

    return check


def similar_classes(keyed: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, **options) -> DataFrame:
    """x, y, similarity: pairs of different classes with at least the threshold's similarity, each once (x < y)."""
    pairs = cut(candidate_pairs(keyed, threshold, width=width, **options))
    needed = pairs.select(F.explode(F.array("x", "y")).alias("cid")).distinct()
    texts = keyed.select("cid", "norm").join(needed, "cid", "left_semi").groupBy("cid").agg(F.first("norm").alias("norm"))
    both = pairs.join(texts.select(F.col("cid").alias("x"), F.col("norm").alias("a")), "x").join(texts.select(F.col("cid").alias("y"), F.col("norm").alias("b")), "y")
    return both.select("x", "y", "a", "b").mapInPandas(_verify(threshold, width), "x long, y long, similarity double")


def expand_pairs(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """field, id_a, id_b: pairs of different ids, from pairs of classes and within each class; id_a < id_b."""
    members = keyed.select("field", "cid", "id").distinct()
    other = members.select(F.col("cid").alias("y"), F.col("id").alias("id_y"))
    across = classes.select("x", "y").join(members.select("field", F.col("cid").alias("x"), F.col("id").alias("id_x")), "x").join(other, "y").select("field", "id_x", "id_y").filter("id_x <> id_y")
    within = members.select("field", F.col("cid").alias("y"), F.col("id").alias("id_x")).join(other, "y").filter("id_x < id_y").select("field", "id_x", "id_y")
    return across.unionByName(within).select("field", F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and the sums of two hashes of them: equal for equal sets."""
    h = lambda seed: F.sum(F.xxhash64("x", "y", F.lit(seed)).cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), h(1), h(2)).first())


def connected(edges: DataFrame) -> DataFrame:
    """node, group: the least node of each connected component of (x, y); alternates large and small stars, checkpointed, until nothing changes."""
    e = cut(edges.select("x", "y").filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    before = _mark(e)
    while True:
        around = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = around.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()
        large = cut(large)
        small_least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(small_least, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()
        small = cut(small)
        now = _mark(small)
        if now == before:
            break
        e, before = small, now
    return e.select(F.col("x").alias("node"), F.col("y").alias("group")).unionByName(e.select(F.col("y").alias("node"), F.col("y").alias("group")).distinct())


def groups(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """field, id, class_id, group_id, n_links: one row an id and text; n_links counts the other classes that the text is similar to."""
    members = keyed.select("field", "id", "cid").distinct()
    classes = cut(classes)
    links = classes.select(F.explode(F.array("x", "y")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
    found = connected(classes).select(F.col("node").alias("cid"), F.col("group").alias("group_id"))
    return members.join(links, "cid", "left").join(found, "cid", "left").select("field", "id", F.col("cid").alias("class_id"), F.coalesce("group_id", "cid").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
