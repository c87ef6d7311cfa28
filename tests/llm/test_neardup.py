import random

import numpy as np

from strandmill.llm import neardup

SCHEMA = "field string, id string, text string, cid int"


def texts(seed=1, groups=30, copies=4):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(400)]
    out = []
    for g in range(groups):
        base = [r.choice(words) for _ in range(r.randint(20, 80))]
        for c in range(copies):
            own = list(base)
            for _ in range(r.randint(0, 8)):
                own[r.randrange(len(own))] = r.choice(words)
            if r.random() < 0.3:
                own = own[len(own) // 3 :] + own[: len(own) // 3]
            out.append((f"g{g:03}c{c}", " ".join(own)))
    return out


def brute(rows, threshold=0.6, width=4):
    sets = []
    for i, t in rows:
        n = "".join(c for c in t.lower() if c.isalnum())
        s = {n[k : k + width] for k in range(len(n) - width + 1)}
        if s:
            sets.append((i, s))
    return {(min(a, b), max(a, b)) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if a != b and 10 * len(s & t) >= threshold * 10 * len(s | t)}


def frame(spark, rows, field="f"):
    return spark.createDataFrame([(field, i, t, 0) for i, t in rows], SCHEMA)


def found(spark, df, **options):
    keyed = neardup.keyed_texts(df)
    return {(r.id_a, r.id_b) for r in neardup.expand_pairs(keyed, neardup.similar_classes(keyed, **options)).collect()}


def test_against_brute_force(spark):
    rows = texts()
    expected, got = brute(rows), found(spark, frame(spark, rows))
    assert got <= expected and len(got) >= 0.99 * len(expected) > 30


def test_hot_buckets_in_blocks_lose_nothing(spark):
    rows = texts(seed=2, groups=2, copies=60)
    assert found(spark, frame(spark, rows), split_over=5, depth=0) == found(spark, frame(spark, rows))


def test_nulls_short_equal_repeated_and_fields(spark):
    long = "Σχεδόν ίδιο κείμενο, " * 3000
    rows = [("a", None), ("b", ""), ("c", "abc"), ("d", "Same text here!"), ("e", "same TEXT, here"), ("e", "same TEXT, here"), ("d", "another one of d"), ("x", long), ("y", long + "!"), (None, "same text here")]
    assert found(spark, frame(spark, rows)) == {("d", "e"), ("x", "y")}
    other = frame(spark, [("d", "same text here")], "g").unionByName(frame(spark, [("e", "same text here")], "h"))
    assert found(spark, other) == set() and found(spark, frame(spark, [])) == set()


def test_groups_and_components(spark):
    rows = texts(seed=3, groups=5)
    keyed = neardup.keyed_texts(frame(spark, rows + [("alone", "nothing like the others at all")]))
    result = {r.id: r for r in neardup.groups(keyed, neardup.similar_classes(keyed)).collect()}
    parent = {i: i for i, _ in rows}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in brute(rows):
        parent[root(a)] = root(b)
    assert all((result[a].group_id == result[b].group_id) == (root(a) == root(b)) for a, _ in rows for b, _ in rows)
    assert result["alone"].n_links == 0 and len(result) == len(rows) + 1
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (5, 5)], "x long, y long")
    assert {(r.node, r.group) for r in neardup.connected(edges).collect()} == {(i, 0) for i in range(21)} | {(100, 100), (101, 100)}


def test_bounds():
    least = neardup.least_matches(0.6, 1e-4)
    assert list(least) == sorted(least) and least[-1] < 0.8 * 128 and neardup.bands_for(0.6, 3e-3) == 24
    h, starts = neardup.run_hashes(["abcde", "bcde"], 4)
    assert len(h) == 3 and list(starts) == [0, 2] and h[1] == h[2] and neardup.minhashes(h, starts, 8).shape == (2, 8)
    a = np.zeros(1, np.int64)
    assert list(neardup._survivors(a, a, a, a, least)) == [0] and list(neardup._survivors(a, a, ~a, ~a, least)) == []


def test_boilerplate_is_banded_again(spark):
    """Thousands of texts with one long head share buckets; pairs of blocks are not all compared, and near-duplicates are found."""
    r = random.Random(9)
    head = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    word = lambda: "".join(r.choice("ijklmnopqrstuvwxyz") for _ in range(7))
    rows, wanted = [], set()
    for i in range(800):
        tail = [word() for _ in range(60)]
        rows.append((f"t{i:05}", head + " " + " ".join(tail)))
        if i % 10 == 0:
            tail[r.randrange(60)] = word()
            rows.append((f"u{i:05}", head + " " + " ".join(tail)))
            wanted.add((f"t{i:05}", f"u{i:05}"))
    df = frame(spark, rows)
    keyed = neardup.keyed_texts(df)
    got = {(x.id_a, x.id_b) for x in neardup.expand_pairs(keyed, neardup.similar_classes(keyed, split_over=50)).collect()}
    assert len(got & wanted) >= 0.99 * len(wanted) and got == wanted | (got - wanted) and len(got) < 3 * len(wanted)
    left = neardup.candidate_pairs(keyed, split_over=50)
    assert left.count() < 880 * 879 // 20
