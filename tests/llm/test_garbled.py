import random

import numpy as np
import pytest

from strandmill.llm.garbled import LEAST, find_garbled, improbable_runs, maximal_segments, pair_statistics

CLEAN = ["今天的天氣很好，我們去公園散步，孩子們在草地上跑來跑去。", "圖書館在車站旁邊，每天早上九點開門，晚上八點關門。", "The library near the station opens at nine every morning.", "Après l'été, la forêt où l'âge importe peu reste très appréciée.", "El año pasado la película llegó después del otoño.", "Сегодня хорошая погода, и мы гуляем в парке.", "오늘은 날씨가 좋아서 공원에 갔습니다.", "東京の図書館は九時に開きます。", "«Très» dit-elle… l’été 😀 ❤️", ""]


def wrong(text, right="utf-8", read="cp1252"):
    def sloppy(b):
        return b.decode("cp1252") if b not in (b"\x81", b"\x8d", b"\x8f", b"\x90", b"\x9d") else b.decode("latin-1")

    raw = text.encode(right)
    return "".join(sloppy(bytes([b])) for b in raw) if read == "cp1252" else raw.decode(read)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, CLEAN[i % len(CLEAN)], "x") for i in range(400)]
    garbled = {1001: wrong(CLEAN[0]), 1002: wrong(CLEAN[0], read="latin-1"), 1003: CLEAN[1] + wrong(CLEAN[0]), 1004: wrong(wrong(CLEAN[1])), 1005: wrong(CLEAN[0], "big5", "latin-1"), 1006: wrong(CLEAN[1], "gbk", "latin-1"), 1007: "It was itâ€™s day", 1008: "好�的", 1009: wrong("好😀的")}
    df = spark.createDataFrame([*rows, *[(k, v, "x") for k, v in garbled.items()], (2000, None, "x")], "k long, text string, restored string")
    return df, {r.k: r.restored for r in find_garbled(df, "k").collect()}


def test_all_garbled_and_nothing_else(corpus):
    assert set(corpus[1]) == set(range(1001, 1010))


def test_restored_where_nothing_was_lost(corpus):
    found = corpus[1]
    assert found[1001] == found[1002] == CLEAN[0] and found[1003] == CLEAN[1] + CLEAN[0] and found[1004] == CLEAN[1] and found[1005] == CLEAN[0] and found[1006] == CLEAN[1] and found[1007] == "It was it’s day" and found[1008] is None and found[1009] == "好😀的"


def test_empty_blank_long_and_repeated(spark, corpus):
    df = corpus[0]
    assert find_garbled(df.limit(0), "k").count() == 0
    long = CLEAN[0] * 20_000
    more = df.filter("k < 1000").unionByName(spark.createDataFrame([(1, long, "x"), (2, long[:500_000] + wrong(CLEAN[1]), "x"), (3, " \n", "x"), (4, "�", "x"), (4, "�", "x"), (None, "�", "x")], df.schema))
    assert sorted(str(r.k) for r in find_garbled(more, "k").collect()) == ["2", "4", "4", "None"]


class Scores:
    def __init__(self, v):
        self.v = np.array(v, np.float32)

    def improbable(self, points):
        return np.resize(self.v, len(points) - 1)


def by_definition(v, at=0):
    """Maximal scoring segments: the best (the shortest of equals), then those at its left and right."""
    best = max(((round(sum(v[a:b]), 6), a - b, -a) for a in range(len(v)) for b in range(a + 1, len(v) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    return [*by_definition(v[:a], at), (at + a, at + b, best[0]), *by_definition(v[b:], at + b)]


def test_all_maximal_segments():
    r = random.Random(5)
    for _ in range(150):
        v = [r.randint(-200_000, 200_000) / 100_000 for _ in range(r.randint(1, 25))]
        assert [(a, b, round(s, 6)) for a, b, s in maximal_segments(v)] == by_definition(v)


def test_later_segments_of_a_stretch_are_runs():
    v = [-1.0] + [2.0] * 5 + [-2.0] * 3 + [2.0] * 2 + [-1.0]
    assert improbable_runs(["x" * (len(v) + 1)], Scores(v)) == [[(1, 7), (9, 12)]]
    r = random.Random(6)
    for _ in range(100):
        v = [r.randint(-200_000, 200_000) / 100_000 for _ in range(30)]
        assert sorted(improbable_runs(["x" * 31], Scores(v))[0]) == [(a, b + 1) for a, b, s in by_definition(v) if s >= LEAST]


def test_text_that_was_decoded_wrongly_four_times(spark):
    four = wrong(wrong(wrong(wrong(CLEAN[1]))))
    df = spark.createDataFrame([*[(i, CLEAN[i % len(CLEAN)]) for i in range(400)], (1000, four)], "k long, text string")
    assert [(r.k, r.restored) for r in find_garbled(df, "k").collect()] == [(1000, CLEAN[1])]


def test_lost_characters_are_found_by_their_runs(spark):
    texts = ["今天的天氣很好。" * 20] * 30 + ["�", "好�", "�好", "好\x81的", "ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in find_garbled(df, "doc_id").collect()) == [30, 31, 32, 33]


def test_the_table_of_pairs_grows_with_the_corpus(spark):
    """Recall doesn't fall where the first table is far too small for the corpus' pairs."""
    r = random.Random(3)
    sound = ["".join(chr(0x4E00 + r.randrange(600)) for _ in range(200)) for _ in range(60)] + ["今天的天氣很好，我們去公園散步。" * 5] * 40
    broken = [("天氣很好" * 3).encode().decode("cp1252", "replace") if i % 2 else "咖啡很好喝，天氣很好。".encode().decode("latin-1") for i in range(20)]
    df = spark.createDataFrame(list(enumerate(sound + broken)), "doc_id long, text string")
    small, grown = pair_statistics(df, bits=10, most_bits=10), pair_statistics(df, bits=10)
    assert small.bits == 10 and grown.bits > 14
    found = lambda stats: {x.doc_id for x in find_garbled(df, "doc_id", stats=stats).collect()}
    assert found(grown) == found(pair_statistics(df)) == set(range(100, 120))
