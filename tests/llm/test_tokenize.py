import base64

import pytest
import tiktoken
from pyspark.sql import functions as F

from strandmill.llm.tokenize import PATTERN, TOKENIZERS, Tokenizer

TEXTS = [None, "", " ", "\n\n  \t", "Hello, world's 123 tests!", "今天的天氣很好，覚醒龍契士裏切り。", "の中の魔法の書", "mixed中文text資料123", "emoji 👨‍👩‍👧❤️", "ünïcödé Ελλάδα Привет 한국어", "a" * 300, "<|endoftext|>", "\u0000\u0085 x", "長文。" * 3000, "x  y   z ", "鑑龘爨 𠀀𪚥"]


@pytest.fixture(scope="module")
def tokenizer(spark):
    return Tokenizer()


def test_same_as_the_reference_library_and_round_trip(spark, tokenizer):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "k int, text string, words string")
    for r in tokenizer.encode(df, "text").withColumn("back", tokenizer.decode(F.col("ids"))).collect():
        assert list(r.ids) == own.encode_ordinary(r.text or ""), r.text
        assert r.back == (r.text or "")


def test_decode_of_unknown_ids_and_empty_table(spark, tokenizer):
    df = spark.createDataFrame([([1, 60000],), (None,), ([],)], "ids array<int>")
    assert [r.t for r in df.select(tokenizer.decode(F.col("ids")).alias("t")).collect()] == [None, None, ""]
    assert tokenizer.encode(spark.createDataFrame([], "text string"), "text").count() == 0


def test_decode_of_ids_that_end_inside_a_character(spark, tokenizer):
    half = tokenizer.byte_ids[0xE4]
    df = spark.createDataFrame([([half],), ([tokenizer.byte_ids[0x61], half, tokenizer.byte_ids[0x62]],)], "ids array<int>")
    assert [r.t for r in df.select(tokenizer.decode(F.col("ids")).alias("t")).collect()] == ["\ufffd", "a\ufffdb"]
