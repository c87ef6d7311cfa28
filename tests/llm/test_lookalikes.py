import pytest

from strandmill.llm.lookalikes import consistent, find_disguised, look_alike_groups, skeleton, with_forms


@pytest.mark.parametrize(
    "text,form,kind",
    [
        ("Ａ１ 版", "A1 版", "full-width"), ("ﾄﾞｱ", "ドア", "half-width katakana"), ("oﬃce", "office", "ligature"), ("⼈⽣", "人生", "radical or compatibility ideograph"), ("⻘山", "青山", "radical or compatibility ideograph"), ("\uf900", "\u8c48", "radical or compatibility ideograph"),
        ("café", "café", "not composed"), ("a​b", "ab", "invisible"), ("﻿文", "文", "invisible"), ("soft­hyphen", "softhyphen", "invisible"), ("剪‍輯", "剪輯", "invisible"), ("a b", "a b", "space"), ("a b", "a b", "space"), ("pаge", "page", "mixed scripts"), ("νiew", "view", "mixed scripts"), ("привeт", "привет", "mixed scripts"),
    ],
)
def test_disguises(text, form, kind):
    assert consistent(text) == (form, [kind]) and consistent(form) == (form, [])


@pytest.mark.parametrize("text", ["", "Ordinary text, déjà vu.", "全形標點，「引號」！　縮排", "a\r\nb\tc", "👨‍👩‍👧 ❤️ 1️⃣ 🏴\U000e0067\U000e0062\U000e007f", "привет мир", "αβγ δέλτα", "今日はガラス", "한국어", "tiếng Việt"])
def test_ordinary_text_stays(text):
    assert consistent(text) == (text, [])


def test_operators(spark):
    data = [(1, "paypal", "x"), (2, "pаypаl", "x"), (3, "ｐａｙｐａｌ", "x"), (4, None, "x"), (5, "", "x"), (6, "pay​pal", "x"), (6, "pay​pal", "x"), (7, "other", "x"), (8, "長" * 100_000 + "​", "x")]
    df = spark.createDataFrame(data, "k long, t string, form string")
    assert {r.k for r in find_disguised(df, "k", "t").collect()} == {2, 3, 6, 8}
    groups = look_alike_groups(df, "k", "t").collect()
    assert [(r.n_records, r.n_originals, r.first_key) for r in groups] == [(5, 4, "1")]
    forms = {r.k: (r.f, list(r.kinds)) for r in with_forms(df.drop("form"), "t", "f").collect()}
    assert forms[1] == ("paypal", []) and forms[2][0] == "paypal" and forms[4] == (None, []) and forms[5] == ("", [])
    assert find_disguised(df.limit(0), "k", "t").count() == look_alike_groups(df.limit(0), "k", "t").count() == 0


@pytest.mark.parametrize("text,form", [("na\u0457ve", "naïve"), ("Zo\u0451", "Zoë"), ("f\u03ccrm", "fórm"), ("\u0453adio", "ŕadio"), ("т\u0451мaя", "т\u0451мая"), ("\u0388xample", "Éxample")])
def test_accented_letters_take_the_script_of_their_word(text, form):
    assert consistent(text) == (form, ["mixed scripts"]) and consistent(form) == (form, [])


def test_accented_letters_share_a_skeleton(spark):
    texts = ["Zoë", "Zo\u0451", "\u0396o\u0435\u0308", "Zoe\u0308", "Zoe", "\u03cc", "ó", "\u1f79", "\u041e\u0301", "\u0457", "ï", "\u0439"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    skeletons = {r.k: r.skeleton for r in with_forms(df, "t").collect()}
    assert [skeletons[i] for i in range(len(texts))] == ["Zoë"] * 4 + ["Zoe", "ó", "ó", "ó", "Ó", "ï", "ï", "\u0439"]
    assert sorted(r.n_originals for r in look_alike_groups(df, "k", "t").collect()) == [2, 3, 4]


@pytest.mark.parametrize("text,form", [("a\u2003b", "a b"), ("a-b", "a-b"), ("\u00a0", " "), ("\U0001d400\U0001d7ce", "A0"), ("ﾄﾞ", "ド"), ("e\u0301", "é"), ("\U0001d6c2", "a")])
def test_skeletons_of_single_characters(text, form):
    assert skeleton(text) == form and skeleton(form) == form
