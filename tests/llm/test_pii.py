import random

import pytest

from strandmill.llm.pii import SURNAMES, candidates, corpus_words, find, find_kinds, label, put_placeholders, redact, train


@pytest.fixture(scope="module")
def weights():
    return train()


@pytest.mark.parametrize(
    "text,expected",
    [
        ("有問題請寄到 someone.else@mail.example.com 。", "email"), ("write to a_b (at) example [dot] org please", "email"), ("信箱：ａｂ＠example.com", "email"),
        ("電話：0912-345-678", "phone"), ("有事請撥(02)2345-6789，謝謝。", "phone"), ("Call (415) 555-0134 after six.", "phone"), ("line 或 ０９１２３４５６７８ 都可以", "phone"), ("手機 零九一二三四五六七八 晚上才接", "phone"), ("It rang +44 7700 900123 all night.", "phone"), ("電話：0912​345678", "phone"),
        ("身分證字號 A123456789 。", "id_number"), ("證號：ｂ１８２６２２０５９", "id_number"), ("My SSN is 123-45-6789.", "id_number"), ("居留證號 AB12345678", "id_number"),
        ("我家在大安區和平東路二段106號11樓，很好找。", "address"), ("包裹請寄中山路四十五號。", "address"), ("We moved to 12 Maple Grove Street, Apt 3 in spring.", "address"),
        ("聯絡人：歐陽思涵", "name"), ("昨晚和林怡君一起看首映。", "name"), ("謝謝陳志豪先生幫忙。", "name"), ("My name is Rowan Ellsworth.", "name"), ("Regards, Ellsworth, Rowan", "name"),
    ],
)
def test_kinds(weights, text, expected):
    assert {k for _, _, k in find(text, weights)} == {expected}


@pytest.mark.parametrize("text", ["", "訂單 20240315-0098 已出貨。", "貨號 B12345678 缺貨中。", "條碼 4710000123457 掃不到。", "版本 10.4.2.17 昨晚釋出。", "比數 102-98，觀眾 11250 人。", "2024/03/15 19:30 開演", "item AB123456 is sold out", "lr 0.0003 at step 120000", "推 @管理員 處理一下", "捷運和高中老師都在，白天與平常一樣。", "The plan by the Heron Guild was kept.", "第3號颱風", "增加到4419件"])
def test_look_alikes(weights, text):
    assert find(text, weights) == []


def test_skip_edges_carry_a_name_to_its_bare_mention(weights):
    text = "聯絡人：林怡君\n" + "今天的公園很安靜。" * 30 + "林怡君又來了。"
    assert [text[a:b] for a, b, k in find(text, weights) if k == "name"] == ["林怡君", "林怡君"]


def test_replacement_keeps_the_rest(weights):
    text = "聯絡人：林怡君，電話：0912-345-678。"
    assert put_placeholders(text, find(text, weights)) == "聯絡人：[NAME]，電話：[PHONE]。" and label([], weights) == [] and candidates("") == []


def test_operators(spark):
    data = [(1, "電話：0912-345-678", "x"), (1, "電話：0912-345-678", "x"), (2, None, "x"), (3, "", "x"), (None, "電話：0912-345-678", "x"), (4, "安靜。" * 50_000 + "證號：A123456789", "x")]
    df = spark.createDataFrame(data, "k long, text string, kinds string")
    assert {tuple(r) for r in find_kinds(df, "k", "text").collect()} == {("1", "phone"), ("4", "id_number")}
    found = redact(df, "k", "text").collect()
    assert len(found) == 6 and {r.redacted for r in found if r.k == 2} == {None} and {r.redacted for r in found if r.k == 3} == {""}
    assert find_kinds(df.limit(0), "k", "text").count() == redact(df.limit(0), "k", "text").count() == 0


@pytest.mark.parametrize("text,name", [("王小明昨天打給我", "王小明"), ("昨天陳怡君在車站等了兩小時", "陳怡君"), ("桑硯凜昨天買票", "桑硯凜"), ("Rowan Ellsworth lives next door to us", "Rowan Ellsworth"), ("The manager, Priya Raman, approved it", "Priya Raman"), ("Please forward this to Rowan Ellsworth today", "Rowan Ellsworth"), ("山田太郎さんが来た", "山田太郎"), ("어제 김민수가 전화했다", "김민수"), ("Вчера Иван Петров позвонил мне", "Иван Петров")])
def test_names_without_a_cue(weights, text, name):
    assert [text[a:b] for a, b, k in find(text, weights) if k == "name"] == [name]


def test_a_number_with_a_letter_apart(weights):
    text = "證件號碼 F 131 104 093"
    assert [text[a:b] for a, b, k in find(text, weights)] == ["F 131 104 093"]


# Wordings that are in no training text, and values that are put together here.
HELD_OUT = {
    "han": (lambda r: r.choice(SURNAMES[:150]) + r.choice("志家雅怡俊冠佩淑明國美秀建文宗") + r.choice("豪偉婷君慧玲華英傑宏榮芬翔"), ["{}買了三張車票。", "今天輪到{}值日。", "桌上的杯子屬於{}。", "後來{}搬到南部。", "大概只有{}記得密碼。", "下週{}會出國。", "{}把腳踏車修好了。", "醫生建議{}多休息。", "門口站著{}。", "誰知道{}去哪裡？"], 0.8),
    "latin": (lambda r: r.choice("Rowan Priya Oscar Ingrid Tobias Maeve Quentin Selma Idris Noor".split()) + " " + r.choice("Ellsworth Raman Lindqvist Okafor Delacroix Hargreave Tanaka Whitlock Moreau Szabo".split()), ["{} baked bread this morning.", "The umbrella is {}'s.", "Nobody told {} about it.", "Our plumber {} fixed the tap.", "Two of us, {} included, stayed late.", "Did {} really say so?", "A postcard for {} came.", "Later {} apologised.", "It was {} who sang.", "Everyone applauded {}."], 0.7),
    "kana": (lambda r: r.choice(["佐藤", "鈴木", "田中", "渡辺", "小林", "吉田"]) + r.choice(["花子", "一郎", "美咲", "健太", "さくら"]), ["{}が笑った。", "先週{}に会いました。", "{}も来る予定です。", "{}さんへ", "これは{}の本です。"], 0.8),
    "hangul": (lambda r: r.choice("김이박최정") + r.choice("민서준지현영") + r.choice("수호진희우아"), ["{}가 웃었다.", "지난밤 {}를 만났다.", "{} 님이 보냈습니다.", "이 책은 {}의 것이다.", "{}도 온다."], 0.9),
    "cyrillic": (lambda r: r.choice("Иван Анна Дмитрий Ольга Сергей".split()) + " " + r.choice("Кузнецов Соколова Попов Лебедева Новиков Морозова".split()), ["Сегодня {} опоздал.", "Книгу принёс {}.", "{} улыбается.", "Я видел, как {} ушёл.", "Письмо для {} пришло."], 0.9),
}


@pytest.mark.parametrize("script", HELD_OUT)
def test_recall_on_held_out_wording(weights, script):
    made, frames, least = HELD_OUT[script]
    r = random.Random(11)
    hit = 0
    for i in range(200):
        name = made(r)
        text = frames[i % len(frames)].format(name)
        hit += name in {text[a:b] for a, b, k in find(text, weights) if k == "name"}
    assert hit >= 200 * least


@pytest.mark.parametrize("text", ["桌椅都收好了，天空很藍。", "高雄的金融機構安排了文化展覽。", "方法很簡單，白天再試一次。", "關於程式的安全，應該沒有問題。", "The Royal Garden Hotel is near Market Street.", "In Spring Valley it rained.", "On Monday the Northern Line closed.", "Im Sommer war die Alte Brücke gesperrt.", "渋谷の店はまだ開いていた。", "서울역에서 기차를 탔다.", "Красная Площадь закрыта.", "黃昏時分溫度下降", "馬上連絡管理中心"])
def test_ordinary_text_of_other_wording(weights, text):
    assert find(text, weights) == []


def test_skip_edges_change_labels(weights):
    """Mentions in places that speak neither for nor against a name follow those with a cue."""
    with_skip = without = 0
    r = random.Random(5)
    for family in SURNAMES[:100]:
        name = family + r.choice("谷澤崙澗霧")
        text = f"聯絡人：{name}先生\n謝謝{name}先生。\n" + "桌椅都收好了。" * 10 + f"今天{name}的"
        with_skip += text.count(name) == len(find(text, weights))
        without += text.count(name) == len(find(text, weights, skip=False))
    assert with_skip > without


def test_words_of_a_corpus(spark):
    texts = spark.createDataFrame([("供應鏈和電池。" * 3,)] * 4 + [(None,), ("",)], "text string")
    assert {"供應", "電池"} <= corpus_words([texts]) and corpus_words([texts.limit(0)]) == set()
