import pytest

from strandmill.llm.pairs import defects, find_broken_pairs, language

Q = "關於松林市的捷運，去年有哪幾項工程被延後，原因是什麼？"
A = "去年延後的工程有兩項，原因是經費不足。"


@pytest.mark.parametrize(
    "response,prompt,reference,expected",
    [
        (None, Q, None, "empty"), ("", Q, None, "empty"), (" ​\n", Q, None, "empty"), ("（無）", Q, None, "empty"), ("```json\n{}\n```", Q, None, "empty"), ("N/A", Q, None, "empty"), ('""', Q, None, "empty"), ("…", Q, None, "empty"),
        ("很抱歉，我無法回答這個問題。", Q, None, "refusal"), ("I'm sorry, but I can't help with that.", Q, None, "refusal"), ('{"error": "感謝提問，但恕我不便評論。"}', Q, None, "refusal"), ("申し訳ありませんが、お答えできません。", Q, None, "refusal"), ("Lo siento, no puedo ayudar con eso.", Q, None, "refusal"), ("죄송하지만 답변드릴 수 없습니다.", Q, None, "refusal"), ("Je suis désolé, je ne peux pas répondre.", Q, None, "refusal"),
        ("很抱歉前一版有誤，更正如下：工程有兩項。", Q, None, None), ("業者為延誤致歉，坦言無法如期完工。", Q, None, None), ("The crew said sorry for the delay.", "Why was the train late, and who said what about it?", None, None),
        (Q, Q, None, "copied_question"), ("題目：" + Q, Q, None, "copied_question"), (Q.replace("，", ",") + "\n" + Q, Q, None, "copied_question"), ("您問的是：" + Q[:14] + "…… 回答：" + A, Q, None, None), ("TRUE", "判斷：TRUE 或 FALSE", None, None),
        ("The works were delayed because the money was short.", Q, None, "other_language"), ("予算が足りないので、工事は遅れました。", Q, None, "other_language"), ("The works were delayed because the money was short.", Q + "請用英文回答。", None, None), (A, Q + "請用英文回答。", None, "other_language"), ("捷運的 subway 已經延後。", Q, None, None),
        ("去年延後的工程有兩項，原因是經", Q, None, "truncated"), ('```json\n{"category": "sports", "reas', Q, None, "truncated"), ('{"category": "sports", "reasoning": "好。"}', Q, None, None), ("```\n好。", Q, None, "truncated"),
        (A, Q, None, None), ("A", Q, None, None), ("(B)", Q, None, None), ("答案是 C", Q, None, None), ("立場：支持", Q, None, None), ("兩項", Q, '{"answer": "兩項"}', None), (A, None, None, None), (A, "", "broken", None),
    ],
)
def test_rules(response, prompt, reference, expected):
    found = defects(response, prompt, reference)
    assert (found[0] if found else None) == expected


def test_all_defects_are_emitted_and_long_texts_are_read_whole():
    assert defects("I'm sorry, but I cannot give you the answer to this", Q, None) == ["refusal", "other_language", "truncated"]
    assert defects("好。" * 50_000 + "還沒", Q, None) == ["truncated"]


def test_languages():
    texts = {"zh": "今天天氣很好", "en": "the weather is fine today", "fr": "le temps est très beau", "es": "el tiempo es muy bueno hoy", "de": "das Wetter ist heute schön", "pt": "o tempo não está bom", "vi": "hôm nay trời rất đẹp", "ru": "сегодня хорошая погода", "ja": "今日はいい天気です", "ko": "오늘은 날씨가 좋습니다"}
    assert {language(x) for x in texts.values()} == set(texts) and all(language(x) == k for k, x in texts.items()) and language("ok") is None


def test_operator(spark):
    responses = spark.createDataFrame([("1", " I1\n", "", "x", 1), ("1", " I1\n", "", "x", 1), ("2", "none", "", None, 1), ("3", None, "", None, 1), (None, "i1", "", None, 1), ("4", "i2", "好。", "boom", 1)], "id string, benchmark_item_id string, response_text string, error string, item_key int")
    items = spark.createDataFrame([("i1", "舊題", None, 1), ("I1 ", Q, None, 2), ("i2", None, None, 1), (None, Q, None, 1)], "id string, prompt string, reference_answer string, loaded_at int")
    found = find_broken_pairs(responses, items)
    assert {tuple(r) for r in found.select("response_id", "defect_type").collect()} == {("1", "empty")}
    assert find_broken_pairs(responses.limit(0), items).count() == find_broken_pairs(responses, items.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Mi dispiace, ma non posso rispondere a questa domanda.", "Przykro mi, nie mogę odpowiedzieć.", "I would prefer to leave this question unanswered, as it touches on private matters.", "Helaas kan ik deze vraag niet beantwoorden.", "Maaf, saya tidak dapat menjawab pertanyaan ini.", "ขออภัย ไม่สามารถตอบได้", "На жаль, я не можу відповісти."])
def test_refusals_of_more_languages(text):
    assert defects(text, "請說明這項政策的影響。", None)[0] == "refusal"


@pytest.mark.parametrize("text,expected", [("Il gatto dorme sopra il tetto rosso.", True), ("BERT, GPT, LLaMA, Gemma, Mistral", False), ("TRUE", False), ("答案是 TRUE，因為資料充足。", False)])
def test_prose_of_another_script_needs_no_frequent_words(text, expected):
    assert ("other_language" in defects(text, "請說明這項政策的影響。", None)) == expected
