"""Broken prompt and response pairs.

Ordered rules on each response and the prompt and reference answer of its item; every rule that holds is emitted, and
the first is the pair's type:

  empty           null, blank or invisible text, nothing but marks and brackets, or a null-like placeholder
  refusal         declines to answer, in any of twenty languages, also inside JSON, quotes or a code fence
  copied_question only repeats the prompt, its question or its text, up to case, spacing, punctuation and a short label
  other_language  the prose is in another language than the prompt's, or than the one that the prompt asks for
  truncated       an unclosed delimiter or fence, broken JSON, or an end without the end of a sentence

Defined results: ids are compared without case and surrounding white space. A response without an item, or with a null
id, is in no result. Of items that share an id the last loaded counts (then the greatest text). A null prompt or
reference answer rules nothing out: the rules that need it don't hold. The response's error decides nothing, as a
complete text is sound whatever it says. Repeated rows come out once each. Very long texts are read whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandmill.functions.keys import comparable_key
from strandmill.operators.skew import salted_join

DEFECTS = ("empty", "refusal", "copied_question", "other_language", "truncated")

# Placeholders for no answer, in lower case, letters and digits only.
_PLACEHOLDERS = {"", "na", "null", "none", "nil", "nan", "undefined", "empty", "blank", "tbd", "todo", "noanswer", "noresponse", "nocontent", "notavailable", "notapplicable", "missing", "void", "json", "無", "无", "空", "空白", "沒有", "没有", "無內容", "无内容", "無回應", "無回答", "無資料", "未提供", "未回答", "なし", "無し", "該当なし", "空欄", "없음", "нет", "ninguno", "ninguna", "nada", "aucun", "aucune", "rien", "keine", "kein", "leer", "nenhum", "vazio", "không", "không có", "trống"}

_APOLOGY = (
    r"(?:(?:非常|十分|真的|實在|很)?(?:抱歉|對不起|对不起|不好意思|遺憾|遗憾)|感謝(?:您|你)?的?(?:提問|詢問|來信)|感谢(?:您|你)?的?(?:提问|询问)|謝謝(?:您|你)?的?(?:提問|詢問)|谢谢(?:您|你)?的?(?:提问|询问)"
    r"|(?:i\s*(?:am|['’]m)|we\s*(?:are|['’]re))?\s*(?:so|very|really|truly|terribly)?\s*(?:sorry|afraid)|(?:my\s+|our\s+)?apologies|i apologi[sz]e|unfortunately|regrettably|thank(?:s| you) for (?:asking|your (?:question|interest|request))"
    r"|(?:大変)?申し訳(?:ありません|ございません|ない)(?:が|けど)?|すみません(?:が)?|ごめんなさい|恐れ入りますが|残念ながら|죄송(?:합니다|하지만|해요)|미안(?:합니다|하지만)|유감스럽지만"
    r"|(?:je suis )?(?:vraiment )?(?:désolée?|navrée?)|malheureusement|lo siento(?: mucho)?|lamentablemente|por desgracia|desafortunadamente|perdón|es tut mir leid|tut mir leid|leider|entschuldigung|entschuldigen sie|(?:peço )?desculpas?|desculpe|lamento|infelizmente"
    r"|(?:tôi )?(?:rất )?(?:xin lỗi|tiếc)|rất tiếc|к сожалению|извините|простите|прошу прощения"
    r"|(?:mi )?(?:dispiace|scus[ai])|purtroppo|przykro mi|przepraszam|niestety|het spijt me|helaas|sorry|üzgünüm|maalesef|ne yazık ki|tyvärr|jag är ledsen|beklager|desværre|maaf|mohon maaf|sayangnya|ขออภัย|ขอโทษ|عذر[اًا]+|آسف|للأسف|क्षमा करें|माफ़ करें|на жаль|вибачте|bohužel|omlouvám se|sajnálom)"
)
_LEAD = r"(?:as an? (?:ai|artificial intelligence|large language|language)[\w\s-]{0,30}|(?:身為|作為|作为|身为)(?:一個|一个|一名)?(?:AI|人工智慧|人工智能|大型語言|語言|语言)?(?:模型|助理|助手|系統)?|(?:en tant qu['’]|como |als |на правах )[\w\s]{0,30}|でも|しかし|但是?|不過|然而|but|however|mais|pero|aber|mas|ma|però|ale|maar|ama|men|tapi|tetapi|แต่|लेकिन|але|nhưng|но)"
_CORE = (
    # Chinese
    r"(?:恕?(?:我們?|我们|本人|本助理|本系統)?(?:實在|目前|暫時|確實|並|也|還是|对此|對此|對這題|這題|這個問題|此題)*(?:無法|无法|不能|沒辦法|没办法|沒有辦法|不便|不方便|難以|难以|不會|不会|不願|不想|不宜|不予|拒絕|拒绝|婉拒|謝絕|選擇略過|选择略过|選擇跳過|選擇不|没有立场|沒有立場|無權|不具備|不具备|沒有權限|没有权限|不被允許|未獲授權))"
    r"|(?:請|恕|容)+(?:容|恕|原諒)?我?(?:不|略過|跳過|拒絕|婉拒)(?:作答|回答|評論|便|予|談|討論|提供)?"
    r"|(?:這個?|此|該|这个?|相關|相关|本)(?:主題|問題|題目?|內容|要求|請求|話題|主题|问题|题|内容|请求|话题)[^。！？\n]{0,10}(?:超出|違反|违反|不在我|不宜|不適合|不便|無法|无法|選擇略過|略過|跳過|涉及敏感|恕)"
    r"|回答(?:這|此|该|这)(?:類|类|個|个|題|题)?(?:題目|題|問題|问题)?[^。！？\n]{0,4}(?:並?不恰當|并?不恰当|並?不合適|不妥)|恕(?:難|不|無法)"
    # English
    r"|(?:i|we)\s*(?:['’]m|am|are|['’]re)?\s*(?:really |simply |just |currently |still )?(?:can\s*not|can['’]?t|could\s*n[o'’]t|could not|unable|not able|not (?:comfortable|allowed|permitted|authorized|in a position|going)|won['’]?t|will not|(?:must|have to|need to|shall|would like to|will|['’]ll|['’]d (?:rather|prefer to)) (?:respectfully |politely )?(?:decline|refuse|pass|skip|abstain|not)|decline|refuse|do not (?:feel|have (?:access|permission|the authority))|don['’]?t (?:feel|have (?:access|permission|the authority))|prefer not|would rather not|would prefer not)"
    r"|(?:it|this|that|answering|responding|doing so)(?: here| to (?:this|that))?\s*(?:would|is|goes|violates|falls|may|might|could|isn['’]t)\s*[^.!?\n]{0,24}(?:against (?:my|our|the)|outside (?:my|our|the|of)|beyond (?:my|our|the)|not (?:be )?(?:appropriate|something)|inappropriate|something (?:i|we) (?:can\s*not|can['’]t|won['’]t)|violate)"
    r"|(?:i|we)(?:['’]d| would) (?:prefer|rather|like|choose) (?:not|to (?:leave|skip|pass|decline|abstain|refrain))|(?:this|that|the) question (?:will|must|should|is best|shall) (?:be )?(?:left|remain|go) unanswered|let (?:us|me)['’]? (?:skip|pass)|let['’]?s (?:skip|pass)|no comment|(?:please )?(?:allow|excuse) me (?:from|to (?:skip|decline|pass))|my guidelines|i['’]d rather not"
    # Japanese, Korean
    r"|[^。！？\n]{0,24}(?:お答え|回答|お手伝い|対応|お力|コメント|説明|お話し|提供|協力)[^。！？\n]{0,6}(?:できません|できかねます|いたしかねます|しかねます|出来ません|控え|差し控え|辞退|遠慮)|[^.!?\n]{0,24}(?:답변|답|대답|도와|도움|응답|제공|말씀)[^.!?\n]{0,8}(?:수 없|어렵|않겠|거절|삼가)"
    # French, Spanish, German, Portuguese, Vietnamese, Russian
    r"|je (?:ne (?:peux|puis|suis|souhaite|veux|saurais|préfère)|n['’]ai pas le droit|refuse|dois (?:refuser|décliner)|préfère ne pas)|(?:no (?:puedo|podemos|me es posible|estoy (?:autorizad|en condiciones)|debo|voy a|deseo)|prefiero no|debo rechazar|me niego)"
    r"|(?:ich|wir) (?:kann|können|darf|dürfen|möchte|werde|muss)\b[^.!?\n]{0,50}(?:nicht|ablehnen|keine|verweigern)|(?:kann|darf) ich\b[^.!?\n]{0,50}(?:nicht|keine)|(?:eu )?(?:não (?:posso|consigo|podemos|me é possível|devo|vou|estou autorizad)|prefiro não|recuso|devo recusar)"
    r"|(?:tôi|chúng tôi|mình) (?:không (?:thể|được phép|có quyền|muốn)|xin phép không|phải từ chối|từ chối)|(?:я |мы )?(?:не (?:могу|можем|буду|вправе|имею права)|вынужден[аы]? отказать|отказываюсь|предпоч[её]л[аи]? бы не)"
    # Italian, Polish, Dutch, Turkish, Swedish and Norwegian, Indonesian, Thai, Arabic, Hindi, Ukrainian, Czech
    r"|(?:io )?non (?:posso|possiamo|sono in grado|mi è possibile|intendo|desidero)|preferisco non|devo rifiutare|nie (?:mogę|możemy|jestem w stanie|chcę)|odmawiam|wolę nie"
    r"|(?:(?:ik|wij|we) (?:kan|kunnen|mag|mogen|wil|zal)|(?:kan|mag|zal) ik|kunnen (?:wij|we))\b[^.!?\n]{0,50}(?:niet|geen)|[^.!?\n]{0,60}(?:yanıt ver|cevap ver|cevapla|yanıtla|yardımcı ol)(?:em(?:em|iyorum|eyiz|eyeceğim)|miyorum)|(?:jag|vi|jeg) (?:kan|får|vil|vill|må)\b[^.!?\n]{0,40}(?:inte|ikke|avstå|avböja)"
    r"|(?:saya|kami) (?:tidak (?:dapat|bisa|boleh|akan)|menolak|harus menolak)|(?:ฉัน|ผม|ดิฉัน|เรา)?(?:ไม่สามารถ|ไม่อาจ|ขอไม่)|(?:أنا )?لا (?:أستطيع|يمكنني|نستطيع|أقدر)|(?:मैं|हम)[^।\n]{0,60}(?:नहीं (?:दे|कर) सकत|असमर्थ)|(?:я |ми )?не (?:можу|можемо|буду)|(?:nemohu|nemůžu|nemůžeme|odmítám)"
)
_REFUSAL = re.compile(rf"^[\s\W_]*(?:(?:{_APOLOGY}|{_LEAD})[\s\W_]*)*(?:{_CORE})", re.I)
# Apologies that go on with an answer: corrections of an earlier one.
_SOUND_APOLOGY = re.compile(r"更正如下|更正為|修正如下|正確(?:答案|版本)|corrected (?:version|answer)|here is the (?:answer|correct)|here['’]s the", re.I)

_FENCE = re.compile(r"^\s*```[A-Za-z0-9_-]*[ \t]*\n?|\n?[ \t]*```\s*$")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
_LETTERS = re.compile(r"[\W_]+")
_LABEL = re.compile(r"^\s*[^\n:：]{1,14}[:：]\s*")


def _plain(text: str) -> str:
    return _LETTERS.sub("", unicodedata.normalize("NFKC", text).lower())


def unwrapped(text: str) -> tuple[str, object]:
    """Text without invisible characters and a code fence, and its JSON value if it is an object, a list or a string."""
    body = _INVISIBLE.sub("", text)
    body = _FENCE.sub("", _FENCE.sub("", body, count=1)) if "```" in body else body
    stripped = body.strip()
    if stripped[:1] in ("{", "[", '"'):
        try:
            return body, json.loads(stripped)
        except ValueError:
            pass
    return body, None


def _strings(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [s for v in value.values() for s in _strings(v)]
    if isinstance(value, list):
        return [s for v in value for s in _strings(v)]
    return [] if value is None else [json.dumps(value)]


def is_empty(body: str, value: object) -> bool:
    if _plain(body) in _PLACEHOLDERS:
        return True
    return isinstance(value, (dict, list)) and all(_plain(s) in _PLACEHOLDERS for s in _strings(value))


def is_refusal(body: str, value: object) -> bool:
    texts = _strings(value) if value is not None else [body]
    return any(_REFUSAL.match(t) and not _SOUND_APOLOGY.search(t) for t in texts)


def _parts(prompt: str, reference: str | None) -> list[str]:
    """The prompt and those of its parts that can be repeated by themselves."""
    lines = [x for x in prompt.split("\n") if x.strip()]
    out = [prompt, "\n".join(lines[1:]), "\n".join(lines[:-1]), "\n".join(lines[1:-1]), *(x for x in lines if re.search(r"[?？]\s*\S{0,12}$", x))]
    try:
        own = json.loads(reference) if reference else None
    except ValueError:
        own = None
    if isinstance(own, dict):
        out += [str(own[k]) for k in ("question", "statement", "topic") if isinstance(own.get(k), str)]
    return [p for p in out if p.strip()]


@lru_cache(8192)
def _plain_parts(prompt: str, reference: str | None) -> tuple[str, frozenset[str]]:
    return _plain(prompt), frozenset(p for x in _parts(prompt, reference) for y in (x, _LABEL.sub("", x, count=1)) if len(p := _plain(y)) >= 8)


def is_copy(body: str, value: object, prompt: str | None, reference: str | None) -> bool:
    if not prompt:
        return False
    text = value if isinstance(value, str) else body
    if isinstance(value, (dict, list)):
        text = " ".join(_strings(value))
    whole, parts = _plain_parts(prompt, reference)
    for candidate in {_plain(text), _plain(_LABEL.sub("", text, count=1))}:
        if len(candidate) < 8:
            continue
        half = len(candidate) // 2
        if len(candidate) % 2 == 0 and candidate[:half] == candidate[half:]:
            candidate = candidate[:half]
        if candidate in parts or candidate in whole and 2 * len(candidate) >= len(whole) and len(candidate) >= 16:
            return True
        # The prompt between a few more characters, or a part of it twice.
        if len(whole) >= 16 and whole in candidate and len(candidate) <= len(whole) + 8 or any(len(p) >= 16 and candidate == p + p for p in parts):
            return True
    return False


# Frequent short words of languages in Latin letters; fixed values.
_WORDS = {
    "en": "the of and to in is was were a an that for it on with as by at be this which when who how did each near but never some after about before they their our its not or are has have been from while what why neither nor",
    "fr": "le la les des et est dans que qui pour sur au aux une un du ne pas plus avec ce cette sont été était par mais ou où se sa son à l d en",
    "es": "el la los las de y es en que por con para una un del se no más pero como su al lo fue está son según también todavía",
    "de": "der die das und ist nicht ein eine zu den von mit auf für sich dem auch es im wird war wurde über bei noch nach wie aber man hieß",
    "pt": "o a os as de e é em que por com para uma um do da se não mais mas como seu ao está são foi também ainda ficou nas no na",
    "vi": "là và của không có được một các những cho với đã này trong rất khi để đến từ tuần hôm qua chưa hơn lần mùa trước",
}
_WORD_SETS = {k: frozenset(v.split()) for k, v in _WORDS.items()}
_MARK_LETTERS = {"vi": "ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ", "es": "ñ¿¡", "de": "äöüß", "fr": "çèêëîïôœùû", "pt": "ãõ"}
_MARKS = {k: re.compile(f"[{v}]") for k, v in _MARK_LETTERS.items()}
# Names of languages in prompts; fixed values.
_NAMES = {"英文": "en", "英語": "en", "英语": "en", "english": "en", "中文": "zh", "華語": "zh", "国语": "zh", "國語": "zh", "漢語": "zh", "汉语": "zh", "chinese": "zh", "mandarin": "zh", "日文": "ja", "日語": "ja", "日语": "ja", "japanese": "ja", "韓文": "ko", "韓語": "ko", "韩语": "ko", "korean": "ko", "法文": "fr", "法語": "fr", "法语": "fr", "french": "fr", "德文": "de", "德語": "de", "德语": "de", "german": "de", "西班牙文": "es", "西班牙語": "es", "spanish": "es", "葡萄牙文": "pt", "葡萄牙語": "pt", "portuguese": "pt", "俄文": "ru", "俄語": "ru", "russian": "ru", "越南文": "vi", "越南語": "vi", "vietnamese": "vi"}
_ASKED = re.compile(rf"(?:用|以|使用|改以|翻成|譯成)\s*({'|'.join(k for k in _NAMES if not k.isascii())})|\b(?:in|into|using|to)\s+(?:plain |simple |traditional |simplified )?({'|'.join(k for k in _NAMES if k.isascii())})\b", re.I)
_SHORT_LABELS = re.compile(r"\b(?:TRUE|FALSE|true|false|[A-Da-d])\b|\([A-Da-d]\)|```\w*|\b(?:JSON|json)\b")
_SCRIPTS = {"ja": re.compile("[ぁ-ゖァ-ヺ]+"), "ko": re.compile("[가-힣ᄀ-ᇿ]+"), "ru": re.compile("[Ѐ-ӿ]+"), "zh": re.compile("[㐀-鿿\U00020000-\U0002fa1f]+")}
_WORD = re.compile("[a-zÀ-ɏḀ-ỿ]+")


def language(text: str, least: int = 4) -> str | None:
    """The language of most of a text's letters; null if there are too few to tell."""
    counts = {k: sum(map(len, pattern.findall(text))) for k, pattern in _SCRIPTS.items()}
    words: list[str] = _WORD.findall(text.lower())
    latin = sum(map(len, words))
    if counts["ja"] * 5 >= counts["zh"] and counts["ja"] >= 3 and counts["ja"] + counts["zh"] > latin:
        return "ja"
    script, most = max(counts.items(), key=lambda x: x[1])
    # An ideograph says about as much as two or three letters.
    weights = {"zh": 2.5, "ko": 2.5, "ru": 1.0, "ja": 2.0}
    if most * weights[script] > latin:
        return script if most >= least else None
    if len(words) < 3 or latin < 10:
        return None
    lower = text.lower()
    scores = {k: sum(map(s.__contains__, words)) + (2.0 * len(_MARKS[k].findall(lower)) if k in _MARKS else 0.0) for k, s in _WORD_SETS.items()}
    best = max(scores, key=scores.get)
    return best if scores[best] > 0 and scores[best] >= 1.2 * max((v for k, v in scores.items() if k != best), default=0) else None


@lru_cache(8192)
def wanted_language(prompt: str) -> str | None:
    """The language that a prompt asks for, else its own."""
    asked = [m for m in _ASKED.finditer(prompt)]
    if asked:
        return _NAMES[(asked[-1].group(1) or asked[-1].group(2)).lower()]
    return language(prompt, 2)


def _prose(body: str, value: object) -> str:
    if isinstance(value, dict):
        texts = [s for k, v in value.items() if k.lower() not in ("category", "sentiment", "label", "answer", "type") for s in _strings(v)] or _strings(value)
    else:
        texts = _strings(value) if value is not None else [re.sub(r'"\w+"\s*:\s*(?:"\w*"\s*,)?', " ", body) if body.lstrip().startswith("{") else body]
    return _SHORT_LABELS.sub(" ", "\n".join(texts))


def _latin_prose(text: str) -> bool:
    """Whether most letters are Latin and make prose: several words, most of them in lower case."""
    words = re.findall("[A-Za-zÀ-ɏḀ-ỿ]+", text)
    latin = sum(map(len, words))
    others = sum(sum(map(len, p.findall(text))) for p in _SCRIPTS.values())
    return len(words) >= 4 and latin >= 16 and latin > 3 * others and 2 * sum(w.islower() for w in words) > len(words)


def is_other_language(body: str, value: object, prompt: str | None) -> bool:
    """Another language, or, where that can't be told, prose in another script."""
    wanted = wanted_language(prompt) if prompt else None
    if wanted is None:
        return False
    prose = _prose(body, value)
    found = language(prose)
    return found != wanted if found is not None else wanted in _SCRIPTS and _latin_prose(prose)


_CLOSED = re.compile(r"(?:[。．.!！?？…~～;；:：‼⁉｡♪♥❤︎☀-➿\U0001f000-\U0001faff‍️]|[」』）)\]】》〉”’\"'`*_}])\s*$")
_OPTION = re.compile(r"^\W*(?:(?:答案|正解|選項|answer|option|the answer)\s*(?:是|為|为|is|:|：)?\s*)?\W*(?:[A-Ha-h]|[甲乙丙丁]|[0-9]{1,3}|TRUE|FALSE|true|false|True|False|YES|NO|Yes|No|yes|no|是|否|對|錯|对|错|正確|錯誤|正确|错误)\W*$")
_STANCE = re.compile(r"^\W*(?:(?:立場|立场|stance|position|情緒|情绪|sentiment|類別|类别|分類|category|label)\s*[:：]\s*)?(?:支持|反對|反对|中立|正面|負面|负面|中性|support|oppose|against|neutral|positive|negative|sports|politics|finance|technology|society|other|entertainment|health|體育|政治|財經|科技|社會|其他|娛樂|健康)\W*$", re.I)
_PAIRS = {"（": "）", "(": ")", "「": "」", "『": "』", "【": "】", "《": "》", "“": "”", "[": "]", "{": "}"}


def _open_delimiters(text: str) -> bool:
    """Whether a bracket or quote that was opened in the text's last sentence isn't closed."""
    waiting: list[str] = []
    for c in text:
        if c in _PAIRS:
            waiting.append(_PAIRS[c])
        elif c in ")）」』】》”]}":
            if waiting and waiting[-1] == c:
                waiting.pop()
            elif c in waiting:
                del waiting[waiting.index(c) :]
        elif c in "。！？\n" and waiting:
            waiting = [w for w in waiting if w in "」』】”}]"]
    return bool(waiting)


def is_truncated(text: str, body: str, value: object, reference: str | None) -> bool:
    if text.count("```") % 2:
        return True
    stripped = body.strip()
    if isinstance(value, (dict, list)):
        return False
    if stripped[:1] in ("{", "["):
        # Broken JSON: complete only if what was opened is closed at the end.
        if stripped[:1] == "{" or '"' in stripped[:3]:
            return not (stripped.endswith(("}", "]")) and stripped.count("{") == stripped.count("}"))
    if isinstance(value, str):
        stripped = value.strip()
    if _OPTION.match(stripped) or _STANCE.match(stripped):
        return False
    if not _CLOSED.search(stripped):
        short = _plain(stripped)
        try:
            own = json.loads(reference) if reference else None
        except ValueError:
            own = None
        answers = {_plain(s) for s in _strings(own)} if own is not None else set()
        return short not in answers
    return stripped[-1] not in "。！？!?」』）)”" and _open_delimiters(stripped)


def defects(response: str | None, prompt: str | None, reference: str | None) -> list[str]:
    """All defects of a pair, in the order of the rules."""
    if response is None:
        return ["empty"]
    body, value = unwrapped(response)
    if is_empty(body, value):
        return ["empty"]
    rules = (
        ("refusal", is_refusal(body, value)),
        ("copied_question", is_copy(body, value, prompt, reference)),
        ("other_language", is_other_language(body, value, prompt)),
        ("truncated", is_truncated(response, body, value, reference)),
    )
    return [name for name, holds in rules if holds]


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [defects(a, b, c) for a, b, c in zip(batch["response"], batch["prompt"], batch["reference"])]
        keep = [bool(f) for f in found]
        yield pd.DataFrame({"response_id": batch["response_id"][keep], "defect_type": [f[0] for f in found if f], "defects": [f for f in found if f]})


def find_broken_pairs(responses: DataFrame, items: DataFrame) -> DataFrame:
    """response_id, defect_type (the first that holds), defects (all) of responses (id, benchmark_item_id, response_text) to items (id, prompt, reference_answer, loaded_at)."""
    own = items.select(comparable_key("id").alias("item_key"), F.struct(F.col("loaded_at"), F.col("prompt"), F.col("reference_answer").alias("reference")).alias("i")).filter("item_key is not null")
    latest = own.groupBy("item_key").agg(F.max("i").alias("i")).select("item_key", "i.prompt", "i.reference")
    rows = responses.select(F.col("id").cast("string").alias("response_id"), comparable_key("benchmark_item_id").alias("item_key"), F.col("response_text").alias("response")).filter("response_id is not null")
    joined = salted_join(rows, latest, "item_key", "response_id")
    return joined.select("response_id", "response", "prompt", "reference").mapInPandas(_judge, "response_id string, defect_type string, defects array<string>")
