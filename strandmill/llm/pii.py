"""Personal information in free text: finding email addresses, phone numbers, identity numbers, street addresses and names of
persons, and replacing them by typed placeholders.

The nodes of a skip-chain conditional random field over the labels O, email, phone, id_number, address and name are

* every run of digits, every email-like and street-like span;
* every span that a surname's character leads (Han, Hangul; Japanese surnames of two characters), and every pair or triple
  of capitalised words (Latin, Cyrillic). No cue word is needed: cues are features.

Node potentials are log-linear in features of the span's characters and of the words at both sides. Chain edges join nodes
that follow each other closely; skip edges join equal or similar nodes anywhere in the document, so that a name or number
that is plain in one place is found in the others, too. Loopy sum-product message passing gives each node's marginals; the
most probable label is taken.

A name span whose own potential for O is greater than all that its two chain edges could add (`Model.weak`, from the
weights) is left out of the graph, unless the same surface stands elsewhere in the text without being that unlikely.

Which Han characters and Latin words are ordinary is told by the vocabularies of public tokenizers (`folder`, read on the
driver; without them all characters count as unknown). All weights are trained here, by pseudo-likelihood on `EXAMPLES` texts that are
put together from invented values, ordinary words and sentence frames of their own (a fixed seed; the bound is a
parameter), once a session on the driver. Weights and vocabulary are broadcast: their size is that of the vocabularies.

Full-width characters and invisible ones inside numbers don't hide anything: they are mapped away for the search, and
spans are cut from the text as it is stored. Texts are read whole.

Defined results: null stays null, empty stays empty, both without kinds. Repeated rows and ties are ordinary. Rows with a
null id are kept in `redact` and dropped by `find_kinds`.
"""

from __future__ import annotations

import base64
import math
import os
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandmill.session import cut

LABELS = ("O", "email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
EXAMPLES, STEPS, SEED, SWEEPS = 5000, 150, 7, 6
TOKENIZERS = "/opt/tokenizers"
#: Weight decay; a pair of Han characters is a word if it occurs so often at least and its count is such a part of the
#: geometric mean of its characters'.
L2, COHESIVE, LEAST_PAIRS = 0.5, 0.2, 5

# --- Fixed values: surnames, words beside personal information, and their like -------------------------------------------

SURNAMES = "王李張张劉刘陳陈楊杨黃黄趙赵吳吴周徐孫孙馬马朱胡郭何林高梁鄭郑羅罗宋謝谢唐韓韩曹許许鄧邓蕭萧馮冯曾程蔡彭潘袁於于董余蘇苏葉叶呂吕魏蔣蒋田杜丁沈姜范江傅鍾钟盧卢汪戴崔任陸陆廖姚方金邱夏譚谭韋韦賈贾鄒邹石熊孟秦閻阎薛侯雷白龍龙段郝孔邵史毛常萬万顧顾賴赖武康賀贺嚴严尹錢钱施牛洪龔龚湯汤陶黎溫温莫易樊喬乔文安殷顏颜莊庄章魯鲁倪邢歐欧甘尤祁鈕钮鄔邬郗桑駱骆晏荊荆翟樂乐狄邴蒲宓冉尉佟闕阙卞滕戚柳岳齊齐梅霍管祝左谷時时蒙穆巫焦裴童陰阴項项祖詹柯阮翁游凌單单連连涂曲辛路芮古藍蓝纪紀麥麦辜解饒饶官卓房鮑鲍符池苗俞褚卜薄包耿關关虞婁娄舒伍簡简佘沙車车應应聶聂向歸归匡宗瞿屈寧宁柴諸诸葛冷靳仇欒栾盛竇窦初隋湛邸鄂"
DOUBLE_SURNAMES = ("歐陽", "欧阳", "司馬", "司马", "上官", "諸葛", "诸葛", "司徒", "東方", "东方", "尉遲", "尉迟", "皇甫", "令狐", "慕容", "夏侯", "公孫", "公孙", "端木", "獨孤", "独孤", "長孫", "长孙", "宇文", "軒轅", "轩辕")
# Characters that are frequent in given names.
GIVEN = "明華美英文志建國秀玉淑雅怡君婷佳宜欣俊傑豪偉宏銘宗翰廷承恩宇軒睿冠霖柏凱翔哲瑋彥廷育仁義智信禎祥瑞福祿壽春夏秋冬梅蘭竹菊蓮芳芬芷若雲霞月星辰晨曦旭昇陽光輝耀煌燦麗珍珠琳琪琦瑜瑄璇瑤瑩瑾璟珊玲珮佩慧惠敏靜嫻婉婕妤姿妍娟嫣嬌媛姍娜妮莉莎蓉薇蕙萱萍蓁菁茹荷思念憶恬悅怡慈愛心誠謙平安康寧子小大家強健勇武威震雷鳴龍鳳鵬飛騰躍達道德賢良才學博文章詩韻音樂書畫晴雨雪冰清澄潔涵浩瀚海洋江河湖波濤源泉山嶺岳峰岩石磊鐵鋼金銀銅錦繡綺彩虹霓品筑築均勻昱昊昌昭景晏智柔桂桐楓榮樺欽正永勝成全皓盈真祐禹秉穎立筠紹維緯羽翊耘芸苡莘語詠詩誼賜辰進遠邦鈞鈺銓鎮霆靖韋頤駿志忠孝嘉麟偉倫修儀元允先克"
# Characters that hardly occur in given names.
_NOT_GIVEN = frozenset("的了是在有不也都與跟就這那個們我你他她它很會要到說對為著過把被讓從比而且或及等上下前後裡外多少更最只又已將如但因所以每各某其之乎者吧嗎呢啊喔哦嗯一二三四五六七八九十百千萬億兩幾年日時分秒點次件名人員老師縣市鄉鎮村區路街號段巷弄樓站店館院校所局部會社組按例差距排值得必須請找寄來去做看聽寫讀買賣開關起見想知地這们这个来会说对为时过让从后里还没么吗业务电车书长门问间东见现发动产设经进种说认试话该误谁课调谢写将应当实际") - frozenset("文")
# Ordinary words that a surname's character begins.
_COMMON = frozenset("高中 高級 高興 高度 高速 方便 方法 方向 方案 方面 白天 白色 黃金 黃色 周末 周圍 金融 金額 金牌 文化 文章 文件 文學 文字 程式 程度 程序 安全 安靜 安排 安心 安裝 何時 任何 任務 任意 包裹 包含 包括 石油 石頭 林業 林木 江湖 馬路 馬上 馬達 時間 時常 時代 常常 常見 常用 平常 平靜 平均 平台 平坦 關於 關心 關係 關鍵 應該 應用 應對 項目 曾經 於是 孔雀 雲端 童年 夏天 夏季 花園 花費 高雄 康復 康健 游泳 管理 管道 單車 單位 單純 單一 連結 連絡 連續 向來 向上 解答 解決 解釋 簡單 簡訊 溫暖 溫度 溫和 溫柔 路線 路口 車站 車主 車票 古典 古老 藍圖 藍色 莊嚴 史料 易懂 甘願 左右 樂團 樂園 樂器 樂隊 樂觀 薄荷 官方 官網 房屋 房東 房客 符合 池塘 關卡 聯盟 歸還 農曆 盛大 初學 初期 嚴重 嚴格 嚴肅 陰暗 陰天 冷清 冷靜 冷淡 班長 班級 司機 水果 水準 湯匙 麥克 全部 全面 祝福 祝賀 段落 曲線 成功 成本 成績 項鍊 明天 明顯 和平 和諧 計畫 計算 米飯 經濟 經驗 別人 別墅 支持 利益 利用 利率 通知 通過 廣場 廣告 相關 相信 相同 喜歡 由於 由來 危險 元素 強調 終於 空間 空氣 大道 大樓 大學 大會 小說 小組 小學 小時 台地 盆地".split())
# Words at the left of a name that say that one follows, by sort; a name need not have one.
_NAME_LEFT = {
    "label": ("聯絡人", "联系人", "聯繫人", "收件人", "寄件人", "承辦人", "負責人", "姓名", "作者", "申請人", "當事人", "簽名", "署名", "窗口"),
    "self": ("我是", "我叫", "本人", "名叫", "名字是", "敝姓", "叫做"),
    "ask": ("請找", "請洽", "麻煩", "拜託", "轉交", "交給", "寄給", "打給", "通知", "遇到", "碰到", "看到", "約了", "陪著"),
    "thank": ("謝謝", "感謝", "多謝", "多虧", "恭喜"),
    "person": ("鄰居", "同事", "同學", "朋友", "室友", "房東", "學長", "學姊", "學弟", "學妹", "主任", "經理", "店長", "老闆", "導師", "醫師", "護理師", "記者", "主管", "助理", "表哥", "表妹", "阿姨", "叔叔", "店員", "老師", "教練", "律師", "教授", "校長", "妹妹", "弟弟", "哥哥", "姊姊"),
}
_LEFT_ONE = {"和": "joined", "跟": "joined", "與": "joined", "找": "verb", "叫": "verb", "給": "verb", "問": "verb", "向": "verb", "由": "verb", "是": "verb", "讓": "verb", "對": "verb", "見": "verb", "的": "of", "了": "verb", "到": "verb", "洽": "verb"}
_NAME_RIGHT = {"title": ("先生", "小姐", "女士", "老師", "同學", "醫師", "醫生", "教授", "律師", "經理", "主任", "太太", "師傅", "學長", "學姊", "店長", "助理", "組長", "教練"), "signed": ("敬上", " 敬上", "謹啟", "拜上", "敬啟", " 謹啟"), "said": ("說", "表示", "提到", "告訴", "回信", "回覆", "寫道", "笑著", "認為")}
_RIGHT_ONE = {**dict.fromkeys("也都在是會有來去要和跟與不把被向對從打給就還又才很已正將昨今明前曾能想可帶拿寫做住問坐站跑走等找", "verb"), "的": "of", "了": "verb", **dict.fromkeys("市縣區鄉鎮村里路街巷段弄號州省國島山河湖溪橋站店寺廟宮院校園館所局部會社隊獎杯節", "place")}

# Words at the left and right of a name in Latin letters, by sort.
_EN_LEFT = re.compile(r"(?:(?P<self>\b[Mm]y name is|\b[Ii](?:'m| am)(?: called)?|\bname:)|(?P<signed>\b(?:[Rr]egards|[Ss]incerely|[Yy]ours|[Cc]heers|[Bb]est wishes),|\b[Ss]igned,?(?: by)?|--|—)|(?P<title>\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Señora?|Herr|Frau|Madame|Monsieur)\b\.?)|(?P<person>\b(?:neighbou?r|friend|colleague|roommate|teacher|landlord|manager|cousin|uncle|aunt|boss|coach|brother|sister|wife|husband|son|daughter|classmate|assistant|editor|nurse)\b,?)|(?P<ask>\b(?:ask for|asking for|contact|attn|Attn|call|meet|met|with|to|thanks|Thanks|thank you|Dear|dear|reach|and|for|from|told|asked|saw)\b[:,.]?)|(?P<by>\b[Bb]y\b:?))\s+$")
_EN_RIGHT = {"verb": re.compile(r"\s*(?:who|came|sold|said|told|called|asked|wrote|lives?|lived|works?|worked|was|is|will|has|had|and (?:his|her|I)|agreed|left|took|gave|went|made|sent|signed|joined|replied|approved|moved|phoned|bought|lost|found|met)\b"), "end": re.compile(r"\s*(?:[.!?)）\n,;。，]|$)"), "of": re.compile(r"\s+(?:of|for|in|at|on)\b")}
_FIRST_NAMES = frozenset("James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Paul Sandra Steven Ashley Andrew Emily Kenneth Donna George Carol Kevin Amanda Brian Melissa Edward Rebecca Ronald Laura Timothy Helen Jason Anna Jeffrey Emma Ryan Olivia Jacob Grace Nicholas Julia Eric Alice Stephen Rachel Peter Maria Henry Sofia Adam Clara Oliver Nora Lucas Ella Hugo Eva Felix Ines Leon Marie Louis Camille Pierre Claire Carlos Lucia Jose Carmen Miguel Elena Juan Ana Pedro Rosa Luis Paula Hans Greta Karl Heidi Lars Ingrid Sven Astrid Ivan Olga Pavel Irina Priya Raj Arjun Fatima Omar Aisha Wei Mei Yuki Kenji Minh Linh".split())
# Words that begin sentences in languages with Latin letters.
_STARTERS = frozenset("The A An In On At By For From With After Before When While Why What Which Who How If It Is Are He She They We You I This That These Those There Our My Your His Her Their And But Or So Not No Yes Please Dear Thanks Thank Yesterday Today Tomorrow Tonight Some Many Most Every Each About Near To Of As Der Die Das Den Dem Ein Eine Im Am Und Aber Nach Bei Vor Seit Wir Ich Sie Es Le La Les Un Une Des En Au Aux Dans Il Elle Ils Hier Demain El Los Las Una Al Ayer Hoy Mañana Pero O Os As Em No Na Nos Nas À Às Ontem Hoje Amanhã Então Mas São San Santa Santo Saint St".split())
# Japanese, Korean and Russian: frequent surnames, given names' characters or endings, words beside a name.
_JA_FAMILY = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 斎藤 清水 山崎 池田 橋本 阿部 石川 山下 中島 石井 小川 前田 岡田 長谷川 藤田 後藤 近藤 村上 遠藤 青木 坂本 斉藤 福田 太田 西村 藤井 金子 岡本 藤原 三浦 中野 原田 松田 竹内 上田 中山 和田 石田 森田 宮崎 酒井 工藤 横山 大野 高木 安藤 島田 谷口 今井 丸山 増田 杉山 村田 大塚 小山 平野 久保 野口 松井 千葉 桜井 菊地 岩崎 野村 木下 佐野 水野 新井 小島 内田 松尾".split()
_JA_RIGHT = re.compile("さん|様|氏|くん|君|ちゃん|先生|[はがをにともへで、。]")
_KO_FAMILY = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국"
_KO_GIVEN = "민서준지현우도윤예은하수진영호성재훈경미정숙희연주아인승태용철동건원석기상규빈나라유림혜선화순옥자춘봉복남길종찬혁범욱환섭식헌교솔별단비람온결"
_KO_RIGHT = re.compile("씨|님|군|양|선생|[이가은는을를과와의도에]|[ ,.!?]|$")
_RU_FIRST = frozenset("Александр Алексей Анна Андрей Антон Борис Вера Виктор Виктория Владимир Галина Дарья Денис Дмитрий Евгений Екатерина Елена Иван Игорь Илья Ирина Кирилл Константин Ксения Лариса Людмила Максим Мария Марина Михаил Надежда Наталья Никита Николай Оксана Олег Ольга Павел Пётр Полина Роман Светлана Сергей Софья Татьяна Фёдор Юлия Юрий Ярослав".split())
_RU_ENDING = re.compile("(?:(?:ов|ев|ёв|ин|ын)(?:а|у|ым|ой|е)?|(?:ск|цк)(?:ий|ая|ого|ой|ому|им)|ко|енко|чук|юк|вич|вна|ян|швили|дзе)$")

# Words beside numbers: what they say a number is.
_NUMBER_CUES = {
    "phone": ("電話", "电话", "手機", "手机", "行動", "市話", "專線", "分機", "撥", "打", "來電", "致電", "tel", "phone", "call", "mobile", "cell", "ring", "rang", "dial", "text me", "whatsapp", "line", "fax", "傳真", "聯絡", "連絡", "téléphone", "teléfono", "telefon", "telefone", "тел", "電話番号", "전화", "điện thoại"),
    "id": ("身分證", "身份證", "身份证", "證號", "证号", "字號", "證件", "居留證", "統一編號", "健保", "ssn", "social security", "id no", "id number", "national id", " id ", "id：", "id:", "dni", "cpf", "nif", "инн", "паспорт", "주민", "マイナンバー", "cmnd", "cccd"),
    "code": ("訂單", "订单", "貨號", "货号", "條碼", "条码", "型號", "序號", "單號", "編號", "版本", "order", "item", "barcode", "build", "version", "sku", "serial", "invoice", "ticket", "tracking", "ref", "step", "比數", "比分", "score", "port", "pid", "commit", "isbn", "發票", "金額", "價格", "$", "€", "¥", "第", "pedido", "commande", "bestellung", "заказ", "주문", "注文", "đơn hàng"),
}
_NUMBER_RIGHT = {"phone": ("找", "接", "聯絡", "洽", "請撥", "after", "for"), "id": ("的身分", "on file"), "code": ("件", "元", "次", "人", "%", "％", "倍", "位", "篇", "年", "minutes", "缺貨", "出貨", "is sold", "has shipped")}

# --- Forms --------------------------------------------------------------------------------------------------------------

_WIDE = {ord("０") + i: ord("0") + i for i in range(10)} | {ord("Ａ") + i: ord("A") + i for i in range(26)} | {ord("ａ") + i: ord("a") + i for i in range(26)} | {ord("＠"): "@", ord("－"): "-", ord("．"): ".", ord("＿"): "_", ord("＋"): "+", ord("–"): "-", ord("‐"): "-", ord("‑"): "-", 0xA0: " ", 0x202F: " ", 0x2009: " ", 0x2003: " ", 0x2005: " ", 0x205F: " "}
_IS_WIDE = re.compile("[" + "".join(map(chr, _WIDE)).replace("-", "\\-") + "]")
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")

_AT = r"(?:\s?[(\[{<（［【]\s?(?:at|AT|At|@)\s?[)\]}>）］】]\s?|\s?@\s?)"
_DOT = r"(?:\s?[(\[{<（［【]\s?(?:dot|DOT|Dot|\.)\s?[)\]}>）］】]\s?|\.)"
_EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+\-]*{_AT}[A-Za-z0-9][A-Za-z0-9\-]*(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}}|[A-Za-z0-9._%+\-]+ (?:at|AT) [A-Za-z0-9\-]+(?: (?:dot|DOT) [A-Za-z0-9\-]+)+")
_EMAIL_HINT = re.compile(r"@|[(\[{<（［【]\s?(?:at|AT|At)\s?[)\]}>）］】]| (?:dot|DOT) ")
_N = r"(?:[0-9]{1,5}|[一二三四五六七八九十百零〇○]{1,7})"
_ADDRESS = re.compile(
    rf"(?:(?<![0-9A-Za-z])[0-9]{{3,6}}\s?)?(?:[㐀-鿿]{{2,3}}[縣县市])?(?:[㐀-鿿]{{1,3}}[區区鄉乡鎮镇市])?(?:[㐀-鿿]{{1,3}}[村里])?(?:{_N}鄰)?[㐀-鿿]{{1,4}}?(?:路|街|大道|巷)\s?(?:{_N}段)?\s?(?:{_N}巷)?\s?(?:{_N}弄)?\s?{_N}(?:\s?[之\-]\s?{_N})?\s?[號号](?:之{_N})?(?:\s?{_N}(?:樓|楼|F))?(?:之{_N}|{_N}室)?"
    rf"|[㐀-鿿]{{1,3}}[縣县市][㐀-鿿]{{1,3}}[區区鄉乡鎮镇市][㐀-鿿]{{0,4}}[村里鄰]?\s?{_N}(?:[之\-]{_N})?[號号]"
    r"|(?:(?:Unit|Apt|Suite|Flat|Apartment|Room|No\.)\.?\s?#?\w{1,5},?\s+)?\b[0-9]{1,5}[A-Za-z]?,?\s+(?:[A-Z][A-Za-z'’.\-]+\s+){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Boulevard|Blvd|Drive|Dr|Court|Ct|Place|Pl|Way|Terrace|Square|Sq|Crescent|Close|Row|Highway|Hwy|Parkway|Pkwy|Circle|Alley|Quay|Mews|Hill|Gardens)\b\.?(?:,?\s+(?:Unit|Apt|Suite|Flat|Apartment|Room|Floor|#)\.?\s?#?\w{1,5})?"
    r"|\b[0-9]{1,4}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours)\s+(?:de |du |des |la |le |d['’]|l['’])*[A-ZÀ-Þ][\w'’\-]+"
    r"|\b(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo|[Rr]ua|[Tt]ravessa|[Pp]raça|[Aa]v\.|C/)\s+(?:de |del |da |do |dos |la |las |los )*[A-ZÀ-Þ][\w'’\-]+(?:\s+[A-ZÀ-Þ][\w'’\-]+){0,2},?\s+(?:n[.ºo°]*\s?)?[0-9]{1,5}\b"
    r"|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm)\s+[0-9]{1,4}\s?[a-z]?\b"
    r"|(?:ул\.|улица|проспект|пр-т|пер\.)\s*[\w\-]+,?\s*(?:д\.|дом)?\s*[0-9]{1,4}"
    r"|[0-9]{1,3}丁目[0-9]{1,4}(?:番地?|-)(?:[0-9]{1,4}号?)?|[가-힣]{1,6}(?:로|길)\s?[0-9]{1,4}(?:-[0-9]{1,4})?(?:번지|호)"
)
_ADDRESS_HINT = re.compile(r"[號号]|[0-9][A-Za-z]?,?\s+(?:[A-Z]|rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours)|丁目|ул|улица|проспект|пер\.|[Cc]alle|[Aa]v|[Pp]laza|[Pp]aseo|[Rr]ua|[Tt]ravessa|[Pp]raça|C/|(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm)\s|[로길]")
_NUMBER = re.compile(
    r"(?<![A-Za-z0-9@.])(?P<lead>[A-Za-z]{1,2}|[A-Z] (?=[1289][0-9]{2} ?[0-9]{3} ?[0-9]{3}(?![0-9])))?(?P<body>(?:\+[0-9]{1,3} ?|00)?[(（]?[0-9](?:[ .)）\-]{0,2}[0-9]){5,19}(?:[Xx](?![A-Za-z]))?)(?![A-Za-z0-9@])"
    r"|(?P<words>[零〇○一二三四五六七八九](?:[ \-]?[零〇○一二三四五六七八九]){7,11})"
)
_NUMBER_HINT = re.compile(r"[0-9][0-9 ().（）\-]{5}|[零〇○一二三四五六七八九]{8}")
_CHINESE_DIGITS = str.maketrans("零〇○一二三四五六七八九", "000123456789")


def number_form(lead: str, body: str) -> str:
    """The form of a number: one that telephone or identity numbers have, or what else it looks like."""
    digits, n = re.sub(r"[^0-9]", "", body), sum(c.isdigit() for c in body)
    shape = re.sub(r"[0-9]", "9", body.strip())
    lead = lead.upper()
    if len(lead) == 1 and n == 9 and digits[0] in "1289":
        return "letter-9"
    if len(lead) == 2 and n == 8 and lead[1] in "ABCD":
        return "two-letters-8"
    if len(lead) == 2 and n == 6 and re.fullmatch(r"[0-9 ]+", body):
        return "two-letters-6"
    if lead:
        return "letters-other"
    if body[-1] in "Xx" and n == 17 or n == 18 and digits[6:8] in ("19", "20") and shape == "9" * 18:
        return "cn-id"
    if re.fullmatch(r"9999[-./]?99[-./]?99.*", shape) and digits[:2] in ("19", "20") and 1 <= int(digits[4:6]) <= 12 and 1 <= int(digits[6:8]) <= 31:
        return "date"
    if shape in ("999-99-9999", "999 99 9999"):
        return "3-2-4"
    if re.fullmatch(r"999999-?[0-9]{0}9999999", shape) and "-" in shape:
        return "kr-id"
    if shape == "999.999.999-99":
        return "br-id"
    if re.fullmatch(r"9{1,3}(?:\.9{1,3}){3}", shape) or body.count(".") >= 2 and not re.fullmatch(r"9{2,4}(?:\.9{2,4}){2,4}", shape):
        return "dotted"
    if re.fullmatch(r"9+\.9+", shape):
        return "decimal"
    if body.startswith("+") or digits.startswith("00") and n >= 11:
        return "international" if 9 <= n <= 15 else "plus-other"
    if re.fullmatch(r"09\d{8}", digits):
        return "tw-mobile"
    if re.fullmatch(r"0[2-8]\d{7,8}", digits) and shape[0] in "(（" or re.fullmatch(r"0[2-8]\d{0,2}[- ]\d{3,4}[- ]?\d{3,4}", body):
        return "tw-landline"
    if re.fullmatch(r"07\d{9}", digits):
        return "uk-mobile"
    if re.fullmatch(r"1[3-9]\d{9}", digits) and shape.replace(" ", "").replace("-", "") == "9" * 11:
        return "cn-mobile"
    if re.fullmatch(r"0\d{9,10}", digits):
        return "zero-10-11"
    if n == 10 and digits[0] in "23456789" and re.fullmatch(r"[(（]?999[)）]?[ .-]*999[ .-]9999", shape):
        return "3-3-4"
    if n == 10 and shape == "9" * 10 and digits[0] in "23456789" and digits[3] in "23456789":
        return "ten"
    if n == 11 and digits[0] == "1" and re.search(r"[ .()-]", shape):
        return "1-3-3-4"
    if n == 13 and shape == "9" * 13:
        return "thirteen"
    if shape == "99999999-9999":
        return "8-4"
    return f"digits-{min(n, 14)}" + ("-cut" if re.search(r"[^9]", shape) else "")


@dataclass
class Node:
    """A candidate: a span, the kinds that it can be, features, and what it is compared by."""

    start: int
    end: int
    kinds: tuple[str, ...]
    features: list[str]
    surface: str
    group: str
    likely: bool = False
    own: float | None = None


_SENTENCE = re.compile(r"[。！？!?\n]|(?<!no)\.\s")


def _beside(text: str, start: int, end: int) -> list[str]:
    left, right = _SENTENCE.split(text[max(0, start - 14) : start].lower())[-1], text[end : end + 14].lower()
    out = []
    for kind, words in _NUMBER_CUES.items():
        if any(w in left for w in words):
            out.append(f"left:{kind}")
        if any(w in left[-7:] for w in words):
            out.append(f"near:{kind}")
    for kind, words in _NUMBER_RIGHT.items():
        if right.startswith(words) or right[:1] == " " and right[1:].startswith(words):
            out.append(f"right:{kind}")
    if left[-1:] in "(（[「" and left and right[:1] in ")）]」":
        out.append("bracketed")
    return out or ["alone"]


def _numbers(text: str) -> Iterator[Node]:
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        body, lead = m.group("body"), (m.group("lead") or "").strip()
        if m.group("words"):
            body, lead = m.group("words").translate(_CHINESE_DIGITS), ""
            form = "words-" + number_form("", body)
        else:
            # A bracket around the number isn't part of it.
            if body[0] in "(（" and not re.match(r"[(（][0-9]{2,4}[)）]", body):
                body, start = body[1:], m.start("body") + 1
            # A number's own brackets only; what follows a closed identity number is another number.
            if (ssn := re.match(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9])", body)) and not lead:
                body, end = ssn.group(), start + ssn.end()
            elif not lead and (tel := re.match(r"[(（]?0[2-8][)）][ -]?[0-9]{3,4}[- ]?[0-9]{4}(?![0-9])|09[0-9]{2}[- ]?[0-9]{3}[- ]?[0-9]{3}(?![0-9])|\+886[ -]?9[0-9]{2}[ -]?[0-9]{3}[ -]?[0-9]{3}(?![0-9])|\+44 ?7[0-9]{3} ?[0-9]{6}(?![0-9])|07[0-9]{3} ?[0-9]{6}(?![0-9])|\+1[ -.]?[0-9]{3}[ -.][0-9]{3}[ -.][0-9]{4}(?![0-9])|[(]?[2-9][0-9]{2}[)]?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])", body)):
                body, end = tel.group(), start + tel.end()
            elif lead and (own := re.match(r"[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{3}(?![0-9])" if len(lead) == 1 else r"[0-9]{8}(?![0-9])", body)):
                body, end = own.group(), m.start("body") + own.end()
            form = number_form(lead, body)
        features = [f"form:{form}", *(x for b in _beside(text, start, end) for x in (b, f"{form}&{b}"))]
        yield Node(start, end, ("phone", "id_number"), features, (lead + re.sub(r"\W", "", body)).upper(), f"number:{form}")


# --- Vocabulary ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """Ordinary characters and words, as public tokenizers' vocabularies have them."""

    han: frozenset[str] = frozenset()
    han_words: frozenset[str] = _COMMON
    lower: frozenset[str] = frozenset()
    title: frozenset[str] = frozenset()

    def with_words(self, words: set[str]) -> Vocabulary:
        return replace(self, han_words=self.han_words | words)


@lru_cache
def vocabulary(folder: str = TOKENIZERS) -> Vocabulary:
    """Han characters and words, and Latin words by their case, that are whole tokens; nothing where the folder isn't there."""
    pieces: list[str] = []
    for name in ("byte_bpe_multi_50k", "byte_bpe_50k"):
        path = os.path.join(folder, f"{name}.tiktoken")
        if os.path.exists(path):
            with open(path, "rb") as f:
                pieces += [base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in f if line.strip()]
    han = [p for p in pieces if re.fullmatch("[㐀-鿿]+", p)]
    words = [p[1:] for p in pieces if re.fullmatch(" [A-Za-z]{2,}", p)]
    return Vocabulary(
        frozenset(p for p in han if len(p) == 1),
        _COMMON | {p for p in han if len(p) == 2},
        frozenset(w for w in words if w.islower()),
        frozenset(w for w in words if w.istitle()),
    )


# --- Names --------------------------------------------------------------------------------------------------------------

_SURNAME = frozenset(SURNAMES)
_GIVEN = frozenset(GIVEN)
_HAN = re.compile("[㐀-鿿]")
_PAIR = re.compile("(?=([㐀-鿿]{2}))")
_LED = re.compile(f"(?=({'|'.join(DOUBLE_SURNAMES)}|[{SURNAMES}])([㐀-鿿]{{1,2}}))")
_LEFT_CUES = [(w, kind) for kind, words in _NAME_LEFT.items() for w in sorted(words, key=len, reverse=True)]
_LEFT_ENDS = {w[-1] for w, _ in _LEFT_CUES} | {"y", "Y"}
_RIGHT_STARTS = {w[0] for words in _NAME_RIGHT.values() for w in words}


def _left_of(text: str, start: int) -> str:
    """What the characters before a Han name say, nearest first."""
    if not start:
        return "start"
    c = text[start - 1]
    if c in _LEFT_ENDS or c in " 　:：":
        bare = text[max(0, start - 6) : start].rstrip(" 　:：")
        if bare and bare[-1] in _LEFT_ENDS:
            for w, kind in _LEFT_CUES:
                if bare.endswith(w):
                    return kind
        if bare[-2:].lower() == "by":
            return "by"
    if not "㐀" <= c <= "鿿":
        return "start"
    return _LEFT_ONE.get(c) or ("function" if c in _NOT_GIVEN else "han")


def _right_of(text: str, end: int) -> str:
    c = text[end : end + 1]
    if c in _RIGHT_STARTS:
        for kind, words in _NAME_RIGHT.items():
            if text.startswith(words, end):
                return kind
    if not "㐀" <= c <= "鿿":
        return "end"
    return _RIGHT_ONE.get(c) or ("function" if c in _NOT_GIVEN else "han")


def _own_features(family: str, given: str, words: Vocabulary) -> tuple[str, ...]:
    """What a Han name's own characters say."""
    sort = "".join("x" if c in _NOT_GIVEN else "g" if c in _GIVEN else "o" if c in words.han else "r" for c in given)
    out = [f"given:{sort}", f"family:{'double' if len(family) == 2 else 'front' if SURNAMES.index(family) < 120 else 'rest'}"]
    whole = family + given
    pairs = [whole[i : i + 2] in words.han_words for i in range(len(family) - 1, len(whole) - 1)]
    return (*out, *(f"word:{i}" for i, hit in enumerate(pairs) if hit))


def _context_features(left: str, right: str, size: int, torn_left: bool, torn_right: bool) -> list[str]:
    """What stands around a Han name."""
    return [f"left:{left}", f"right:{right}", f"left:{left}&{size}", f"both:{left}&{right}", f"right:{right}&{size}", *(["torn left"] if torn_left else []), *(["torn right"] if torn_right else [])]


def _han_names(text: str, words: Vocabulary, model: Model | None) -> Iterator[tuple[float, Node]]:
    """Every span that a surname leads (without a model), or each one's better length, and its score."""
    known = words.han_words
    own_score, context_score = (model.han_own, model.han_context) if model else (None, None)
    for m in _LED.finditer(text):
        family, given = m.groups()
        if given[0] in _NOT_GIVEN:
            continue
        start = m.start()
        left = _left_of(text, start)
        torn_left = start > 0 and text[start - 1 : start + 1] in known
        best, top = None, -math.inf
        for size in (2, 1) if len(given) == 2 and given[1] not in _NOT_GIVEN else (1,):
            end = start + len(family) + size
            context = (left, _right_of(text, end), size, torn_left, text[end - 1 : end + 1] in known)
            if model is None:
                yield 0.0, Node(start, end, ("name",), [*_own_features(family, given[:size], words), *_context_features(*context)], text[start:end], "name:han")
                continue
            score = own_score(family, given[:size]) + context_score(*context)
            if score > top:
                best, top = (end, given[:size], context), score
        if best:
            end, own, context = best
            if top < model.weak:
                yield top, Node(start, end, ("name",), _WEAK, text[start:end], "name:han")
            else:
                yield top, Node(start, end, ("name",), [*_own_features(family, own, words), *_context_features(*context)], text[start:end], "name:han")


#: Stands for the features of a span that only an equal one elsewhere could make a name; its score is kept instead.
_WEAK: list[str] = []


_CAPITAL = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’\-]*[A-Za-zÀ-ÖØ-öø-ÿ]"
_RUN = re.compile(rf"(?<![\w@]){_CAPITAL}(?:(?:,? |\s)(?:[A-Z]\. |(?:van|von|de|da|di|del|la|le|bin|al) )?{_CAPITAL}(?:(?= [A-Z]\.(?!\w)) [A-Z]\.)?)+|(?<![\w@]){_CAPITAL}")
_PART = re.compile(_CAPITAL)
_ARTICLES = tuple(f" {w} " for w in "the a an der die das den dem des ein eine le la les du el los las un una o os as do da il lo".split()) + ("The ", "Die ", "Der ", "Das ", "Les ", "El ")
_TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Señora?|Herr|Frau|Madame|Monsieur)\.?\s$")


def _latin_sort(word: str, words: Vocabulary) -> str:
    """s: a word that begins sentences; f: a frequent first name; o: an ordinary word; t: known with a capital only; u: unknown."""
    word = word.capitalize() if word.isupper() else word
    return "s" if word in _STARTERS else "f" if word in _FIRST_NAMES else "o" if word.lower() in words.lower else "t" if word in words.title else "u"


def _latin_names(text: str, words: Vocabulary, model: Model | None) -> Iterator[tuple[float, Node]]:
    """Every pair or triple of capitalised words, and single ones after a title."""
    for run in _RUN.finditer(text):
        parts = [(m.start() + run.start(), m.end() + run.start(), m.group()) for m in _PART.finditer(run.group())]
        before_run = text[max(0, run.start() - 24) : run.start()]
        single = len(parts) == 1
        if single and not _TITLED.search(before_run):
            continue
        sorts = [_latin_sort(w, words) for _, _, w in parts]
        for i in range(len(parts)):
            for size in (1,) if single else (2, 3):
                if i + size > len(parts):
                    continue
                start, end = parts[i][0], parts[i + size - 1][1]
                inside = text[start:end]
                if inside.count(",") > 1 or size == 3 and "," in inside or "\n" in inside:
                    continue
                # A middle initial at the end belongs to the form 'Surname, First M.'.
                if "," in inside and (tail := re.match(r" [A-Z]\.", text[end : end + 3])):
                    end += tail.end()
                before = text[max(0, start - 24) : start]
                cue = _EN_LEFT.search(before)
                left = cue.lastgroup if cue else "word" if re.search(r"[a-z,;]\s+$", before) else "capital" if i else "start"
                if left == "capital" and sorts[i - 1] == "o" and i == 1 and not re.search(r"[a-z,;]\s+$", before_run):
                    left = "first word"
                right = next((k for k, p in _EN_RIGHT.items() if p.match(text, end)), "capital" if i + size < len(parts) else "none")
                sort = "".join(sorts[i : i + size])
                features = [f"en:{sort}", f"en-first:{sort[0]}", f"en-last:{sort[-1]}&{size}", f"en-left:{left}", f"en-right:{right}", f"en:{left}&{right}", f"en:{left}&{sort[-1]}", f"en-comma:{',' in inside}&{left}", f"en-initial:{bool(re.search(r'[A-Z][.]', inside))}"]
                if before.endswith(_ARTICLES):
                    features.append("en-article")
                yield model.score(features, "name") if model else 0.0, Node(start, end, ("name",), features, " ".join(sorted(w.lower() for _, _, w in parts[i : i + size])), "name:latin")


_JA = re.compile(f"({'|'.join(_JA_FAMILY)})[ 　]?([㐀-鿿々]{{1,3}}|[ぁ-ん]{{2,4}}|[ァ-ヶー]{{2,4}})?")
_KO = re.compile(f"(?<![가-힣])([{_KO_FAMILY}])([가-힣]{{2}})")
_RU = re.compile(r"(?<![А-Яа-яЁё])[А-ЯЁ][а-яё]+(?: [А-ЯЁ][а-яё]+)+(?![а-яё])")
_KANA = re.compile("[ぁ-ゖァ-ヺ]")
_HANGUL, _CYRILLIC = re.compile("[가-힣]"), re.compile("[А-Я][а-я]")


def _other_names(text: str) -> Iterator[Node]:
    """Japanese, Korean and Cyrillic names."""
    if _KANA.search(text):
        for m in _JA.finditer(text):
            end = m.end()
            given = m.group(2) or ""
            # A given name in kana ends before a particle.
            right = _JA_RIGHT.match(text, end)
            while not right and len(given) > 1 and not _HAN.match(given):
                given, end = given[:-1], end - 1
                right = _JA_RIGHT.match(text, end)
            sort = "none" if not given else "han" if _HAN.match(given) else "kana"
            cue = right.group() if right else "none"
            honoured = "title" if right and len(cue) > 1 or cue in "様氏君" else "particle" if right else "none"
            near = "kana" if _KANA.search(text[max(0, m.start() - 8) : end + 8]) else "no kana"
            yield Node(m.start(), end, ("name",), [f"ja-given:{sort}{len(given)}", f"ja-right:{honoured}", f"ja:{sort}&{honoured}", f"ja-near:{near}"], m.group()[: end - m.start()], "name:ja")
    if _HANGUL.search(text):
        for m in _KO.finditer(text):
            right = _KO_RIGHT.match(text, m.end())
            cue = right.group() if right else "none"
            sort = "".join("g" if c in _KO_GIVEN else "o" for c in m.group(2))
            kind = "title" if cue in ("씨", "님", "군", "양", "선생") else "none" if not right else "end" if not cue.strip() or cue in ".,!?" else "particle"
            family = "front" if _KO_FAMILY.index(m.group(1)) < 40 else "rest"
            yield Node(m.start(), m.end(), ("name",), [f"ko-given:{sort}", f"ko-right:{kind}", f"ko:{sort}&{kind}", f"ko-family:{family}"], m.group(), "name:ko")
    if _CYRILLIC.search(text):
        for m in _RU.finditer(text):
            begins = m.start() == 0 or re.search(r"[.!?\n]\s*$", text[max(0, m.start() - 3) : m.start()]) is not None
            parts = [(p.start() + m.start(), p.end() + m.start(), p.group()) for p in re.finditer(r"\S+", m.group())]
            for i in range(len(parts) - 1):
                for size in (2, 3):
                    if i + size <= len(parts):
                        own = [p for _, _, p in parts[i : i + size]]
                        sorts = "".join("f" if p in _RU_FIRST else "e" if _RU_ENDING.search(p) else "o" for p in own)
                        place = "first" if begins and not i else "later"
                        yield Node(parts[i][0], parts[i + size - 1][1], ("name",), [f"ru:{sorts}", f"ru-first:{place}", f"ru:{sorts}&{place}", f"ru-rest:{len(parts) - size}"], " ".join(own), "name:ru")


def _repeats(text: str, nodes: list[Node], taken: bytearray) -> Iterator[Node]:
    """Other places of likely names, where their surface stands as it is; `taken` marks the characters of all nodes."""
    for name, own in {text[n.start : n.end]: n for n in nodes if n.kinds == ("name",) and n.likely}.items():
        at = text.find(name)
        while at >= 0:
            if not any(taken[at : at + len(name)]):
                taken[at : at + len(name)] = b"\x01" * len(name)
                yield Node(at, at + len(name), ("name",), ["repeated"], own.surface, own.group)
            at = text.find(name, at + len(name))


_EMAIL_CUE = re.compile(r"(?:信箱|郵件|來信|寄信?到?|mail|e-mail|contact|write|reach|correo|courriel|почта|メール|메일)\S{0,3}\s*$", re.I)
_ADDRESS_CUE = re.compile(r"(?:地址|住址|住在|家在|搬到|寄到?|送到?|位於|地點是?|address:?|live[sd]? (?:at|on|in)|moved to|ship(?:ped)? to|sent to|at|adresse|dirección|адрес|住所|주소)\s*[:：]?\s*$", re.I)


def _formed(text: str) -> Iterator[Node]:
    """Emails, street addresses and numbers."""
    if _EMAIL_HINT.search(text):
        for m in _EMAIL.finditer(text):
            if "@" not in m.group() and " dot " not in m.group().lower() and not re.search(r"[(\[{<（［【]\s?(?:at|AT|At)", m.group()):
                continue
            tail = m.group().lower().rpartition(".")[2]
            form = "plain" if re.fullmatch(r"[\w.%+\-]+@[\w.\-]+", m.group()) else "written out"
            features = [f"email:{form}", f"email-file:{tail in ('png', 'jpg', 'gif', 'svg', 'webp', 'py', 'js')}", f"email-cue:{bool(_EMAIL_CUE.search(text[max(0, m.start() - 12) : m.start()]))}"]
            yield Node(m.start(), m.end(), ("email",), features, re.sub(r"\s|[()\[\]]", "", m.group().lower()), "email")
    if _ADDRESS_HINT.search(text):
        for m in _ADDRESS.finditer(text):
            verb = re.match(r"(?:[搬退回]?到|請?寄到?|[我住]?在|往|至|住|請|退)+(?=[㐀-鿿0-9])", m.group())
            start = m.start() + (verb.end() if verb else 0)
            features = [f"address-road:{bool(re.search('[路街巷弄]|大道|[A-Za-z]', m.group()))}", f"address-cue:{bool(verb or _ADDRESS_CUE.search(text[max(0, start - 14) : start]))}", f"address-right:{'exit' if text.startswith(('出口', '公車', '線', '航'), m.end()) else 'other'}", f"address-city:{bool(re.search('[縣市區鄉鎮]|,', m.group()))}"]
            yield Node(start, m.end(), ("address",), features, re.sub(r"\s", "", m.group()), "address")
    if _NUMBER_HINT.search(text):
        yield from _numbers(text)


def candidates(text: str, model: Model | None = None) -> list[Node]:
    """Nodes of a text, in order and without overlaps: emails and addresses go before numbers, numbers before names, and of names the likelier.

    Without a model all spans of names come out, whether they overlap or not.
    """
    words = model.words if model else vocabulary()
    formed = sorted(_formed(text), key=lambda n: (n.kinds[0] == "phone", n.start, -n.end))
    names = [*_han_names(text, words, model), *_latin_names(text, words, model), *((model.score(n.features, "name") if model else 0.0, n) for n in _other_names(text))]
    if model is None:
        return sorted([*formed, *(n for _, n in names)], key=lambda n: (n.start, n.end))
    strong: dict[str, float] = {}
    for score, n in names:
        if score >= model.weak:
            strong[n.surface] = max(score, strong.get(n.surface, -math.inf))
    kept: list[Node] = []
    taken = bytearray(len(text))
    for n in formed:
        if not any(taken[n.start : n.end]):
            kept.append(n)
            taken[n.start : n.end] = b"\x01" * (n.end - n.start)
    # A span whose surface is likely elsewhere in the text goes before others that overlap it.
    for score, n in sorted([x for x in names if x[1].surface in strong], key=lambda x: (-strong[x[1].surface], -x[0], x[1].start, -x[1].end)):
        if any(taken[n.start : n.end]):
            continue
        if n.features is _WEAK:
            n.own = score
        n.likely = score > 0
        kept.append(n)
        taken[n.start : n.end] = b"\x01" * (n.end - n.start)
    kept += list(_repeats(text, kept, taken))
    return sorted(kept, key=lambda n: n.start)


# --- The field ----------------------------------------------------------------------------------------------------------

NEAR = 40
EDGES = ("chain", "same", "like")
Weights = dict[tuple[str, str], float]


@dataclass
class Model:
    """Weights, and what they are looked up with."""

    weights: Weights
    words: Vocabulary
    training: bool = False

    def score(self, features: list[str], kind: str) -> float:
        """How much the own potential of `kind` is above that of O."""
        get = self.weights.get
        return get(("bias", kind), 0.0) - get(("bias", "O"), 0.0) + sum([get((f, kind), 0.0) for f in features])

    @cached_property
    def factors(self) -> dict[str, np.ndarray]:
        """Of each kind of edge: symmetric in its two ends; only whether both labels are the same kind, both O, or different matters."""
        out = {}
        for kind in EDGES:
            e = np.full((len(LABELS),) * 2, self.weights.get((kind, "different"), 0.0))
            np.fill_diagonal(e, self.weights.get((kind, "same"), 0.0))
            e[0, 0] = self.weights.get((kind, "both O"), 0.0)
            out[kind] = np.exp(e)
        return out

    @cached_property
    def weak(self) -> float:
        """The score below which chain edges alone can't make a span a name: each of the two adds at most its factor's log ratio. While weights are trained no span is left out."""
        if self.training:
            return -math.inf
        e = np.log(self.factors["chain"])
        return -2 * max(0.0, float(e[1, 1] - e[0, 1]), float(e[1, 0] - e[0, 0]))

    @cached_property
    def _cache(self) -> dict:
        return {}

    def han_own(self, family: str, given: str) -> float:
        key = family, given
        if (found := self._cache.get(key)) is None:
            if len(self._cache) > 1 << 18:
                self._cache.clear()
            found = self._cache[key] = self.score(list(_own_features(family, given, self.words)), "name")
        return found

    def han_context(self, *context) -> float:
        if (found := self._cache.get(context)) is None:
            found = self._cache[context] = self.score(_context_features(*context), "name") - self.score([], "name")
        return found


def edges(nodes: list[Node]) -> list[tuple[int, int, str]]:
    """Chain edges between near neighbours; skip edges along equal surfaces and, for numbers and their like, along equal forms."""
    out = [(i, i + 1, "chain") for i in range(len(nodes) - 1) if nodes[i + 1].start - nodes[i].end <= NEAR]
    last: dict[tuple[str, str], int] = {}
    for i, n in enumerate(nodes):
        for kind, key in (("same", n.surface), ("like", n.group)):
            if kind == "like" and n.kinds == ("name",):
                continue
            j = last.get((kind, key))
            if j is not None and not (kind == "like" and nodes[j].surface == n.surface):
                out.append((j, i, kind))
            last[kind, key] = i
    return out


def _node_potentials(node: Node, model: Model) -> np.ndarray:
    p = np.full(len(LABELS), -np.inf)
    p[0] = 0.0
    for kind in node.kinds:
        p[LABELS.index(kind)] = model.score(node.features, kind) if node.own is None else node.own
    return p


def label(nodes: list[Node], model: Model, sweeps: int = SWEEPS, skip: bool = True) -> list[str]:
    """Labels by loopy sum-product message passing; `skip=False` leaves the skip edges out, for comparison."""
    if not nodes:
        return []
    own = [np.exp(p - p.max()) for p in (_node_potentials(n, model) for n in nodes)]
    links = [e for e in edges(nodes) if skip or e[2] == "chain"]
    if not links:
        return [LABELS[int(np.argmax(p))] for p in own]
    factors = model.factors
    messages = {(i, j, k): np.ones(len(LABELS)) for a, b, k in links for i, j in ((a, b), (b, a))}
    into: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
    for key in messages:
        into[key[1]].append(key)
    for _ in range(sweeps):
        before = messages
        messages = {}
        for i, j, k in before:
            out = own[i].copy()
            for key in into[i]:
                if key[0] != j or key[2] != k:
                    out = out * before[key]
            m = factors[k].T @ out
            messages[i, j, k] = m / m.sum()
        if all(np.abs(messages[k] - before[k]).max() < 1e-4 for k in messages):
            break
    result = []
    for i, p in enumerate(own):
        for key in into[i]:
            p = p * messages[key]
        result.append(LABELS[int(np.argmax(p))])
    return result


# --- Training -----------------------------------------------------------------------------------------------------------

# Sentence frames and ordinary words of the training texts, written for this purpose; {} is where a value stands.
_TRAIN = {
    "name": ["{}明天要去圖書館還書。", "這封信是{}寫的。", "昨天{}在門口等了很久。", "大家都認識{}。", "我把鑰匙交給{}了。", "{}先生已經離開會議室。", "請問{}在嗎？", "{}說他不參加。", "{}和{}一起搬桌子。", "隊長由{}擔任。", "姓名：{}", "聯絡人：{}", "我叫{}，剛搬來這裡。", "我是{}。", "謝謝{}的提醒。", "{}小姐的包裹到了。", "學生{}得到第一名。", "導演{}的新作品很受歡迎。", "上午遇到{}，聊了幾句。", "{}敬上", "{}，你好！", "會議記錄：{}", "那張照片是{}拍的", "同事{}請假。", "感謝{}老師指導。", "他跟{}住在同一棟。", "聽說{}會來。", "{}把雨傘忘在車上。", "鄰居{}養了一隻貓。", "找{}就對了。", "出席：{}、{}", "結果{}也同意了。", "（{}）", "作者：{}", "{}表示沒有意見。", "每次都是{}洗碗。", "其實{}很會唱歌。", "聽到{}的笑聲", "隔壁班{}轉學了。", "原來{}早就知道。", "剛才{}打翻水杯。", "後面坐著{}。", "換{}上台。", "他教{}游泳。", "因為{}生病，活動取消。", "如果{}答應就好了。", "連{}都笑了。", "比{}高一點", "從前{}住在鄉下。", "晚上{}值班。", "信封寫著{}收。", "{}畫得很好。", "{}決定留下。", "大家推{}當代表。", "這句話出自{}。", "{}教授的課很滿。"],
    "han": ["{a}{b}很{c}，{d}也{e}。", "我們{e}{a}的{b}。", "{a}與{b}都{c}。", "因為{a}{c}，所以{b}{e}了。", "{a}{b}{e}{d}", "這次的{a}比{b}{c}。", "昨天{e}的{a}在{b}。", "{a}、{b}和{d}", "如果{a}不{c}，就{e}{b}。", "他們{e}了{a}，{d}還沒{e}。", "老師{e}{a}", "謝謝{a}{e}", "請找{a}的{b}", "{p}的{a}{e}", "{p}{a}", "在{p}{e}{a}", "{q}{a}協會{e}了{b}", "{a}讓{p}的{b}很{c}", "從{q}到{p}的{a}", "{q}的{a}", "{q}{a}", "{q}{a}公司{e}{b}", "聽說{p}{e}了{a}", "{x}{p}的{a}很{c}", "{x}{p}{e}了{b}", "{x}{e}了{a}", "{x}{q}{a}{e}", "{a}{x}{e}", "{q}{a}小組{e}{b}", "{e}{a}的{q}{b}中心指出{d}很{c}", "{a}的{q}{b}", "{q}{b}部門{e}{a}後，{d}{e}了"],
    "en name": ["Yesterday {} missed the bus.", "I spoke with {} about the garden.", "{} lives near the harbour.", "The report was written by {}.", "My name is {}.", "Kind regards, {}", "This parcel belongs to {}.", "We met {} at the station.", "Contact: {}", "The editor, {}, agreed.", "Ask {} if the door is open.", "According to {}, it rained.", "{} and {} share a flat.", "Thank you, {}!", "{} wrote to us again.", "Have you seen {} today?", "Signed, {}", "-- {}", "The letter from {} arrived.", "Dear {},", "{} will bring the cake.", "When {} came home, the lights were off.", "My uncle {} repairs clocks.", "{}", "Please help {} with the boxes.", "Suddenly {} laughed.", "Then {} left early.", "Perhaps {} knows.", "Meanwhile {} slept.", "The violinist {} plays tonight.", "Everyone likes {}.", "{}'s bicycle was stolen.", "Only {} remembered.", "A friend of {} phoned.", "We invited {}, of course.", "Will {} be there?", "{} smiled."],
    "en other": ["The {} opened last week.", "We visited {} in spring.", "{} is closed on Sundays.", "They moved to {}.", "A concert at the {} was cancelled.", "By the {}.", "{} won the match.", "In {} it snowed.", "Read about {} here.", "The new {} is fast.", "With {} and others.", "Near {} there is a lake.", "Gestern war die {} leer.", "Vor der {} steht ein Baum.", "Dans le {} il fait froid.", "En la {} no hay nadie.", "-- {}", "Thanks to {} we are done."],
    "phone": ["電話：{}", "請撥{}洽詢。", "我的手機是{}", "Phone: {}", "You can call {} any time.", "Dial {} for help.", "有空打{}。", "分機改成{}了", "{}", "（{}）", "Reach us on {}.", "LINE：{}", "留下號碼{}就走了。", "The number {} is busy.", "Text {} to join."],
    "id": ["身分證號碼{}", "證件：{}", "My social security number is {}.", "ID number {}", "他的證號是{}。", "National id: {}", "{}", "（{}）", "本人{}同意。", "帳戶持有人{}，", "Her number {} was copied.", "號碼{}有誤"],
    "code": ["訂單編號{}", "貨號{}已下架", "條碼{}讀不到", "Order {} is late.", "Item {} was returned.", "Version {} is out.", "Build {} failed.", "總共{}次", "第{}篇", "invoice {}", "發票{}", "比分{}", "barcode {} is blurred", "tracking {}", "step {}", "{}開始", "{}", "（{}）", "價格 {} 元", "{} minutes"],
    "email": ["信箱：{}", "Write to {} please.", "{}", "來信{}索取。", "E-mail {}", "把檔案寄給{}"],
    "address": ["地址：{}", "We moved to {}.", "{}", "我住在{}。", "Ship it to {} please.", "餐廳位於{}，"],
    "no address": ["{}出口集合", "{}公車停駛"],
    "ja": ["{}さんは元気です。", "昨日{}が来ました。", "私は{}です。", "{}様", "{}と話した。", "{}氏によると雨でした。"],
    "ja other": ["{}の天気はいい。", "{}に行った。", "{}は古い店だ。"],
    "ko": ["{} 씨를 만났다.", "어제 {}이 왔다.", "저는 {}입니다.", "{}님께", "{}과 이야기했다.", "{}는 집에 있다.", "{}, 안녕!"],
    "ko other": ["{}가 많다.", "{}를 봤다.", "어제 {} 샀다.", "{}에서 만나요.", "그 {}는 크다."],
    "ru": ["Вчера {} не пришёл.", "Меня зовут {}.", "Мы говорили с другом, это {}.", "{} живёт рядом.", "Автор — {}."],
    "ru other": ["Это {}.", "{} закрыт.", "Мы были в {}."],
}
_NOUNS = "天氣 房間 電影 早餐 會議 作業 手機 螢幕 牙刷 餐桌 窗簾 球場 山路 海邊 書店 火車 票價 鄰里 價值 農田 果汁 麵包 咖啡 茶葉 電梯 鋼琴 畫展 新聞 廣播 選舉 法律 預算 疫苗 醫院 病床 藥局 實驗 數據 模型 晶片 系統 伺服器 演算法 網路 遊戲 玩家 投手 球隊 教室 課本 考試 分數 老師 學生 記者 主播 店員 司機 漁民 農夫 議員 市長 住戶 房東 觀眾 讀者 社區 公園 河堤 步道 森林 溪流 海浪 颱風 地震 溫泉 夜市 攤位 租金 保險 股票 利率 基金 貨物 倉庫 工廠 機器 引擎 輪胎 汽車 單車 公車 捷運 班次 路線 地圖 相機 照片 歌曲 樂器 舞台 劇本 漫畫 小說 詩歌 語言 單字 句子 翻譯 字典 標籤 樣本 訓練 節目 直播 頻道 影片 預告 結局 角色 導演".split()
_ADJECTIVES = "安靜 便宜 漂亮 複雜 簡單 明顯 穩定 緩慢 迅速 潮濕 乾淨 平坦 陡峭 溫暖 寒冷 溫和 嚴格 高級 方便 清楚 新鮮 無聊 有趣 感人 脆弱 嶄新 特別 普通 古老".split()
_VERBS = "討論 修理 準備 整理 打掃 研究 公布 取消 延後 增加 減少 觀察 記錄 介紹 推薦 改寫 翻譯 訓練 測試 比較 種植 收集 補助 限制 支持 反對 規劃 管理 安排 應用 解決 連結 成立 開放 關閉 檢查 還原 出版 包裝 施工 游泳".split()
# Words that a surname's character ends.
_ENDINGS = "今年初 去年初 月初 最初 當初 暫時 當時 同時 隨時 平時 供應 反應 適應 電池 水池 由於 關於 至於 稻田 租金 資金 現金 課程 過程 工程 山林 森林 樹林 麵包 書包 火車 汽車 停車 高中 提高 最高 成立 文學 花園 校園 平方 地方 北方 對方 開關 機關 海關 體溫 高溫 配樂 音樂 快樂 這項 各項".split()
_OTHER_EN = "Garden Society River Street Market Valley Bridge Museum Hotel College Institute Library Council Bank Church Club Team Press Hospital Theatre Union Agency Festival Company Party Station Park Tower Castle Forest Harbour Gallery Orchestra Studio Factory Airport Lake Road".split()
_ORDINARY_EN = "New Old North South East West Upper Lower Royal Central National Green Golden Silver Great Little Big Red Blue White Public City Modern Early Late Spring Summer Winter Monday Friday January March Last Next Open Digital".split()
_NOUNS_KO = "지난달 도서실 조금만 모두가 전화기 고양이 이야기 서울역 정보도 한국어 주말에 강아지 문제집 기차역 신문사 오늘도 안경점 장난감 황금색 유리창 성공적 배달원 허리띠 고속도 차례로 오후에 신호등 전시회 이번주 지하철 공항철 선생님 정류장 주차장 우체국 미술관 박물관 영화관 운동장 하루에 예정보 원래는 변화가 기대가".split()
_PLACES_RU = "Новый Город, Красная Площадь, Большой Театр, Нижний Парк, Белая Река, Дальний Восток".split(", ")
_PLACES_JA = "渋谷 新宿 大阪 京都 神戸 札幌 仙台 銀座 浅草 上野".split()


def _made(r: random.Random) -> str:
    """An invented Latin name part, of a few syllables."""
    parts = [r.choice(("", "B", "C", "D", "F", "G", "H", "K", "L", "M", "N", "P", "R", "S", "T", "V", "W", "Br", "St", "Th", "Gr", "Qu")) + r.choice("aeiou") + r.choice(("l", "m", "n", "r", "s", "t", "nd", "rs", "ll", "")) for _ in range(r.choice((2, 2, 3)))]
    return "".join(parts).lower().capitalize() + r.choice(("", "", "son", "ford", "well", "stone", "ez", "ski", "er", "berg", "wood", "moss"))


def _examples(count: int, seed: int, words: Vocabulary) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Invented texts and the values in them with their labels; all other spans are O."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    rare = [chr(c) for c in range(0x4E00, 0x9FA0) if chr(c) not in words.han and chr(c) not in _NOT_GIVEN]

    def han() -> str:
        family = r.choice(DOUBLE_SURNAMES) if r.random() < 0.03 else r.choice(SURNAMES[:120] if r.random() < 0.5 else SURNAMES)
        given = lambda: r.choice(rare) if r.random() < 0.3 else r.choice(GIVEN)
        return family + "".join(given() for _ in range(r.choice((2,) * 9 + (1,))))

    lefts = ["", *(w for words in _NAME_LEFT.values() for w in words), *_LEFT_ONE, "By ", "by "]
    rights = ["", "", *(w for words in _NAME_RIGHT.values() for w in words), *(c for c, sort in _RIGHT_ONE.items() if sort != "place")]
    firsts, known = sorted(_FIRST_NAMES), sorted(words.title)

    def latin() -> str:
        a, b = r.choice(firsts) if r.random() < 0.4 else r.choice(known) if known and r.random() < 0.3 else _made(r), _made(r) if r.random() < 0.8 else r.choice(("Baker", "Stone", "Hill", "Young", "Wood", "Bell", "Cook", "King"))
        return r.choice((f"{a} {b}",) * 4 + (f"{b}, {a}", f"{a} {r.choice('ABCDEFGHJKLMNPRSTW')}. {b}", f"{b}, {a} {r.choice('ABCDEFGHJKLMNPRSTW')}."))

    def other_en() -> str:
        return r.choice((f"{_made(r)} {r.choice(_OTHER_EN)}",) * 3 + (f"{r.choice(sorted(_STARTERS))} {_made(r)}", f"{r.choice(sorted(_STARTERS))}, {_made(r)}",f"{r.choice(_ORDINARY_EN)} {_made(r)}", f"{r.choice(_ORDINARY_EN)} {r.choice(_OTHER_EN)}", f"{_made(r)} {r.choice(_ORDINARY_EN)} {r.choice(_OTHER_EN)}", f"{r.choice(_ORDINARY_EN)} {_made(r)} {r.choice(_OTHER_EN)}", f"{_made(r)}"))

    def plain_han() -> str:
        p = "".join(r.choice(rare + list(GIVEN)) for _ in range(2))
        if r.random() < 0.5:
            p = r.choice(SURNAMES) + (p[0] if r.random() < 0.5 else r.choice("山湖嶺橋堤林溪港谷城"))
        return r.choice(_TRAIN["han"]).format(a=r.choice(_NOUNS), b=r.choice((*_NOUNS, *sorted(_COMMON))) if r.random() < 0.8 else r.choice(sorted(_COMMON)), x=r.choice(_ENDINGS), q=(r.choice(SURNAMES) if r.random() < 0.6 else r.choice(rare)) + r.choice((*rare, *GIVEN, *"山湖嶺橋堤林溪港谷城")), c=r.choice(_ADJECTIVES), d=r.choice(_NOUNS), e=r.choice(_VERBS), p=p + r.choice(("市", "縣", "鎮", "區", "村", "里", "路", "街", "國小", "車站", "大橋", "書店", "大道", "大道", "小說", "小組", "小學")))

    ko = lambda: r.choice(_KO_FAMILY[:40]) + r.choice(_KO_GIVEN) + r.choice(_KO_GIVEN)
    ja = lambda: r.choice(_JA_FAMILY) + r.choice(("", r.choice(GIVEN) + r.choice("子美太郎一人也"), r.choice(("さくら", "ゆい", "ひろし", "たけし", "みき")), r.choice(GIVEN) + r.choice(GIVEN)))
    ru = lambda: r.choice(sorted(_RU_FIRST)) + " " + r.choice(("Баран", "Ковал", "Соболь", "Лебед", "Мороз", "Жук", "Зим")) + r.choice(("ов", "ова", "ин", "енко", "ский", "ев"))
    n2 = lambda: r.choice("23456789") + d(2)
    phones = [lambda: f"09{d(2)}-{d(3)}-{d(3)}", lambda: f"09{d(8)}", lambda: f"09{d(2)}-{d(6)}", lambda: f"(0{r.choice('2345678')}){r.choice('2345')}{d(3)}-{d(4)}", lambda: f"+886 9{d(2)} {d(3)} {d(3)}", lambda: f"({n2()}) {n2()}-{d(4)}", lambda: f"{n2()}.{n2()}.{d(4)}", lambda: f"{n2()}-{n2()}-{d(4)}", lambda: f"{n2()}{n2()}{d(4)}", lambda: f"+1 {n2()} {d(3)} {d(4)}", lambda: f"+44 7{d(3)} {d(6)}", lambda: f"07{d(3)} {d(6)}", lambda: f"1{r.choice('3578')}{d(9)}", lambda: "零九" + "".join(r.choice("零一二三四五六七八九") for _ in range(8)), lambda: f"0{r.choice('789')}0-{d(4)}-{d(4)}"]
    ids = [lambda: r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefgh") + r.choice("12") + d(8), lambda: f"{r.choice('ABCDEFGH')}{r.choice('12')}{d(2)} {d(3)} {d(3)}", lambda: r.choice("ABCEFGH") + r.choice("ABCD") + d(8), lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: f"{d(6)}19{d(2)}0{r.choice('123456789')}1{d(5)}", lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", lambda: f"{d(6)}-1{d(6)}", lambda: f"{r.choice('ABCDEFGH')}8{d(8)}"]
    codes = [lambda: f"20{d(2)}0{r.choice('123456789')}1{r.choice('012')}-{d(4)}", lambda: r.choice("ABCXYZ") + d(8), lambda: "".join(r.choice("ABCXYZ") for _ in range(2)) + d(6), lambda: f"47{d(11)}", lambda: f"{d(2)}.{d(1)}.{d(1)}.{d(2)}", lambda: d(6), lambda: d(7), lambda: f"20{d(2)}-0{r.choice('123456789')}-1{d(1)}", lambda: f"20{d(2)}/0{r.choice('123456789')}/1{d(1)} 19:30", lambda: d(8), lambda: d(12), lambda: f"0.{d(6)}", lambda: f"{d(3)}-{d(3)}-{d(1)}", lambda: d(9)]
    cued = {"codes": [s for s in _TRAIN["code"] if re.search("訂單|貨號|條碼|Order|Item|Version|Build|invoice|發票|barcode|tracking|step|次|第|元", s)]}
    kinds = ("phone", "id", "code", "code", "name", "name", "name", "name", "name", "han", "han", "han", "en name", "en name", "en name", "en other", "en other", "email", "address", "no address", "ja", "ja other", "ko", "ko other", "ru", "ru other")
    for _ in range(count):
        out, truth = [], []
        for _ in range(r.randint(2, 5)):
            kind = r.choice(kinds)
            frame = r.choice(_TRAIN[kind])
            if kind == "name" and r.random() < 0.3:
                # Every cue word with every other.
                frame = r.choice(lefts) + "{}" + r.choice(rights) + r.choice(("", "，", "。", plain_han()))
            if kind == "han":
                out.append(plain_han())
                continue
            value = {
                "phone": lambda: r.choice(phones)(), "id": lambda: r.choice(ids)(), "code": lambda: r.choice(codes)(), "name": han, "en name": latin, "en other": other_en, "ja": ja, "ko": ko, "ru": ru,
                "email": lambda: f"{r.choice('abcdef')}a{d(2)}{r.choice(('@', ' (at) ', '[at]'))}mail.test",
                "address": lambda: r.choice((f"{r.choice('東西南北')}山路{d(2)}號", f"{r.choice('東西南北')}城市中正區文化街{d(2)}巷{d(1)}號3樓", f"{r.randint(1, 999)} {_made(r)} Street")),
                "no address": lambda: f"{r.choice('東西南北')}山路{d(1)}號",
                "ja other": lambda: r.choice(_PLACES_JA), "ko other": lambda: r.choice(_NOUNS_KO), "ru other": lambda: r.choice(_PLACES_RU),
            }[kind]
            named = {"id": "id_number", "en name": "name", "ja": "name", "ko": "name", "ru": "name"}.get(kind, kind)
            values = [value() for _ in range(frame.count("{}"))]
            # Codes with the form of an identity or telephone number have a word beside them.
            if kind == "code" and re.fullmatch(r"[A-Z]?\d{8,9}|\d{12,13}", values[0]):
                frame = r.choice(cued["codes"])
                values = [values[0]] * frame.count("{}")
            out.append(frame.format(*values))
            if named in LABELS:
                truth += [(v, named) for v in values]
                # The same value again, where nothing speaks for it.
                if r.random() < 0.35:
                    out.append(plain_han() if r.random() < 0.5 else "")
                    bare = ("{}", f"{r.choice(_NOUNS)}{{}}的", f"{{}}{r.choice(_NOUNS)}", f"{r.choice(_NOUNS)}{{}}{r.choice(_VERBS)}") if kind == "name" else ("{}", frame)
                    out.append(r.choice(bare).replace("{}", values[0]))
        yield ("" if r.random() < 0.5 else "\n").join(out), truth


@lru_cache
def train(count: int = EXAMPLES, steps: int = STEPS, seed: int = SEED, folder: str = TOKENIZERS) -> Model:
    """Weights by pseudo-likelihood: each node's label given its features and its neighbours' labels.

    Spans overlap, so a first pass over all of them, without edges, gives the weights by which the second chooses. Words of
    the training texts are told by the texts' own pairs, as those of a corpus are by the corpus'.
    """
    texts = list(_examples(count, seed, vocabulary(folder)))
    pairs, single = Counter(), Counter()
    for text, _ in texts:
        single.update(c for c in text if _HAN.match(c))
        pairs.update(m.group(1) for m in _PAIR.finditer(text))
    words = vocabulary(folder).with_words({p for p, n in pairs.items() if n >= LEAST_PAIRS and n * n >= COHESIVE**2 * single[p[0]] * single[p[1]]})
    model = _fit(texts[: count // 4], Model({}, words), steps // 2, False)
    return _fit(texts, model, steps, True)


def _spans(text: str, truth: list[tuple[str, str]]) -> dict[tuple[int, int], str]:
    out = {}
    for value, kind in truth:
        at = text.find(value)
        while at >= 0:
            out[at, at + len(value)] = kind
            at = text.find(value, at + 1)
    return out


def _fit(texts, start: Model, steps: int, chosen: bool) -> Model:
    """Full-batch AdaGrad on the log of each node's probability."""
    index: dict[tuple[str, str], int] = {}
    columns: list[int] = []
    row_starts, node_starts, right_rows = [], [], []
    for text, truth in texts:
        spans = _spans(text, truth)
        nodes = candidates(text, Model(start.weights, start.words, True) if chosen else None)
        labels = []
        for n in nodes:
            kind = spans.get((n.start, n.end)) or next((k for (a, b), k in spans.items() if k in n.kinds and k != "name" and min(b, n.end) - max(a, n.start) > 0.5 * max(b - a, n.end - n.start)), "O")
            labels.append(kind if kind in n.kinds else "O")
        near: dict[int, list[tuple[str, str]]] = defaultdict(list)
        for a, b, k in edges(nodes) if chosen else ():
            near[a].append((k, labels[b]))
            near[b].append((k, labels[a]))
        for i, n in enumerate(nodes):
            node_starts.append(len(row_starts))
            for k in ("O", *n.kinds):
                if k == labels[i]:
                    right_rows.append(len(row_starts))
                row_starts.append(len(columns))
                used = [("bias", k)] + ([(x, k) for x in n.features] if k != "O" else [])
                used += [(kind, "both O" if k == other == "O" else "same" if k == other else "different") for kind, other in near[i]]
                columns += [index.setdefault(x, len(index)) for x in used]
    at, rows, groups = np.asarray(columns), np.asarray(row_starts), np.asarray(node_starts)
    sizes = np.diff(np.r_[groups, len(rows)])
    lengths = np.diff(np.r_[rows, len(at)])
    wanted = np.zeros(len(rows))
    wanted[right_rows] = 1
    w, seen = np.zeros(len(index)), np.full(len(index), 1e-6)
    for _ in range(steps):
        score = np.add.reduceat(w[at], rows)
        p = np.exp(score - np.repeat(np.maximum.reduceat(score, groups), sizes))
        p /= np.repeat(np.add.reduceat(p, groups), sizes)
        gradient = np.bincount(at, np.repeat(wanted - p, lengths), len(w)) - L2 * w
        seen += gradient**2
        w += 0.5 * gradient / np.sqrt(seen)
    return Model({k: float(w[i]) for k, i in index.items()}, start.words)


# --- Texts --------------------------------------------------------------------------------------------------------------


def _visible(text: str) -> tuple[str, list[int] | None]:
    """The text that is searched, and, where characters were left out, the place of each of its characters."""
    if _IS_WIDE.search(text):
        text = text.translate(_WIDE)
    if not _HIDDEN.search(text):
        return text, None
    places = [i for i, c in enumerate(text) if not _HIDDEN.match(c)]
    return "".join(text[i] for i in places), places


def find(text: str, model: Model, skip: bool = True) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of personal information."""
    searched, places = _visible(text)
    nodes = candidates(searched, model)
    spans = [(n.start, n.end, k) for n, k in zip(nodes, label(nodes, model, skip=skip)) if k != "O"]
    return spans if places is None else [(places[a], places[b - 1] + 1, k) for a, b, k in spans]


def put_placeholders(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(out) + text[at:]


def _redact(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for batch in batches:
            spans = [find(t, model) if t else [] for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "redacted": [put_placeholders(t, s) if s else t for t, s in zip(batch["text"], spans)], "kinds": [sorted({k for _, _, k in s}) for s in spans]})

    return run


def _kinds(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for batch in batches:
            rows = [(k, kind) for k, t in zip(batch["key"], batch["text"]) for kind in sorted({x for _, _, x in find(t, model)})]
            yield pd.DataFrame(rows, columns=["key", "pii_kind"])

    return run


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch: how often each pair of adjacent Han characters occurs; the code of a pair is first * 2^16 + second."""
    for batch in batches:
        points = np.frombuffer("\n".join(batch["text"]).encode("utf-32-le", "surrogatepass"), np.uint32)
        han = (points >= 0x3400) & (points <= 0x9FFF)
        both = han[:-1] & han[1:]
        pairs, n = np.unique(points[:-1][both].astype(np.uint32) << np.uint32(16) | points[1:][both], return_counts=True)
        yield pd.DataFrame({"pair": pairs.astype(np.int64), "n": n})


def corpus_words(texts: list[DataFrame]) -> set[str]:
    """Pairs of Han characters that are words by the counts of all texts (frames with a column `text`).

    A character has at most 1 / COHESIVE^2 such partners at each side (c(xy) >= t^2 c(x), as c(xy) <= c(y)), so the result is bounded by the alphabet, whatever the corpus' size.
    """
    all_texts = texts[0]
    for t in texts[1:]:
        all_texts = all_texts.unionByName(t)
    pairs = all_texts.filter("text <> ''").mapInPandas(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    sides = cut(pairs.select("pair", "n", F.shiftright("pair", 16).alias("a"), F.col("pair").bitwiseAND(0xFFFF).alias("b")))
    # One row for each of at most 27,648 characters.
    first = F.broadcast(sides.groupBy("a").agg(F.sum("n").alias("n_a")))
    last = F.broadcast(sides.groupBy("b").agg(F.sum("n").alias("n_b")))
    found = sides.filter(F.col("n") >= LEAST_PAIRS).join(first, "a").join(last, "b").filter(F.col("n") * F.col("n") >= COHESIVE**2 * F.col("n_a") * F.col("n_b"))
    return {chr(r["a"]) + chr(r["b"]) for r in found.select("a", "b").collect()}


def model_for(texts: list[DataFrame]) -> Model:
    """The trained weights with the words of a corpus."""
    model = train()
    return Model(model.weights, model.words.with_words(corpus_words(texts)))


def redact(rows: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """key, redacted, kinds of every row; the model is made with the words of the same rows unless given."""
    own = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    held = rows.sparkSession.sparkContext.broadcast(model or model_for([own.select("text")]))
    return own.mapInPandas(_redact(held), f"key {dict(rows.dtypes)[key]}, redacted string, kinds array<string>").withColumnRenamed("key", key)


def find_kinds(rows: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """record_id, pii_kind: a row for each kind that a record holds; the model as in `redact`."""
    own = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("key is not null and text <> ''")
    held = rows.sparkSession.sparkContext.broadcast(model or model_for([own.select("text")]))
    return own.mapInPandas(_kinds(held), "key string, pii_kind string").select(F.col("key").alias("record_id"), "pii_kind").distinct()
