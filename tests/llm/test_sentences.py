import pytest
import regex

from inkwarp.llm.sentences import sentence_table, sentence_units

CASES = [
    ["Dr. Orrin came at 7.30 a.m. to vol. 3.", "It rained, i.e. a lot.", "Rope, salt etc.", "The end… and more."],
    ["Fr. Velmor maß z. B. Salz am 3. Mai in Rimohul.", "Es waren ca. 3,5 Prozent, d. h. weniger.", "Man fand Seile usw.", "„Fertig. Niemand fragte.“", "Das war, u. a. in Rom, alles."],
    ["M. Orvel écrivit « Pas encore… » à côté.", "« Assez ! »", "J.-P. Osten a noté, p. ex., cela.", "Pourquoi ?"],
    ["¿Fue el coro?", "La Sra. Orvel vio el núm. 4.", "«Se acabó. Nadie habló.»", "A las 9 a. m. llegó D. K. T. Osten."],
    ["В 7.30 ч. пришёл Проф. В. К. Орвел.", "А. Б. Тавик нашёл 3,2 мм и т. д. в том же месте.", "«Готово. Никто не спросил.»", "Там соль и т. п.", "В архиве, см. рис. 3 и с. 12, лежат письма.", "Письма числом 25.", "Иначе говоря, да."],
    ["옛 문서는 분명하지 않다.", "Dr. 할베는 “끝났다. 다시 세어 보자.”라고 적었다.", "“이제 됐어!”", "(이때 아무도 말하지 않았다.)", "그는 '왜 지금이지? 아직 이르다.' 하고 갔다.", "2021. 3. 13.에 열렸다.", "기다렸다… 그러나 없었다.", "v2.2.1 판이 빠졌다!"],
    ["사람은 64명이 모였습니다", "저녁에는 사진을 함께 보았습니다"],
    ["ฝนตกตั้งแต่เช้าจนถึงเย็น", "รถคันนี้วิ่งได้ 30 กิโลเมตร", "หนังสือเล่มนี้เก่ามากแล้ว"],
    ["क्या यह पुरानी किताब है?", "डॉ. ओरिन ने 3.42 मिमी की दूरी मापी।", "उसने लिखा, “काम हो गया। कोई नहीं बोला।” और चला गया।", "वह रुका… फिर धीरे से बोला।"],
    ["متى يبدأ الدرس؟", "قالت: «انتهى العمل. لم يسأل أحد.» ثم خرجت.", "كتب د. أورين الرقم 3.12 في الدفتر."],
]
DENSE = [
    ["値は3.30ミリで低い。", "待った……それでも来なかった。", "「なぜ今なのか？まだ早い。」と叫んで向かった。", "「もういい！」", "本当なのか！？", "第4.1版（未完。改訂中）にある。"],
    ["旧档案写到了汇率。", "“再等等……”K. T. 维莫一边说一边走。", "（没有人提到出口。）", "第2.4版（草稿。未定）提到了库存。", "No. 7和p. 12都提到了。", "真的吗？！"],
]


@pytest.mark.parametrize("units", CASES)
@pytest.mark.parametrize("gap", [" ", "\n", "\r\n", " ", "  "])
def test_spaced(units, gap):
    text = gap.join(units)
    assert [text[s:e] for s, e in sentence_units(text)] == units


@pytest.mark.parametrize("units", DENSE)
@pytest.mark.parametrize("gap", ["", "\n", "　"])
def test_dense(units, gap):
    text = gap.join(units)
    assert [text[s:e] for s, e in sentence_units(text)] == units


def test_blocks():
    text = "# What is it? A short answer\n\n- One. Two.\n- Three\n  goes on\n\nA line\nbreak. 다음이다.이것은 붙었다.\n \n\n12. Ten.\n13. Two. Three\n"
    assert [text[s:e] for s, e in sentence_units(text)] == ["What is it? A short answer", "One. Two.", "Three\n  goes on", "A line\nbreak.", "다음이다.", "이것은 붙었다.", "Ten.", "Two. Three"]


@pytest.mark.parametrize("text", [None, "", " \n\t ", "#", "- "])
def test_empty(text):
    assert [u for u in sentence_units(text) if text[u[0] : u[1]].strip("#- ")] == []


def test_open_quote_and_long_text():
    text = "He said “no. It rained. " * 2000
    got = sentence_units(text)
    assert len(got) == 4000 and got[-1][1] == len(text.rstrip())
    assert len(sentence_units("(" * 100_000 + "a. B")) >= 1


@pytest.mark.parametrize("units", [["'Tis late.", "He left in '98.", "It rained.", "All slept."], ["The '90s ended.", "It was rock 'n' roll.", "Get 'em.", "All slept."], ["He ('tis late.", "It rained.", "'98 was.", "He left."], ["“'Tis late.”", "In '98 he said 'no. He left.' and went.", "All slept."]])
def test_apostrophes_left_open(units):
    text = " ".join(units)
    assert [text[s:e] for s, e in sentence_units(text)] == units


def test_many_apostrophes_left_open():
    assert len(sentence_units("He said 'no. It rained. " * 2000)) == 4000
    assert len(sentence_units("'a (b' c). D. " * 2000)) == 2001


def test_table(spark):
    rows = [("a", "One. Two.", 1), ("a", "One. Two.", 1), ("b", None, 1), (None, "", 1)]
    df = spark.createDataFrame(rows, "document_id string, text string, start_pos int")
    got = sentence_table(df, "document_id", "text", with_text=True).distinct().orderBy("unit").collect()
    assert [(r.document_id, r.unit, r.start_pos, r.end_pos, r.sentence) for r in got] == [("a", 1, 0, 4, "One."), ("a", 2, 5, 9, "Two.")]
    assert sentence_table(spark.createDataFrame([], df.schema), "document_id", "text").count() == 0


@pytest.mark.parametrize("mark", [c for c in regex.findall(r"\p{Sentence_Break=STerm}", "".join(chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000))] + ["．", "﹒"])
def test_terminators_of_every_script(mark):
    text = f"ⴰⴱⴳ ⴷⴹ{mark} ⴽⵍ ⵎⵏ{mark}"
    assert [text[s:e] for s, e in sentence_units(text)] == [f"ⴰⴱⴳ ⴷⴹ{mark}", f"ⴽⵍ ⵎⵏ{mark}"]
