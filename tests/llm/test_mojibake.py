import pytest

from inkwarp.llm.mojibake import garbled, repair

SOUND = [
    "Diese Übersicht führt Öl und Dünger auf.",
    "앞으로는 감염의 변화가 투약량에 달려 있는지 따져 보아야 한다.",
    "Записи на тему «орбита» велись 83 лет, прежде чем появилось слово «ноты».",
    "この研究まで、銀河と軌道を比べた人はいなかった。",
    "占地763亩的果园位于伊阿尤，占总面积的一半。",
    "L’enquête relie récolte et semence à 555 endroits, où figure « été ».",
]
LAYERS = [("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("cp949", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "latin-1")]


@pytest.mark.parametrize("written,read", LAYERS)
def test_round_trip(written, read):
    for text in SOUND:
        if text.isascii():
            continue
        try:
            bad = text.encode(written).decode(read)
        except UnicodeError:
            continue
        if bad == text or (written, read) == ("cp949", "latin-1") and "앞" not in text or written in ("koi8-r", "cp1251") and "Записи" not in text:
            continue
        assert repair(bad)[0] == text, (written, read, bad)


def test_two_layers():
    for text in SOUND:
        bad = text.encode().decode("latin-1").encode().decode("latin-1")
        new, passes = repair(bad)
        assert new == text and passes >= 2


@pytest.mark.parametrize("layers", [3, 5, 6])
def test_many_layers(layers):
    for text in (SOUND[0], SOUND[5]):
        bad = text
        for _ in range(layers):
            bad = bad.encode().decode("latin-1")
        assert repair(bad)[0] == text


@pytest.mark.parametrize("readers", [("cp1252", "mac_roman"), ("mac_roman", "latin-1"), ("latin-1", "cp850", "latin-1")])
def test_layers_of_several_readers(readers):
    text = bad = "Diese Übung für Öl und Dünger"
    for r in readers:
        bad = bad.encode().decode(r)
    assert repair(bad)[0] == text


@pytest.mark.parametrize("text", [*SOUND, None, "", "plain", "Chữ Ã và chữ Â đều có", "ÂGE DU BRONZE", "├─ box\n│  └─ 7 ▒▒░ ½ full", "At 5 €/kg for ±82 µm wire at 20 °C — a naïve café™ price…", "NÃO HÁ SESSÃO AMANHÃ.", "﷽ ㎏ ①②③ éäô", "Það er ekki öðru að treysta", "Iğdır yolunda şarkı", "👩🏽‍🚀🇰🇷 ㅋㅋㅋㅠㅠ", "Zażółć gęślą jaźń", "‫אבג 123‬ ψάχνω"])
def test_sound_text_stays(text):
    assert repair(text) == (text or "", 0)


@pytest.mark.parametrize("bad,sound", [("Il va Ã\xa0 Paris.", "Il va à Paris."), ("Très bien, il va Ã\xa0 Paris cet été.", "Très bien, il va à Paris cet été."), ("Ã\x85rhus", "Århus")])
def test_second_half_that_is_white_space(bad, sound):
    assert repair(bad) == (sound, 1)


def test_part_of_a_text():
    assert repair("두 모임이 갈린다. " + "간추려 말하면 줄었다.".encode("cp949").decode("latin-1") + " 끝났다.")[0] == "두 모임이 갈린다. 간추려 말하면 줄었다. 끝났다."


def test_table(spark):
    bad = SOUND[0].encode().decode("latin-1")
    rows = [(1, bad, "x"), (2, bad, "x"), (3, SOUND[1], "x"), (4, None, "x"), (5, "", "x"), (6, "gef�hrt", "x"), (7, ("ü" + bad) * 3000, "x")]
    got = {r.doc_id: r for r in garbled(spark.createDataFrame(rows, "doc_id long, t string, restored string"), "doc_id", "t").collect()}
    assert set(got) == {1, 2, 6, 7}
    assert got[1].restored == SOUND[0] and got[1].whole
    assert got[6].restored is None and not got[6].whole
    assert garbled(spark.createDataFrame([], "doc_id long, t string"), "doc_id", "t").count() == 0
