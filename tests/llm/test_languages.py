import random

import pytest

from inkwarp.llm.languages import OTHER, label_segments, language_code, language_table, plain, sample_labelled, segments, train_on
from pyspark.sql import functions as F

FRAMES = {
    "en": ["The survey near {} links {} with {} at {} sites.", "Nobody in {} had compared {} and {} until this study."],
    "de": ["Die Erhebung bei {} verknüpft {} und {} an {} Orten.", "Niemand in {} hatte vor dieser Studie {} und {} verglichen."],
    "fr": ["L’enquête menée près de {} relie {} et {} à {} endroits.", "Personne à {} n’avait comparé {} et {} avant cette étude."],
    "es": ["La encuesta hecha cerca de {} relaciona {} y {} en {} lugares.", "Nadie en {} había comparado {} y {} hasta este estudio."],
    "ru": ["Опрос близ города {} связывает темы «{}» и «{}» в {} местах.", "До этой работы никто в городе {} не сравнивал {} и {}."],
    "ko": ["{} 부근을 조사하여 {} 및 {} 사이의 관계를 밝혔다.", "이 연구 전에는 {}에서 {} 및 {}의 차이를 비교한 사람이 없었다."],
    "ja": ["{}の近くを調べ、{}と{}のつながりを示した。", "この研究まで、{}で{}と{}を比べた人はいなかった。"],
    "zh": ["在{}附近调查了地点，说明了{}与{}的关系。", "在这项研究之前，{}没有人比较过{}和{}。"],
}


def _text(lang, rng):
    names = ["Galmo", "Venta", "Orri", "Lisno", "Pamdre"]
    return rng.choice(FRAMES[lang]).format(*(rng.choice(names) for _ in range(4)))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    rows = []
    for lang in FRAMES:
        for _ in range(60):
            said = lang if rng.random() > 0.08 else rng.choice(list(FRAMES))
            rows.append((said, _text(lang, rng)))
    return train_on(rows)


def test_held_out_accuracy(model):
    rng = random.Random(9)
    true = [lang for lang in FRAMES for _ in range(40)]
    got = model.predict([plain(_text(lang, rng)) for lang in true])
    assert sum(g[0] == t for g, t in zip(got, true, strict=True)) >= 0.98 * len(true)
    assert all(0 < c <= 1 for _, c in got)


def test_segments_of_mixed_texts(model, spark):
    rng = random.Random(4)
    ko, en, fr, ja = (_text(x, rng) for x in ("ko", "en", "fr", "ja"))
    rows = [(1, f"{ko} {en}"), (2, f"{fr[:-1]} / {en}"), (3, ja + ja + ko), (4, "감염(infection) 문제와 음정(shelf 3) 문제를 두고 의견이 갈린다."), (5, None), (6, " "), (7, "123 !?"), (8, en * 3000), (1, f"{ko} {en}")]
    df = spark.createDataFrame(rows, "id long, lang string")
    got = {}
    for r in language_table(df, ["id"], "lang", model).orderBy("id", "segment").collect():
        got.setdefault(r.id, []).append(r.lang)
    assert got[2] == ["fr", "en"] and got[3] == ["ja", "ko"] and got[4] == ["ko"] and got[8] == ["en"]
    assert got[1] == ["ko", "ko", "en", "en"] and not {5, 6, 7} & set(got)
    assert language_table(spark.createDataFrame([], df.schema), ["id"], "lang", model).count() == 0


def test_segment_offsets():
    text = "Un deux : trois = Four five. Six"
    assert [text[s:e] for s, e in segments(text)] == ["Un deux", "trois", "Four five.", "Six"]


def test_codes(spark):
    said = ["ko", "KOR", "en-GB", " de_AT ", "zh-Hans", "fre", "", "?", "xx", "und", "zxx", None, "english", "jpn"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").orderBy("i").select(language_code(F.col("s"))).collect()]
    assert got == ["ko", "ko", "en", "de", "zh", "fr", None, None, None, None, None, None, None, "ja"]


def test_sample_is_bounded_and_slips_stay_few(spark):
    rows = [(i, "한국어 문장", "ko") for i in range(300)] + [(1000 + i, "한국어 문장", "ru") for i in range(3)] + [(2000 + i, "Русский текст", "ru") for i in range(5)] + [(3000, None, "en"), (3001, "x", None)]
    got = sample_labelled(spark.createDataFrame(rows, "id long, t string, c string"), "t", "c", ["id"], most=20)
    assert len([1 for x, _ in got if x == "ko"]) == 20
    assert sorted(t for x, t in got if x == "ru")[:5] == ["Русский текст"] * 5


def test_slips_do_not_crowd_out_a_rare_language(spark):
    rows = [(i, "한국어 문장", "ko") for i in range(4000)] + [(5000 + i, "한국어 문장", "ru") for i in range(100)] + [(9000 + i, "Русский текст", "ru") for i in range(10)]
    got = sample_labelled(spark.createDataFrame(rows, "id long, t string, c string"), "t", "c", ["id"], most=10)
    assert [t for x, t in got if x == "ru"] == ["Русский текст"] * 10


def test_language_of_one_percent_is_learned(spark):
    rng = random.Random(6)
    rows = [(i, _text(lang := "es" if i % 100 == 7 else rng.choice(["en", "de", "fr"]), rng), lang) for i in range(3000)]
    rows = [(i, t, rng.choice(["en", "es", "de"]) if rng.random() < 0.002 else lang) for i, t, lang in rows]
    found = train_on(sample_labelled(spark.createDataFrame(rows, "id long, t string, c string"), "t", "c", ["id"], most=60))
    texts = [(lang, plain(_text(lang, rng))) for lang in ("en", "de", "fr", "es") for _ in range(25)]
    got = found.predict([t for _, t in texts])
    assert sum(g[0] == lang for g, (lang, _) in zip(got, texts, strict=True)) >= 98


def test_text_in_no_known_language(model):
    assert [x[0] for x in model.predict([plain("ภาษาไทยไม่มีอยู่ในรายการนี้"), plain("Αυτή η γλώσσα δεν είναι γνωστή")])] == [OTHER, OTHER]


def test_confidence_is_that_of_the_language_given(model):
    rng = random.Random(8)
    text = f"{_text('fr', rng)} Venta. {_text('fr', rng)}"
    found = label_segments([text], model)[0]
    assert [x[2] for x in found] == ["fr"] and 0.7 < found[0][3] <= 1
    chances, _ = model.chances([plain("Venta")])
    alone = label_segments(["Venta."], model)[0]
    assert abs(alone[0][3] - chances[0][model.languages.index(alone[0][2])]) < 1e-9


def test_no_labels(spark):
    none = sample_labelled(spark.createDataFrame([(1, "Some text.", None)], "id long, t string, c string"), "t", "c", ["id"])
    assert none == [] and train_on(none).predict(["some text"]) == [(None, 0.0)]
    assert language_table(spark.createDataFrame([(1, "Some text.")], "id long, t string"), ["id"], "t", train_on(none)).count() == 0
