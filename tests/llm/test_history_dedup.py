import random

from inkwarp.llm.history_dedup import HistoryIndex, article_units, dedup_all, dedup_batches
from inkwarp.llm.history_queries import article_key, doi_key
from inkwarp.llm.streams import dedup_stream
from pyspark.sql import functions as F

ENTRY = "array<struct<value:string,attributes:map<string,string>>>"
SCHEMA = f"rec_no long, batch_no int, key string, titles {ENTRY}, abstracts {ENTRY}, unit string"
WORDS = [f"w{i}" for i in range(400)]


def _entry(*texts):
    return [(t, {"lang": "x"}) for t in texts]


def _records(seed=3, n=60):
    """Articles, some delivered again with small changes, under the same key, or with another abstract."""
    rng = random.Random(seed)
    rows, first, texts = [], {}, []
    for i in range(1, n + 1):
        if i > 10 and rng.random() < 0.45:
            j, title, body, key = rng.choice(texts)
            how = rng.choice(["same", "case", "typo", "drop", "key", "other"])
            if how == "other":
                title2, body2, key2 = title, " ".join(rng.choices(WORDS, k=50)), f"k{i}"
            elif how == "key":
                title2, body2, key2 = f"Other name {i}", " ".join(rng.choices(WORDS, k=50)), key
            else:
                title2 = title.upper() if how == "case" else title.replace("study", "stduy") if how == "typo" else title
                body2 = " ".join(body.split()[:42]) if how == "drop" else body
                key2 = None
            rows.append((i, i // 12, key2, _entry(title2), _entry(body2), "u"))
            if how == "other":
                texts.append((i, title2, body2, key2))
            else:
                first[i] = j
        else:
            title, body = f"A study of {rng.choice(WORDS)} and {rng.choice(WORDS)} in volume {1000 + i}", " ".join(rng.choices(WORDS, k=50))
            rows.append((i, i // 12, f"k{i}", _entry(title), _entry(body, None), "u"))
            texts.append((i, title, body, f"k{i}"))
    return rows, first


def _keys(df):
    return df.select(F.col("rec_no").alias("rec"), "key")


def test_finds_repeats(spark):
    rows, first = _records()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.rec: r["first"] for r in dedup_all(article_units(df), _keys(df)).collect()}
    assert got == first and len(first) > 8


def _batch(spark, texts, keys):
    df = spark.createDataFrame([(i, 0, None, _entry(t), _entry(x), "u") for i, (t, x) in texts.items()], SCHEMA)
    return article_units(df), spark.createDataFrame(keys, "rec long, key string")


def test_batches_equal_one_load(spark, tmp_path):
    rows, first = _records(8)
    got = {}
    for b in range(6):
        if b in (0, 3):  # opened again by its folder
            index = HistoryIndex(spark, str(tmp_path / "index"), buckets=3)
        df = spark.createDataFrame([r for r in rows if r[1] == b], SCHEMA)
        index.add(article_units(df), _keys(df))
        got |= {r.rec: r["first"] for r in index.firsts().collect()}
    assert got == first == {r.rec: r["first"] for r in index.classes().collect()}


def test_batch_added_twice_changes_nothing(spark, tmp_path):
    rows, first = _records(8)
    index = HistoryIndex(spark, str(tmp_path / "index"), buckets=2)
    for b in (0, 1, 2, 2, 3, 4, 5):
        df = spark.createDataFrame([r for r in rows if r[1] == b], SCHEMA)
        index.add(article_units(df), _keys(df))
    assert {r.rec: r["first"] for r in index.classes().collect()} == first


def test_batch_that_joins_classes_of_history(spark, tmp_path):
    one, two = ("First study 12", "a b c d e f g h"), ("Other study 13", "q r s t u v w x")
    new = [("New 14", "i j k l m n"), ("New 15", "o p o o p p"), ("New 16", "z y z z y y")]
    texts = [{1: one, 2: two, 5: two}, {6: one}, {7: new[0], 8: new[1], 9: new[2]}]
    keys = [[(1, "a1"), (2, "d2"), (2, "a2"), (5, "a5")], [(6, "d2")], [(7, "a2"), (8, "a5"), (9, "a1")]]
    got = []
    for b, k in zip(texts, keys, strict=True):
        index = HistoryIndex(spark, str(tmp_path / "index"), buckets=2)
        index.add(*_batch(spark, b, k))
        got.append({r.rec: r["first"] for r in index.firsts().collect()})
    want = dict.fromkeys((2, 5, 6, 7, 8, 9), 1)
    assert got == [{5: 2}, {6: 1}, {7: 1, 8: 1, 9: 1}]
    assert {r.rec: r["first"] for r in index.classes().collect()} == want
    one_load = dedup_all(*_batch(spark, {i: x for b in texts for i, x in b.items()}, sum(keys, [])))
    assert {r.rec: r["first"] for r in one_load.collect()} == want


def test_bridge_by_key_and_text(spark, tmp_path):
    """Record 3 has the id of 1 and a text near that of 2; record 4 is near 2 alone."""
    body = [f"w{i}" for i in range(40)]
    texts = [{1: ("First study 12", "a b c d e f g h"), 2: ("Other study 13", " ".join(body))}, {3: ("Other study 13", " ".join(body[:34]))}, {4: ("Other study 13", " ".join(body[8:]))}]
    keys = [[(1, "a")], [(3, "a")], [(4, None)]]
    index, got = HistoryIndex(spark, str(tmp_path / "index"), buckets=2), []
    for b, k in zip(texts, keys, strict=True):
        index.add(*_batch(spark, b, k))
        got.append({r.rec: r["first"] for r in index.firsts().collect()})
    assert got == [{}, {3: 1}, {4: 1}] and {r.rec: r["first"] for r in index.classes().collect()} == {2: 1, 3: 1, 4: 1}


def test_random_batches_equal_brute_force(spark):
    """Texts of few words with shared tokens, spread hot keys, ids that bridge; any order of batches."""
    rng = random.Random(5)
    base = [[rng.choice(WORDS[:60]) for _ in range(24)] for _ in range(14)]
    rows = []
    for i in range(1, 121):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = rng.choice(WORDS[:60])
        rows.append((i, "Title 1" if i % 3 else "Titel 1", " ".join(words[: rng.randrange(12, 25)]), f"k{rng.randrange(400)}"))

    def pairs(text):
        w = text.split()
        return set(zip(w, w[1:], strict=False))

    up = {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, ta, xa, ka) in enumerate(rows):
        for b, tb, xb, kb in rows[:i]:
            p, q = pairs(xa), pairs(xb)
            o = len(p & q)
            if ka == kb or o >= 0.5 * len(p | q) and o >= 0.75 * min(len(p), len(q)):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    want = {i: find(i) for i in up if find(i) != i}
    numbers = list(range(120))
    rng.shuffle(numbers)
    batches = []
    for part in (numbers[:50], numbers[50:90], numbers[90:]):
        df = spark.createDataFrame([(rows[i][0], 0, rows[i][3], _entry(rows[i][1]), _entry(rows[i][2]), "u") for i in part], SCHEMA)
        batches.append((article_units(df), _keys(df)))
    got = {r.rec: r["first"] for r in dedup_batches(spark, batches, buckets=4, hot=3).collect()}
    assert got == want and len(got) > 60


def test_hot_group_of_copies_is_a_star(spark):
    rows = [(i, 0, None, _entry("One title 12"), _entry("a b c d e f g h"), "u") for i in range(1, 400)] + [(500, 0, None, _entry("Another 13"), _entry("z y x"), "u")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = dedup_all(article_units(df), _keys(df), buckets=2).collect()
    assert len(got) == 398 and {r["first"] for r in got} == {1}


def test_nulls_blanks_and_titles_alone(spark):
    rows = [
        (1, 0, None, None, None, "u"), (2, 0, None, [], [], "u"), (3, 0, None, _entry(None, " "), None, "u"),
        (4, 0, None, _entry("수술에서 진단까지: 기록 제3847권을 읽다"), None, "u"), (5, 0, None, _entry("수술에서 진단지: 기록 제3847권을 읽다"), [], "u"),
        (6, 0, None, _entry("수술에서 진단까지: 기록 제3847권을 읽다 II"), None, "u"), (7, 0, None, _entry("수술에서 진단까지: 기록 제3848권을 읽다"), None, "u"),
        (8, 0, None, _entry("x " * 20000), _entry("long text 5 " * 30000), "u"), (None, 0, "k", _entry("t"), None, "u"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.rec, r["first"]) for r in dedup_all(article_units(df), _keys(df)).collect()] == [(5, 4)]
    none = spark.createDataFrame([], SCHEMA)
    assert dedup_all(article_units(none), _keys(none)).count() == 0


def test_ids(spark):
    ids = ["KX:KXA000000344", "kxa 000000344", "KXA-000000344 ", "N/A", "-", "KXA000000000", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").orderBy("i").select(article_key(F.col("x"))).collect()]
    assert got == ["KXA000000344"] * 3 + [None] * 5
    dois = ["https://doi.org/10.9/Kx.1", "doi:10.9/kx.1 ", "10.9/KX.1", "n/a", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(dois)], "i int, x string").orderBy("i").select(doi_key(F.col("x"))).collect()]
    assert got == ["10.9/kx.1"] * 3 + [None] * 2


def test_dedup_of_a_stream(spark, tmp_path):
    entry = "array<struct<value:string>>"
    schema = f"rec_no long, key string, titles {entry}, abstracts {entry}"
    body = " ".join(f"w{i}" for i in range(30))
    rows = [[(1, "k", [("Title 12",)], [(body,)]), (2, None, [("Other 13",)], [("x y z",)])], [(3, None, [("TITLE 12",)], [(body,)]), (4, "k", [("New 14",)], None)]]
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    got = {}
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = dedup_stream(source, HistoryIndex(spark, str(tmp_path / "index"), buckets=2), article_units, lambda d: d.select(F.col("rec_no").alias("rec"), "key"), lambda d, n: got.update({r.rec: r["first"] for r in d.collect()}), str(tmp_path / "check"))
    q.awaitTermination()
    assert got == {3: 1, 4: 1}
