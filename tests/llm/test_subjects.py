import random

import numpy as np

from inkwarp.llm.subjects import assign_subjects, columns, memberships, mixtures, subject_factor, term_matrix, terms

AREAS = {"a": "apple pear plum cherry quince".split(), "b": "bolt screw nut rivet washer".split(), "c": "은하 궤도 항성 성운 일식".split()}
STOCK = "the survey near town links and shows that of costs fell".split()


def _docs(n, seed):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        kind = rng.choice(["a", "b", "c", "ab", ""])
        words = [w for k in kind for w in rng.choices(AREAS[k], k=6)]
        words += rng.choices(STOCK, k=10) if kind else "editors thank all who wrote last year to office".split()
        rng.shuffle(words)
        rows.append((i, [" ".join(words[:3]), None, " ".join(words[3:])], "x"))
        truth[i] = set(kind)
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = _docs(600, 5)
    rng = random.Random(1)
    labels = []
    for i in range(120):
        for s in truth[i]:
            labels.append((i, s if rng.random() > 0.1 else rng.choice("abc")))
    labels += [(1, "nope"), (2, None), (None, "a")]
    df = spark.createDataFrame(rows, "id long, texts array<string>, share string")
    got = {}
    for r in assign_subjects(df, "id", "texts", spark.createDataFrame(labels, "id long, subject string"), [(k, [k]) for k in AREAS], bits=12).collect():
        got.setdefault(r.id, set()).add(r.subject_code)
    right = sum(got.get(i, set()) == truth[i] for i in range(120, 600))
    assert right >= 0.95 * 480


def test_area_that_holds_most_documents(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    for i in range(600):
        kind = "b" if i % 12 == 5 else "c" if i % 12 == 9 else "a"
        words = rng.choices(AREAS[kind], k=12) + rng.choices(STOCK, k=4)
        rng.shuffle(words)
        rows.append((i, [" ".join(words)]))
        truth[i] = {kind}
    labels = spark.createDataFrame([(i, s) for i in range(120) for s in truth[i]], "id long, subject string")
    got = {}
    for r in assign_subjects(spark.createDataFrame(rows, "id long, texts array<string>"), "id", "texts", labels, [(k, []) for k in AREAS], bits=12).collect():
        got.setdefault(r.id, set()).add(r.subject_code)
    assert sum(got.get(i) == truth[i] for i in truth) >= 0.95 * 600


def test_passing_word_is_no_subject(spark):
    rows, _ = _docs(300, 7)
    rows.append((999, ["apple pear plum cherry quince apple pear plum " + "bolt " + "survey near town"], "x"))
    rows += [(1000, [], "x"), (1001, None, "x"), (1002, ["", None], "x"), (1003, ["apple " * 5000], "x")]
    df = spark.createDataFrame(rows, "id long, texts array<string>, share string")
    labels = spark.createDataFrame([(i, k) for i, (_, t, _) in enumerate(rows[:200]) for k in AREAS if any(w in str(t) for w in AREAS[k])], "id long, subject string")
    got = [(r.id, r.subject_code) for r in assign_subjects(df, "id", "texts", labels, [(k, []) for k in AREAS], bits=12).where("id >= 999").collect()]
    assert sorted(got) == [(999, "a"), (1003, "a")]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, texts array<string>")
    assert assign_subjects(df, "id", "texts", spark.createDataFrame([], "id long, subject string"), [("a", ["apple"])], bits=8).count() == 0


def test_factorisation_is_one(spark):
    """The divergence falls in every round, rows of H sum to one, terms stand in several components, and W H comes near X."""
    rows, truth = _docs(400, 9)
    df = spark.createDataFrame(rows, "id long, texts array<string>, share string")
    labels = spark.createDataFrame([(i, s) for i in range(80) for s in truth[i]], "id long, subject string")
    matrix = term_matrix(df, "id", "texts", 12)
    factor = subject_factor(matrix, "id", labels, [(k, []) for k in AREAS], 12, 4, least_fall=1e-3)
    falls = factor.divergences
    assert len(falls) > 4 and all(a > b for a, b in zip(falls, falls[1:], strict=False))
    assert np.allclose(factor.h.sum(axis=0), 1, atol=1e-4) and factor.h.shape[1] == 7
    stock = [columns([w], 12)[0][0] for w in STOCK]
    assert np.mean((factor.dense()[stock] > 1e-4).sum(axis=1)) > 1.5
    got = matrix.toPandas()
    cols = np.concatenate([np.array(c) for c in got["cols"]])
    vals = np.concatenate([np.array(v, dtype=float) for v in got["vals"]])
    owner = np.repeat(np.arange(len(got)), [len(c) for c in got["cols"]])
    w, _, fit = mixtures(cols, vals, owner, len(got), factor.dense(), 50)
    assert abs(w.sum() - vals.sum()) < 0.01 * vals.sum() and abs(fit.sum() / vals.sum() - 1) < 0.5


def test_parts():
    assert terms(["신장질환의"]) == {"신장": 0.25, "장질": 0.25, "질환": 0.25, "환의": 0.25}
    assert terms(["Apple 3 apple"]) == {"apple": 2.0}
    h = np.array([[0.5, 0], [0.5, 0.25], [0, 0.75]], np.float32)
    w, _, _ = mixtures(np.array([0, 1, 2]), np.array([4.0, 5.0, 3.0]), np.zeros(3, int), 1, h, 200)
    assert np.allclose(w, [[8, 4]], atol=1e-3)  # X is just W H
    assert np.allclose(memberships(np.array([[6.0, 2.0, 90.0], [6.0, 0.5, 1.0], [0.5, 0.1, 3.0]]), np.array([98.0, 7.5, 3.6]), 2), [[0.75, 0.25], [1, 0], [0, 0]])
