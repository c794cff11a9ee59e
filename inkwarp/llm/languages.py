"""Language of documents and of their segments, by hierarchical discrimination.

A segment is a sentence, or one side of a title given in two languages. A linear support vector machine (one against the rest) first
predicts the language family from hashed character n-grams and script counts; within a family of several
languages, linear machines for each pair vote (one against one). They are trained here, by stochastic subgradients, on a
bounded sample of labelled entries; as labels may be wrong, segments whose label a fit on the other folds contradicts
are left out of the last one.

The weights are two arrays of fixed size. All n-grams of a batch are hashed and scored in numpy; no table is shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarp.functions.offsets import settle
from inkwarp.llm.sentences import sentence_units

FAMILIES = {"koreanic": ("ko",), "sinographic": ("ja", "zh"), "slavic": ("ru",), "germanic": ("de", "en"), "romance": ("es", "fr")}
#: ISO 639 codes of the languages told apart: 639-1, 639-2/T, 639-2/B, 639-3.
CODES = {"ko": "ko kor", "en": "en eng", "ja": "ja jpn", "zh": "zh zho chi cmn", "de": "de deu ger", "fr": "fr fra fre", "es": "es spa", "ru": "ru rus"}
#: Labelled entries used for training, for each language.
SAMPLE = 300
BITS = 17
EPOCHS = 3
FOLDS = 3
#: Segments of a labelled entry used for training.
SEGMENTS = 3
#: The language of a text in none of those known.
OTHER = "other"
#: A text is in no known language if less than this share of its letters is in a script that training texts are in, or if no family's score reaches this.
LEAST_SEEN = 0.5
LEAST_SCORE = -1.0
#: Below this confidence a segment takes the language of most of its document.
SURE = 0.7

_BLOCKS = ((0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x4E00, 0x9FFF), (0x0400, 0x04FF), (0x0061, 0x007A), (0x00DF, 0x017F), (0x0E00, 0x0E7F), (0x0900, 0x097F), (0x0600, 0x06FF), (0x0370, 0x03FF))
_SCRIPTS = {"hangul": "ᄀ-ᇿ가-힯", "kana": "぀-ヿ", "han": "㐀-鿿", "cyrillic": "Ѐ-ӿ", "latin": "A-Za-zÀ-ɏ"}
_NOISE = re.compile(r"[\W\d_]+")
_BRACKET = re.compile(r"[(（\[［][^()（）\[\]［］]{0,80}[)）\]］]")
_SIDES = re.compile(r"\s+[/=|:;–—·]+\s+|\s*[／＝｜]\s*")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


@lru_cache(maxsize=65536)
def script_of(c: str) -> str:
    """The script of a letter: the first word of its name."""
    return unicodedata.name(c, "").partition(" ")[0]


def plain(text: str) -> str:
    """Lower case, composed, letters only, with a space at each word's end; terms in brackets left out."""
    out = unicodedata.normalize("NFC", text)
    bare = _BRACKET.sub(" ", out)
    if not _NOISE.sub("", bare):
        bare = out
    return " " + _NOISE.sub(" ", bare.lower()).strip() + " "


def segments(text: str) -> list[tuple[int, int]]:
    """Offsets of the segments of a text: its sentences, cut where a sign between spaces may part two languages."""
    out = []
    for s, e in sentence_units(text):
        at = s
        for m in _SIDES.finditer(text, s, e):
            if m.start() > at and m.end() < e:
                out.append((at, m.start()))
                at = m.end()
        out.append((at, e))
    return out


def hashed(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each n-gram (1 to 4) of plain texts, and the text it belongs to; scripts are features too."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    room = 1 << bits
    feats, who = [], []
    mixed = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, 5):
        k = len(points) - n + 1
        if k <= 0:
            break
        mixed = mixed[:k] * np.uint64(31) + (points[n - 1 :] + np.uint64(n)) * _MULT[n - 1]
        same = owner[:k] == owner[n - 1 :]
        if n == 1:
            same = same & (points[:k] != 32)
        h = mixed ^ (mixed >> np.uint64(29))
        h = (h * _MULT[0]) >> np.uint64(64 - bits)
        feats.append(h[same].astype(np.int64))
        who.append(owner[:k][same])
    for b, (lo, hi) in enumerate(_BLOCKS):
        hit = (points >= lo) & (points <= hi)
        feats.append(np.full(int(hit.sum()), room + b, dtype=np.int64))
        who.append(owner[hit])
    return np.concatenate(feats), np.concatenate(who)


def width(bits: int) -> int:
    return (1 << bits) + len(_BLOCKS)


@dataclass
class Model:
    """Weights of the families (one column each) and of the pairs of languages within them."""

    families: list[str]
    members: dict[str, tuple[str, ...]]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray
    bits: int
    scripts: frozenset[str] = frozenset()

    def scores(self, texts: list[str]) -> np.ndarray:
        feats, who = hashed(texts, self.bits)
        order = np.argsort(who, kind="stable")
        feats, who = feats[order], who[order]
        out = np.zeros((len(texts), self.weights.shape[1]))
        count = np.bincount(who, minlength=len(texts)).astype(float)
        for a in range(0, len(feats), 400_000):
            f, w = feats[a : a + 400_000], who[a : a + 400_000]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            out[w[first]] += np.add.reduceat(self.weights[f], first, axis=0)
        return out / np.sqrt(np.maximum(count, 1.0))[:, None]

    @property
    def languages(self) -> list[str]:
        return [lang for f in self.families for lang in self.members[f]]

    def chances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Confidence in each of ``languages`` for each plain text, and whether the text is in any of them at all.

        A language's confidence is that in its family, by the margin to the best other family, times its votes within it.
        """
        scores = self.scores(texts)
        n = len(self.families)
        top = scores[:, :n]
        out = np.zeros((len(texts), len(self.languages)))
        at = 0
        for j, f in enumerate(self.families):
            names = self.members[f]
            others = np.delete(top, j, axis=1)
            sure = 1 / (1 + np.exp(-2 * (top[:, j] - others.max(axis=1)))) if n > 1 else np.ones(len(texts))
            votes = np.zeros((len(texts), len(names)))
            for k, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    p = 1 / (1 + np.exp(-3 * scores[:, n + k]))
                    votes[:, names.index(a)] += p
                    votes[:, names.index(b)] += 1 - p
            within = votes / (len(names) - 1) if len(names) > 1 else np.ones((len(texts), 1))
            out[:, at : at + len(names)] = sure[:, None] * within
            at += len(names)
        known = top.max(axis=1) >= LEAST_SCORE if n else np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            letters = t.replace(" ", "")
            known[i] = known[i] and bool(letters) and sum(script_of(c) in self.scripts for c in letters) >= LEAST_SEEN * len(letters)
        return out, known

    def predict(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """Language and confidence of each plain text; (None, 0) for one without letters, :data:`OTHER` for one in no known language."""
        if not texts or not self.families:
            return [(None, 0.0)] * len(texts)
        chances, known = self.chances(texts)
        return [_best(t, c, k, self) for t, c, k in zip(texts, chances, known, strict=True)]


def _best(text: str, chances: np.ndarray, known: bool, model: Model) -> tuple[str | None, float]:
    if not text.strip():
        return None, 0.0
    best = int(chances.argmax())
    return (model.languages[best], float(chances[best])) if known else (OTHER, float(1 - chances[best]))


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int, seed: int, lam: float = 1e-3) -> np.ndarray:
    """Weights of a linear machine: stochastic subgradients of the hinge loss with an L2 penalty, averaged over the last half."""
    rng = np.random.default_rng(seed)
    w, mean, scale = np.zeros(size), np.zeros(size), 1.0
    sides = [np.flatnonzero(y > 0), np.flatnonzero(y < 0)]
    most = max(map(len, sides))
    draws = np.concatenate([np.resize(side, most) if 0 < len(side) < most <= 4 * len(side) else np.repeat(side, min(4, most // max(1, len(side))) or 1) for side in sides])  # the smaller side up to four times
    steps, t, taken = epochs * len(draws), 0, 0
    every = max(1, steps // 64)
    for _ in range(epochs):
        for i in rng.permutation(draws):
            t += 1
            eta = 1.0 / (lam * t + 1.0)
            cols, x = rows[i]
            margin = y[i] * scale * (w[cols] @ x)
            scale *= 1 - eta * lam
            if margin < 1:
                w[cols] += eta * y[i] * x / scale
            if 2 * t >= steps and t % every == 0:
                mean += w * scale
                taken += 1
    return mean / max(1, taken)


def train(texts: list[str], labels: list[str], families: dict[str, tuple[str, ...]] = FAMILIES, bits: int = BITS, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on plain texts with labels, some of which may be wrong; languages without a text are left out of their pairs.

    Without any text the model tells no language of any.
    """
    if not texts:
        return Model([], dict(families), [], np.zeros((width(bits), 0), dtype=np.float32), bits)
    of = {lang: f for f, names in families.items() for lang in names}
    feats, who = hashed(texts, bits)
    order = np.argsort(who, kind="stable")
    feats, who = feats[order], who[order]
    cut = np.searchsorted(who, np.arange(len(texts) + 1))
    rows = []
    for i in range(len(texts)):
        c, n = np.unique(feats[cut[i] : cut[i + 1]], return_counts=True)
        rows.append((c, n / math.sqrt(max(1, n.sum()))))
    langs = np.array(labels)
    fam = np.array([of[x] for x in labels])
    names = [f for f in families if (fam == f).any()]
    pairs = [(f, a, b) for f in names for i, a in enumerate(families[f]) for b in families[f][i + 1 :]]
    size = width(bits)

    def fit(keep: np.ndarray) -> Model:
        columns = []
        at = np.flatnonzero(keep)
        for f in names:
            columns.append(_svm([rows[i] for i in at], np.where(fam[at] == f, 1.0, -1.0), size, epochs, seed))
        for f, a, b in pairs:
            own = at[(langs[at] == a) | (langs[at] == b)]
            columns.append(_svm([rows[i] for i in own], np.where(langs[own] == a, 1.0, -1.0), size, epochs, seed) if len(own) else np.zeros(size))
        return Model(names, dict(families), pairs, np.stack(columns, axis=1).astype(np.float32), bits, frozenset(Counter(map(script_of, texts[i].replace(" ", ""))).most_common(1)[0][0] for i in at if texts[i].strip()))

    usable = np.array([bool(t.strip()) for t in texts])
    agreed = usable.copy()
    fold = np.random.default_rng(seed).integers(0, FOLDS, len(texts))
    for k in range(FOLDS):
        there = np.flatnonzero((fold == k) & usable)
        for i, (lang, _) in zip(there, fit(usable & (fold != k)).predict([texts[i] for i in there]), strict=True):
            agreed[i] = lang == labels[i]
    return fit(agreed if agreed.any() else usable)


def language_code(label: Column) -> Column:
    """Two-letter code of a label in any ISO 639 form, with or without region or script; null for any other."""
    base = F.regexp_extract(F.lower(F.trim(label)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    known = F.create_map(*[F.lit(x) for two, forms in CODES.items() for form in forms.split() for x in (form, two)])
    return F.try_element_at(known, base)


def main_script(text: Column) -> Column:
    """The script most of a text's letters are in, null without any. Kana make a text Japanese, however many Han characters."""
    counts = [F.struct((F.regexp_count(text, F.lit(f"[{chars}]")) * (10 if name == "kana" else 1)).alias("n"), F.lit(name).alias("name")) for name, chars in _SCRIPTS.items()]
    most = F.array_max(F.array(*counts))
    return F.when(most["n"] > 0, most["name"])


def quotas(counts: dict[tuple[str, str], int], most: int) -> dict[tuple[str, str], int]:
    """Of ``most`` texts a language, how many come from each (script, label), by the share of the script that has the label.

    So a label that most of a script's texts have is learned from that script, and slips, few in a script of another language, stay few.
    """
    scripts: dict[str, int] = {}
    for (script, _), n in counts.items():
        scripts[script] = scripts.get(script, 0) + n
    out = {}
    for lang in {lang for _, lang in counts}:
        cells = sorted(((n / scripts[script], script, n) for (script, x), n in counts.items() if x == lang), reverse=True)
        rest, weights = most, sum(w for w, _, _ in cells)
        for w, script, n in cells:
            out[script, lang] = min(n, round(rest * w / weights))
            rest, weights = rest - out[script, lang], weights - w
    return out


def sample_labelled(entries: DataFrame, text: str, label: str, key: list[str], most: int = SAMPLE) -> list[tuple[str, str]]:
    """``most`` labelled texts of each language, or all there are: those with the least hash of ``key`` in each script (see :func:`quotas`).

    All labelled texts are counted first, so only rows below a hash threshold leave their partitions, about four times as many as are
    wanted. A wrong label is not dropped here but where the other folds contradict it (see :func:`train`).
    """
    rows = entries.select(F.col(text).alias("text"), F.col(label).alias("said"), F.xxhash64(*key).bitwiseAND(F.lit((1 << 62) - 1)).alias("h"))
    known = settle(rows, label=language_code(F.col("said")), script=main_script(F.col("text"))).drop("said").where("label is not null and script is not null")
    counts = {(r.script, r.label): r["count"] for r in known.groupBy("script", "label").count().collect()}  # a row for each pair of script and language
    wanted = quotas(counts, most)
    limits = [x for (script, lang), n in sorted(wanted.items()) for x in (F.lit(f"{script} {lang}"), F.lit(min(1 << 62, (1 << 62) * 4 * n // counts[script, lang])))]
    if not limits:
        return []
    low = F.col("h") < F.try_element_at(F.create_map(*limits), F.concat_ws(" ", "script", "label"))
    picked: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for r in known.where(low).collect():
        picked.setdefault((r.script, r.label), []).append((r.h, r.text))
    return sorted((cell[1], t) for cell, found in picked.items() for _, t in sorted(found)[: wanted[cell]])


def train_on(sample: list[tuple[str, str]], **more) -> Model:
    """Train on the segments of labelled texts."""
    texts, labels = [], []
    for label, text in sample:
        for s, e in segments(text)[:SEGMENTS]:
            texts.append(plain(text[s:e]))
            labels.append(label)
    return train(texts, labels, **more)


def label_segments(texts: list[str | None], model: Model) -> list[list[tuple[int, int, str, float]]]:
    """Segments (start, end, language, confidence) of every text; neighbours of one language are joined.

    A segment that is not surely in one language takes that of most of its text, with the confidence in that language; one without
    letters does so too and counts for nothing in the confidence of what it is joined to.
    """
    cuts = [segments(t) if t else [] for t in texts]
    flat = [plain(t[s:e]) for t, c in zip(texts, cuts, strict=True) for s, e in c]
    if not flat or not model.families:
        return [[] for _ in texts]
    chances, known = model.chances(flat)
    place = {lang: i for i, lang in enumerate(model.languages)}
    found = [_best(t, c, k, model) for t, c, k in zip(flat, chances, known, strict=True)]
    out, at = [], 0
    for c in cuts:
        span = range(at, at + len(c))
        at += len(c)
        weight: dict[str, float] = {}
        for (s, e), i in zip(c, span, strict=True):
            lang, sure = found[i]
            if lang:
                weight[lang] = weight.get(lang, 0.0) + (e - s) * sure
        most = max(sorted(weight), key=weight.__getitem__) if weight else None
        joined: list[list] = []
        for (s, e), i in zip(c, span, strict=True):
            if most is None:
                continue
            lang, sure = found[i]
            size = 0 if lang is None else e - s
            if lang is None or lang != OTHER and sure < SURE and most != OTHER:
                lang, sure = most, float(chances[i][place[most]]) if most in place else 0.0
            if joined and joined[-1][2] == lang:
                last = joined[-1]
                last[1], last[3], last[4] = e, last[3] + sure * size, last[4] + size
            else:
                joined.append([s, e, lang, sure * size, size])
        out.append([(s, e, lang, total / size if size else 0.0) for s, e, lang, total, size in joined])
    return out


def language_table(df: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """``keys`` and one row for each segment: segment INT from 1, start_pos, end_pos INT, lang STRING, confidence DOUBLE.

    Null, empty and blank texts, and texts without letters, give no row.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keys))]
    schema = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            ids = list(zip(*[b[n] for n in names], strict=True))
            for at in range(0, len(b), 2000):
                for k, found in zip(ids[at : at + 2000], label_segments(b["t"].tolist()[at : at + 2000], held.value), strict=True):
                    rows += [(*k, n, *x) for n, x in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=[*names, "segment", "start_pos", "end_pos", "lang", "confidence"])

    done = df.where(F.col(text).isNotNull()).select(*[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)], F.col(text).alias("t"))
    done = done.mapInPandas(run, f"{schema}, segment int, start_pos int, end_pos int, lang string, confidence double")
    return done.withColumnsRenamed(dict(zip(names, keys, strict=True)))
