"""Subject areas of documents by an anchored non-negative factorisation.

The document-term matrix X is factored into W H with non-negative W (documents by components) and H (components by terms): one
component for each subject and ``FREE`` further ones for what is about no subject. The subjects' rows of H are seeded by what labelled
documents and the subjects' names hold beyond the others, the free ones by a few documents each. The multiplicative updates of the
Kullback-Leibler divergence alternate: given H, each document's row of W is solved by itself; given W, H is multiplied by
W'(X / WH) and scaled to rows of sum one, until the divergence stops to fall. A document's subject mixture is its row of W.

Terms are hashed to ``2**bits`` columns, so what is broadcast and collected, the columns of H that hold anything, has a bounded size
whatever the vocabulary. Documents are tokenised once and read again in each round; W is never stored, for the divergence is
convex in it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarp.session import cut

BITS = 18
#: Components that are no subject, and the documents that seed each.
FREE = 12
SEEDS = 25
#: Updates of W in each round, and when the factor is used.
STEPS = 12
#: The rounds end when the divergence falls by less than this share of it.
LEAST_FALL = 0.08
MOST_ROUNDS = 40
#: Share of the corpus's own term rates in a seed, so that any term may enter any component.
BASE = 0.02
#: Labelled weight of a term at which it anchors a subject half as much as its rates say.
DOUBT = 2.0
#: A subject is one of a document's if it holds this share of the document's subject weight.
LEAST_SHARE = 0.22
#: A document is about no subject if its subject weight, in terms, is less than this, or than this share of all its terms.
LEAST_TERMS = 0.9
LEAST_DENSITY = 0.01
#: Documents solved at once, and columns summed at once.
_CHUNK = 500
_BLOCK_BITS = 12

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"([가-힣]+)|([぀-ヿ㐀-鿿豈-﫿]+)|([฀-໿]+)|([^가-힣぀-ヿ㐀-鿿豈-﫿฀-໿]+)")


def _word_terms(word: str) -> list[tuple[str, float]]:
    """Weighted terms of a word: itself; pairs of characters of Hangul (together 1), and of scripts without spaces."""
    if word.isascii():
        return [(word, 1.0)]
    out = []
    for m in _RUN.finditer(word):
        run = m.group()
        if m.group(4):
            out.append((run, 1.0))
            continue
        grams = [run[i : i + 2] for i in range(len(run) - 1)] or [run]
        each = 1.0 / len(grams) if m.group(1) else 0.5
        out += [(g, each) for g in grams]
    return out


@lru_cache(maxsize=200_000)
def _word_columns(word: str, bits: int) -> list[tuple[int, float]]:
    return [(xxhash.xxh32_intdigest(t) & ((1 << bits) - 1), w) for t, w in _word_terms(word)]


def _words(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


def terms(texts: list[str]) -> dict[str, float]:
    """Weighted terms of texts."""
    out: dict[str, float] = {}
    for text in texts:
        for word in _words(text):
            for t, w in _word_terms(word):
                out[t] = out.get(t, 0.0) + w
    return out


def columns(texts: list[str], bits: int) -> tuple[list[int], list[float]]:
    """Hashed columns of the terms of texts, summed and sorted."""
    by: dict[int, float] = {}
    for text in texts:
        for word in _words(text):
            for c, w in _word_columns(word, bits):
                by[c] = by.get(c, 0.0) + w
    order = sorted(by)
    return order, [by[c] for c in order]


def term_matrix(df: DataFrame, key: str, texts: str, bits: int = BITS) -> DataFrame:
    """key, cols ARRAY<INT>, vals ARRAY<FLOAT> of the array of texts of each row; nulls are skipped."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [columns([x for x in (t if t is not None else ()) if x], bits) for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "cols": [c for c, _ in done], "vals": [v for _, v in done]})

    return df.select(F.col(key).alias("k"), F.col(texts).alias("t")).mapInPandas(run, f"k {kind}, cols array<int>, vals array<float>").withColumnRenamed("k", key)


@dataclass
class Factor:
    """The columns of H that hold anything: ``h`` has a row for each of ``cols`` and a column for each component, subjects first."""

    cols: np.ndarray
    h: np.ndarray
    bits: int
    divergences: list[float]

    def dense(self) -> np.ndarray:
        out = np.zeros((1 << self.bits, self.h.shape[1]), dtype=np.float32)
        out[self.cols] = self.h
        return out


def mixtures(cols: np.ndarray, vals: np.ndarray, owner: np.ndarray, n: int, h: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """W of ``n`` documents by multiplicative updates, with the entries' rows of H and their fit WH.

    ``cols``, ``vals`` and ``owner`` (ascending) are the entries of the matrix: term, weight and document.
    """
    part = h[cols]
    k = h.shape[1]
    w = np.repeat(np.bincount(owner, weights=vals, minlength=n)[:, None] / k, k, axis=1).astype(np.float32)
    if not len(cols):
        return w, part, np.zeros(0, np.float32)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    who = owner[first]
    x = vals.astype(np.float32)
    for _ in range(steps):
        fit = np.maximum(np.einsum("ij,ij->i", part, w[owner]), 1e-30)
        w[who] *= np.add.reduceat(part * (x / fit)[:, None], first, axis=0)
    return w, part, np.maximum(np.einsum("ij,ij->i", part, w[owner]), 1e-30)


def memberships(w: np.ndarray, whole: np.ndarray, subjects: int) -> np.ndarray:
    """Each document's share in each subject; all zero for one about none."""
    weight = w[:, :subjects].sum(axis=1)
    share = w[:, :subjects] / np.maximum(weight, 1e-9)[:, None]
    share[(share < LEAST_SHARE) | ((weight < LEAST_TERMS) | (weight < LEAST_DENSITY * whole))[:, None]] = 0.0
    return share / np.maximum(share.sum(axis=1), 1e-9)[:, None]


def _chunks(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """A batch in parts, each with its entries: columns, values, and the row they belong to."""
    for at in range(0, len(b), _CHUNK):
        c = b.iloc[at : at + _CHUNK]
        sizes = np.fromiter(map(len, c["cols"]), dtype=np.int64, count=len(c))
        if sizes.sum():
            yield c, np.concatenate(c["cols"].to_list()).astype(np.int64), np.concatenate(c["vals"].to_list()).astype(np.float64), np.repeat(np.arange(len(c)), sizes)


def _rows_scaled(vals: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Entries divided by the root of their document's sum, lest one very long text shape the components."""
    return vals / np.sqrt(np.maximum(np.bincount(owner, weights=vals, minlength=n), 1e-9))[owner]


def _column_sums(rows: DataFrame, make, parts: int, bits: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Columns with any weight, their ``parts`` sums, and a sum over the documents, of ``make`` (part of a batch -> columns, weights, number).

    Each partition leaves packed blocks of columns, which are merged block by block; the driver gets at most ``2**bits`` rows of numbers.
    """
    size = 1 << bits

    def pack(at: np.ndarray, sums: np.ndarray) -> bytes:
        return np.int32(len(at)).tobytes() + at.astype(np.int32).tobytes() + sums.astype(np.float32).tobytes()

    def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = int(np.frombuffer(raw, np.int32, 1)[0])
        return np.frombuffer(raw, np.int32, n, 4), np.frombuffer(raw, np.float32, n * parts, 4 + 4 * n).reshape(n, parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, total = np.zeros((size, parts)), 0.0
        for b in batches:
            for c, cols, vals, owner in _chunks(b):
                cols, weights, number = make(c, cols, vals, owner)
                order = np.argsort(cols, kind="stable")
                cols = cols[order]
                first = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]])
                acc[cols[first]] += np.add.reduceat(weights[order], first, axis=0)
                total += number
        hit = np.flatnonzero(acc.any(axis=1))
        out = [(-1, b"", total)]
        for block in np.unique(hit >> _BLOCK_BITS):
            at = hit[hit >> _BLOCK_BITS == block]
            out.append((int(block), pack(at, acc[at]), 0.0))
        yield pd.DataFrame(out, columns=["block", "sums", "total"])

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        block = int(g["block"].iloc[0])
        if block < 0:
            return pd.DataFrame({"block": [-1], "sums": [b""], "total": [float(g["total"].sum())]})
        acc = np.zeros((1 << _BLOCK_BITS, parts))
        for raw in g["sums"]:
            at, sums = unpack(raw)
            acc[at - (block << _BLOCK_BITS)] += sums
        hit = np.flatnonzero(acc.any(axis=1))
        return pd.DataFrame({"block": [block], "sums": [pack(hit + (block << _BLOCK_BITS), acc[hit])], "total": [0.0]})

    schema = "block int, sums binary, total double"
    got = rows.mapInPandas(run, schema).groupBy("block").applyInPandas(merge, schema).collect()
    blocks = [unpack(bytes(r.sums)) for r in sorted(got, key=lambda r: r.block) if r.block >= 0]
    total = sum(r.total for r in got)
    if not blocks:
        return np.zeros(0, np.int64), np.zeros((0, parts)), total
    return np.concatenate([a for a, _ in blocks]).astype(np.int64), np.concatenate([s for _, s in blocks]).astype(np.float64), total


def seeds(matrix: DataFrame, key: str, labels: DataFrame, subjects: list[tuple[str, list[str]]], bits: int, free: int) -> Factor:
    """H before the first round. Labels of unknown subjects and null ones are ignored; a document labelled with several has a share in each."""
    codes = [c for c, _ in subjects]
    k = len(codes)
    at = {c: i for i, c in enumerate(codes)}

    def labelled(c: pd.DataFrame, cols: np.ndarray, vals: np.ndarray, owner: np.ndarray):
        m = np.zeros((len(c), k + 1))
        m[:, k] = 1.0
        for i, own in enumerate(c["own"]):
            for s in own if own is not None else ():
                m[i, at[s]] = 1.0 / len(own)
        weights = m[owner]
        weights[:, :k] *= vals[:, None]
        weights[:, k] *= _rows_scaled(vals, owner, len(c))
        return cols, weights, 0.0

    known = labels.where(F.col("subject").isin(codes) & F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("subject").alias("own"))
    cols, sums, _ = _column_sums(matrix.join(known, key, "left").select("cols", "vals", "own"), labelled, k + 1, bits)
    size = 1 << bits
    by, whole = np.zeros((size, k)), np.zeros(size)
    by[cols], whole[cols] = sums[:, :k], sums[:, k]
    rate = by / np.maximum(by.sum(axis=0), 1e-9)
    lift = np.clip((rate / np.maximum(rate.sum(axis=1), 1e-12)[:, None] - 1 / k) / max(1 - 1 / k, 1e-9), 0, 1) if k > 1 else np.ones_like(rate)
    h = np.zeros((size, k + free))
    h[:, :k] = rate * lift**2
    for c, names in subjects:
        own, weight = columns([n for n in names if n], bits)
        h[own, at[c]] += np.array(weight) * 1e-3
    base = whole / max(whole.sum(), 1e-9)
    some = matrix.where(F.size("cols") > 0).orderBy(F.xxhash64(key, F.lit(1)), key).select("cols", "vals").limit(free * SEEDS).collect()
    for i, r in enumerate(some):  # at most free * SEEDS documents, of at most 2**bits columns
        vals = np.array(r.vals, dtype=np.float64)
        np.add.at(h, (np.array(r.cols), k + i % free), vals / math.sqrt(vals.sum()))
    h /= np.maximum(h.sum(axis=0), 1e-12)
    h[:, :k] = (1 - BASE) * h[:, :k] + BASE * base[:, None]
    seen = by.sum(axis=1)
    anchored = lift.max(axis=1) * seen / (seen + DOUBT)  # what anchors a subject is kept out of the free components
    h[:, k:] = (h[:, k:] + base[:, None]) / 2 * ((1 - anchored) ** 2)[:, None]
    hit = np.flatnonzero(h.any(axis=1))
    return Factor(hit, h[hit].astype(np.float32), bits, [])


def subject_factor(matrix: DataFrame, key: str, labels: DataFrame, subjects: list[tuple[str, list[str]]], bits: int = BITS, free: int = FREE, least_fall: float = LEAST_FALL) -> Factor:
    """H of ``matrix`` with the divergence before each round."""
    now = seeds(matrix, key, labels, subjects, bits, free)
    context = matrix.sparkSession.sparkContext
    parts = now.h.shape[1]
    for _ in range(MOST_ROUNDS):
        held = context.broadcast(now)

        def updated(c: pd.DataFrame, cols: np.ndarray, vals: np.ndarray, owner: np.ndarray, held=held):
            vals = _rows_scaled(vals, owner, len(c))
            w, part, fit = mixtures(cols, vals, owner, len(c), _dense(held))
            ratio = vals / fit
            return cols, (w[owner] * part) * ratio[:, None], float((vals * np.log(np.maximum(ratio, 1e-30))).sum() + w.sum() - vals.sum())

        cols, sums, divergence = _column_sums(matrix.select("cols", "vals"), updated, parts, bits)
        held.unpersist()
        trace = [*now.divergences, divergence]
        if not len(cols) or len(trace) > 1 and trace[-2] - divergence < least_fall * trace[-2]:
            return Factor(now.cols, now.h, bits, trace)
        now = Factor(cols, (sums / np.maximum(sums.sum(axis=0), 1e-12)).astype(np.float32), bits, trace)
    return now


_kept: list[tuple[Factor, np.ndarray]] = []


def _dense(held) -> np.ndarray:
    """H of a broadcast factor, made dense once a worker."""
    if not _kept or _kept[0][0] is not held.value:
        _kept[:] = [(held.value, held.value.dense())]
    return _kept[0][1]


def subject_mixtures(matrix: DataFrame, key: str, factor: Factor, codes: list[str]) -> DataFrame:
    """key, subject_code, share: one row for each subject of a document, none for a document about no subject."""
    held = matrix.sparkSession.sparkContext.broadcast(factor)
    kind = matrix.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, cols, vals, owner in _chunks(b):
                w, _, _ = mixtures(cols, vals, owner, len(c), _dense(held))
                m = memberships(w, np.bincount(owner, weights=vals, minlength=len(c)), len(codes))
                row, kind_ = np.nonzero(m)
                if len(row):
                    yield pd.DataFrame({"k": c["k"].to_numpy()[row], "subject_code": np.array(codes, dtype=object)[kind_], "share": m[row, kind_].astype(np.float64)})

    return matrix.select(F.col(key).alias("k"), "cols", "vals").mapInPandas(run, f"k {kind}, subject_code string, share double").withColumnRenamed("k", key)


def assign_subjects(df: DataFrame, key: str, texts: str, labels: DataFrame, subjects: list[tuple[str, list[str]]], bits: int = BITS, free: int = FREE) -> DataFrame:
    """Subjects of the rows of ``df``; empty and null texts are about none. See :func:`subject_mixtures`."""
    matrix = cut(term_matrix(df, key, texts, bits))
    return subject_mixtures(matrix, key, subject_factor(matrix, key, labels, subjects, bits, free), [c for c, _ in subjects])
