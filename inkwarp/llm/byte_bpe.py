"""Byte-level BPE over a column: class arrays, an associative scan for the cuts, cached pair merging.

Texts of an Arrow batch are joined to one array of code points and mapped to symbol classes. The cuts of the
vocabulary's pattern come from a small automaton: each symbol is a function on its states, functions compose
associatively, and their closure is a finite table, so the states before all positions are a blocked prefix
scan of table look-ups in numpy, without a regular expression and without a loop over characters. The resulting
slices are looked up in a cache of merged pieces. A piece is merged with a heap in O(n log n), so a run of a
million letters costs no more than its length.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_PIECES = 200_000

# symbols
_LETTER, _STMD, _R, _V, _L, _E, _NUM, _OTHER, _QUOTE, _SPACE, _WHITE, _BREAK = range(12)
# states: what the last code point was
_S0, _SL, _SN, _SO, _SB, _SW, _SQ, _SQR, _SQV, _SQL, _SX2, _SX3 = range(12)


def _step(state: int, sym: int) -> int:
    """State after ``sym``; SQ: a quote that starts a piece, SQR..SQL: it and r, v, l; SX2, SX3: a contraction of two, three."""
    if sym == _BREAK:
        return _S0
    if sym == _SPACE:
        return _SB
    if sym == _WHITE:
        return _SW
    if sym == _NUM:
        return _SN
    if sym == _OTHER:
        return _SO
    if sym == _QUOTE:
        return _SO if state in (_SO, _SB, _SQ) else _SQ
    if state == _SQ:
        return {_STMD: _SX2, _R: _SQR, _V: _SQV, _L: _SQL}.get(sym, _SL)
    if (state, sym) in ((_SQR, _E), (_SQV, _E), (_SQL, _L)):
        return _SX3
    return _SL


def _closure() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions the symbols generate: id of each symbol's, table of compositions, function values."""
    base = [tuple(_step(s, y) for s in range(12)) for y in range(12)]
    ids: dict[tuple, int] = {tuple(range(12)): 0}
    todo = []
    for f in base:
        if f not in ids:
            ids[f] = len(ids)
            todo.append(f)
    while todo:
        f = todo.pop()
        for g in base:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    funs = list(ids)
    table = np.array([[ids[tuple(g[x] for x in f)] for g in funs] for f in funs], dtype=np.uint16)
    return np.array([ids[f] for f in base], dtype=np.uint16), table, np.array(funs, dtype=np.uint8)


_SYMBOL_FUN, _COMPOSE, _VALUES = _closure()


def _symbols() -> np.ndarray:
    """Symbol of every code point."""
    by = np.full(0x110001, _OTHER, dtype=np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            by[c] = _LETTER
        elif k == "N":
            by[c] = _NUM
    # White_Space of the Unicode character database
    for c in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        by[c] = _WHITE
    by[0x20], by[0x27] = _SPACE, _QUOTE
    for letters, s in (("stmd", _STMD), ("r", _R), ("v", _V), ("l", _L), ("e", _E)):
        for x in letters:
            by[ord(x)] = s
    by[0x110000] = _BREAK
    return by


_tables: dict[str, object] = {}


def _symbol_table() -> np.ndarray:
    if "symbols" not in _tables:
        _tables["symbols"] = _symbols()
    return _tables["symbols"]


def scan_states(symbols: np.ndarray) -> np.ndarray:
    """The state before every position (starting from S0): an exclusive blocked scan of composed functions."""
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.uint8)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    funs = np.zeros(rows * width, dtype=np.uint16)
    funs[:n] = _SYMBOL_FUN[symbols]
    funs = funs.reshape(rows, width)
    inside = np.empty_like(funs)
    acc = np.zeros(rows, dtype=np.uint16)
    for j in range(width):
        inside[:, j] = acc
        acc = _COMPOSE[acc, funs[:, j]]
    carry = np.empty(rows, dtype=np.uint8)
    state = _S0
    for i in range(rows):
        carry[i] = state
        state = _VALUES[acc[i], state]
    return _VALUES[inside, carry[:, None]].reshape(-1)[:n]


def piece_starts(points: np.ndarray) -> np.ndarray:
    """True where a piece starts; ``points`` are code points with 0x110000 after each text."""
    sym = _symbol_table()[points]
    before = scan_states(sym)
    white = (sym == _SPACE) | (sym == _WHITE)
    kind = np.select([sym <= _E, sym == _NUM, (sym == _OTHER) | (sym == _QUOTE)], [_SL, _SN, _SO], 0)
    was = np.array([_S0, _SL, _SN, _SO, _SB, _SW, _SO, _SL, _SL, _SL, _S0, _S0], dtype=np.uint8)[before]
    starts = np.where(white, (was != _SB) & (was != _SW), (was != _SB) & (was != kind))
    # the last of several white spaces before something else stands alone or goes with what follows
    after = np.append(sym[1:], _BREAK)
    after_white = (after == _SPACE) | (after == _WHITE)
    starts |= white & ~after_white & (after != _BREAK)
    # letters that complete a contraction belong to its quote
    after_state = np.append(before[1:], _S0)
    starts &= ~((after_state == _SX2) | (after_state == _SX3))
    three = np.flatnonzero(after_state == _SX3)
    starts[three - 1] = False
    starts |= sym == _BREAK
    return starts


class ByteBpe:
    """Merges of a rank file, with a bounded cache of pieces."""

    def __init__(self, ranks_path: str = DEFAULT_RANKS, cache: int = CACHE_PIECES) -> None:
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cache: dict[str, list[int]] = {}
        self.limit = cache

    def merge(self, raw: bytes) -> list[int]:
        """Token ids of one piece: always the leftmost pair of lowest rank first."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        n = len(raw)
        if n < 2:
            return [ranks[raw]] if n else []
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def piece(self, text: str) -> list[int]:
        if (ids := self.cache.get(text)) is None:
            ids = self.merge(text.encode("utf-8"))
            if len(self.cache) >= self.limit:
                self.cache.clear()
            if len(text) <= 256:
                self.cache[text] = ids
        return ids

    def encode_batch(self, texts: list[str | None], offsets: bool = False) -> list:
        """Ids of every text, [] for null and empty; with ``offsets`` also the code point where each id's piece starts."""
        joined = "".join(t or "" for t in texts)
        sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(sizes)
        points = np.insert(raw, ends, 0x110000)
        starts = np.flatnonzero(piece_starts(points))
        breaks = ends + np.arange(len(texts))
        slot = np.searchsorted(starts, breaks)
        out, first = [], 0
        piece = self.piece
        for t, at, stop in zip(texts, (breaks - sizes).tolist(), slot.tolist(), strict=True):
            ids: list[int] = []
            where: list[int] = []
            if t:
                marks = (starts[first:stop] - at).tolist()
                marks.append(len(t))
                a = 0
                for b in marks[1:]:
                    got = piece(t[a:b])
                    ids += got
                    if offsets:
                        where += [a] * len(got)
                    a = b
            first = stop + 1
            out.append((ids, where) if offsets else ids)
        return out

    def decode(self, ids: list[int]) -> str:
        if "inverse" not in self.__dict__:
            self.inverse = {v: k for k, v in self.ranks.items()}
        return b"".join(self.inverse[i] for i in ids).decode("utf-8")


def _codec(path: str) -> ByteBpe:
    """One codec for each worker process and rank file."""
    if path not in _tables:
        _tables[path] = ByteBpe(path)
    return _tables[path]


def _chunks(s: pd.Series, most: int = 2_000_000) -> Iterator[list]:
    """Runs of texts of at most ``most`` code points, or one longer text."""
    run, size = [], 0
    for t in s:
        t = t if isinstance(t, str) else None
        if run and size + len(t or "") > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


def encode(col: Column, ranks_path: str = DEFAULT_RANKS) -> Column:
    """ARRAY<INT> of token ids; an empty or null text gives an empty array."""

    def run(s: pd.Series) -> pd.Series:
        codec = _codec(ranks_path)
        return pd.Series([ids for part in _chunks(s) for ids in codec.encode_batch(part)], index=s.index)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, ArrayType(IntegerType()))(col)


def token_count(col: Column, ranks_path: str = DEFAULT_RANKS) -> Column:
    """LONG number of tokens; 0 for empty or null text."""

    def run(s: pd.Series) -> pd.Series:
        codec = _codec(ranks_path)
        return pd.Series([len(ids) for part in _chunks(s) for ids in codec.encode_batch(part)], index=s.index, dtype="int64")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, LongType())(col)


def encode_offsets(df: DataFrame, key: str, text: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """``key``, ids and, for each id, the code point at which its piece starts."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(ranks_path)
        for b in batches:
            done = [x for part in _chunks(b["t"]) for x in codec.encode_batch(part, offsets=True)]
            yield pd.DataFrame({"k": b["k"], "ids": [x[0] for x in done], "starts": [x[1] for x in done]})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, ids array<int>, starts array<int>").withColumnRenamed("k", key)
