"""Occurrences and records of every distinct value, by burst-trie counting.

The input is first reduced to one row per (kind, value, record) with a map-side combined native
aggregate, so that a value that fills a third of all rows is spread over its records. Each partition
then fills burst tries: a container holds the terms below one prefix and bursts into the next
characters when it grows. The containers leave the partition as front-coded compact tries. A table
of prefixes, bounded by ``max_routes`` times ``max_depth``, says at which prefix matching subtrees of all
workers meet; subtrees are cut to it, shuffled by prefix and merged. Only the tries are shuffled the
second time, never the rows. Where that bound leaves more than ``target`` terms below a prefix, or
where terms share more than ``max_depth`` characters, the subtree is spread by a hash of what
follows the prefix, so a merge group stays as small however many terms there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarp.session import cut

_TRIE = "kind string, route string, ends boolean, n long, shared array<int>, rest array<string>, occ array<long>, recs array<long>"


class BurstTrie:
    """Containers keyed by prefix; a container above ``burst`` terms becomes an inner node."""

    def __init__(self, burst: int, max_depth: int) -> None:
        self.burst, self.max_depth = burst, max_depth
        self.inner: set[str] = set()
        self.boxes: dict[tuple[str, bool], dict[str, list[int]]] = {}
        self.size = 0

    def place(self, term: str) -> tuple[str, bool]:
        """The container of a term: its prefix, and whether the term ends at an inner node."""
        return route_of(term, self.inner)

    def add(self, term: str, occ: int, recs: int) -> None:
        where = self.place(term)
        box = self.boxes.setdefault(where, {})
        if (hit := box.get(term)) is not None:
            hit[0] += occ
            hit[1] += recs
            return
        box[term] = [occ, recs]
        self.size += 1
        if len(box) > self.burst and not where[1] and len(where[0]) < self.max_depth:
            self.inner.add(where[0])
            for t, c in self.boxes.pop(where).items():
                self.boxes.setdefault(self.place(t), {})[t] = c

    def drain(self) -> Iterator[tuple[str, bool, dict[str, list[int]]]]:
        for (route, ends), box in self.boxes.items():
            yield route, ends, box
        self.inner, self.boxes, self.size = set(), {}, 0


def route_of(term: str, inner: set[str] | frozenset[str]) -> tuple[str, bool]:
    """The first prefix of ``term`` that is no inner node; True if the term ends before there is one."""
    k = 0
    while term[:k] in inner:
        if k == len(term):
            return term, True
        k += 1
    return term[:k], False


def pack(kind: str, route: str, ends: bool, box: dict[str, list[int]]) -> tuple:
    """A container as a front-coded sorted list."""
    terms = sorted(box)
    shared, rest, last = [], [], ""
    for t in terms:
        k, m = 0, min(len(t), len(last))
        while k < m and t[k] == last[k]:
            k += 1
        shared.append(k)
        rest.append(t[k:])
        last = t
    return kind, route, ends, len(terms), shared, rest, [box[t][0] for t in terms], [box[t][1] for t in terms]


def unpack(shared, rest, occ, recs) -> Iterator[tuple[str, int, int]]:
    """The terms of a front-coded list with their counters."""
    last = ""
    for k, r, o, n in zip(shared, rest, occ, recs, strict=True):
        last = last[:k] + r
        yield last, int(o), int(n)


def count_terms(
    rows: DataFrame,
    burst: int = 256,
    flush: int = 200_000,
    target: int = 20_000,
    max_routes: int = 4096,
    max_depth: int = 48,
) -> DataFrame:
    """Count ``rows`` (kind STRING, value STRING, record STRING, n LONG) by kind and value.

    Returns kind, value, occurrences LONG (sum of ``n``), records LONG (distinct non-null ``record``).
    Rows with a null value are left out; a null record counts as an occurrence in no record; a null ``n``
    counts as 0; an empty input gives an empty result; other columns are ignored.
    ``burst``, ``flush``, ``target`` size containers, a worker's tries and a merge group (about); none drops a term.
    """
    spark = rows.sparkSession
    pairs = (
        rows.where(F.col("value").isNotNull())
        .groupBy("kind", "value", "record")
        .agg(F.sum(F.coalesce(F.col("n"), F.lit(0))).cast("long").alias("n"))
        .select("kind", "value", F.col("record").isNotNull().cast("long").alias("r"), "n")
    )

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries: dict[str, BurstTrie] = {}

        def out() -> pd.DataFrame:
            packed = [pack(k, *x) for k, t in tries.items() for x in t.drain()]
            return pd.DataFrame(packed, columns=["kind", "route", "ends", "n", "shared", "rest", "occ", "recs"])

        for b in batches:
            g = b.groupby(["kind", "value"], sort=False)[["n", "r"]].sum()
            for (kind, term), o, r in zip(g.index, g["n"].tolist(), g["r"].tolist(), strict=True):
                tries.setdefault(kind, BurstTrie(burst, max_depth)).add(term, o, r)
            if sum(t.size for t in tries.values()) > flush:
                yield out()
        if any(t.size for t in tries.values()):
            yield out()

    local = cut(pairs.mapInPandas(fill, _TRIE))

    total = local.agg(F.sum("n")).first()[0] or 0
    limit = max(target, total // max_routes)
    inner: dict[str, set[str]] = {}
    deep: dict[tuple[str, str], int] = {}
    if total > limit:
        # at most max_routes prefixes of one length can hold more than `limit` terms
        prefixes = F.transform(F.sequence(F.lit(0), F.least(F.length("route"), F.lit(max_depth))), lambda k: F.substring("route", F.lit(1), k))
        busy = local.select("kind", "n", F.explode(prefixes).alias("p")).groupBy("kind", "p").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
        for r in busy.select("kind", "p", "n").toLocalIterator():
            if len(r.p) < max_depth:
                inner.setdefault(r.kind, set()).add(r.p)
            else:
                deep[r.kind, r.p] = -(-r.n // target)
    known = spark.sparkContext.broadcast(({k: frozenset(v) for k, v in inner.items()}, deep))
    usual = -(-limit // target)

    def regroup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes_of, deep = known.value
        for b in batches:
            packed = []
            for x in b.itertuples(index=False):
                nodes = nodes_of.get(x.kind, frozenset())
                boxes: dict[tuple[str, bool, int], dict[str, list[int]]] = {}
                for t, o, r in unpack(x.shared, x.rest, x.occ, x.recs):
                    route, ends = route_of(t, nodes)
                    parts = deep.get((x.kind, route), usual)
                    part = xxhash.xxh64_intdigest(t[len(route) :]) % parts if parts > 1 else 0
                    boxes.setdefault((route, ends, part), {})[t] = [o, r]
                packed += [(*pack(x.kind, route, ends, box), part) for (route, ends, part), box in boxes.items()]
            yield pd.DataFrame(packed, columns=["kind", "route", "ends", "n", "shared", "rest", "occ", "recs", "part"])

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        sums: dict[str, list[int]] = {}
        for x in g.itertuples(index=False):
            for t, o, r in unpack(x.shared, x.rest, x.occ, x.recs):
                c = sums.setdefault(t, [0, 0])
                c[0] += o
                c[1] += r
        kind = g["kind"].iloc[0]
        return pd.DataFrame([(kind, t, *sums[t]) for t in sorted(sums)], columns=["kind", "value", "occurrences", "records"])

    return local.mapInPandas(regroup, _TRIE + ", part int").groupBy("kind", "route", "ends", "part").applyInPandas(merge, "kind string, value string, occurrences long, records long")


def mark(counts: DataFrame, rare: F.Column, common: F.Column) -> DataFrame:
    """Add ``mark``: 'rare' where ``rare`` holds, else 'common' where ``common`` holds, else null."""
    return counts.withColumn("mark", F.when(rare, "rare").when(common, "common"))
