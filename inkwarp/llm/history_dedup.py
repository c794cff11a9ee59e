"""Duplicates of new batches against all that was accepted, by an inverted index of rare-token prefixes.

A text unit is an abstract, or a title where a record has no abstract. Its tokens (pairs of neighbouring words, or of
characters) are sorted from rare to common. Two abstracts are near if they share half of their tokens (Jaccard) and three
quarters of the smaller set; then a token of the smaller one's first quarter stands in the larger one's first half.
So the first half of every unit is posted, one row a token, in a table bucketed by token, and a probe joins bucket with bucket:
only the batch is shuffled, once, when its postings are written. Lengths, the smaller side's quarter and the places of
the token in both sets thin the candidates before their units are read, which are bucketed by unit and not shuffled either.

Two records can only agree if some titles of theirs hold the same digits, so a posting's key is the token with the digits
of a title. A token that fills long postings nevertheless is spread over up to as many keys as there are buckets, by the
posted unit, and only the batch's probes are repeated for each.

Rarity comes from a table of ``2**SKETCH_BITS`` counters over the hashed tokens of the first batch. Its size is fixed, it
is broadcast as one array of 4 MB, and any order that all units share keeps the prefix filter exact.

Ids and the hashes of whole units are keys in one table that keeps the first record of each: exact copies, however many, become
a star of links and a single unit in the index. Links are kept; a class is a connected component of all links.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import xxhash
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarp.operators.components import components
from inkwarp.session import cut, shared_dir

SKETCH_BITS = 20
THRESHOLD = 0.5
#: Of the smaller set of tokens, the share that both texts must hold.
HELD = 0.75
TITLE_EDITS = 4
#: A key of the index is spread over further ones for each so many units of the first batch that may hold its token.
HOT = 2000
#: Rows of a batch in one bucket up to which they are hashed, so that history is not sorted; larger batches are merged.
HASHED = 500_000

_WORD = re.compile(r"[^\W_]+")
_TIGHT = re.compile(r"[\W_]+")
#: Scripts written without spaces: kana, Han, Thai, Lao, Khmer, Myanmar.
_DENSE = re.compile(r"[぀-ヿ㐀-鿿฀-໿က-႟ក-៿]+")

_UNITS = "rec long, unit long, copy string, kind string, titles array<string>, digits array<string>, words string"
_TABLES = {
    "keys": ("key", "key string, rec long"),
    "units": ("unit", "unit long, rec long, kind string, titles array<string>, words string"),
    "postings": ("token", "token long, unit long, size int, place int, held boolean, keys int, batch int"),
}


def fold(text: str | None) -> str:
    """NFKC and case-folded; empty for null."""
    return unicodedata.normalize("NFKC", text).casefold() if text else ""


def tight(text: str | None) -> str:
    """Folded, without white space, marks and signs."""
    return _TIGHT.sub("", fold(text))


def unit_words(text: str, kind: str) -> list[str]:
    """The words of a folded text, characters in dense scripts and in titles, whose neighbours make the tokens."""
    if kind == "title":
        return list(_TIGHT.sub("", text))
    words: list[str] = []
    for w in _WORD.findall(text):
        words += list(w) if _DENSE.search(w) else [w]
    return words


def unit_tokens(words: list[str], kind: str) -> np.ndarray:
    """Hashes of the distinct pairs of neighbours; of the word if there is but one."""
    pairs = {f"{kind}\0{a}\0{b}" for a, b in zip(words, words[1:], strict=False)} or {f"{kind}\0{w}" for w in words}
    return np.fromiter((xxhash.xxh64_intdigest(p) - (1 << 63) for p in pairs), dtype=np.int64, count=len(pairs))


def article_units(records: DataFrame, rec: str = "rec_no", titles: str = "titles", abstracts: str = "abstracts") -> DataFrame:
    """The text units of records; entries are structs with ``value``.

    Null or blank entries give no unit; a record without any text gives none. Returns rec, unit and copy (64 and 128 bits of what
    exact copies share), kind ('abstract' or 'title'), titles (folded, distinct, sorted), digits (of each title, distinct), words.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r, ts, xs in zip(b["rec"], b["t"], b["x"], strict=True):
                names = sorted({n for n in map(tight, ts if ts is not None else ()) if n})
                digits = sorted({"".join(c for c in n if "0" <= c <= "9") for n in names})
                texts = [(x, "abstract") for x in map(fold, xs if xs is not None else ())]
                texts = [x for x in texts if _TIGHT.sub("", x[0])] or [(n, "title") for n in names]
                seen = set()
                for x, kind in texts:
                    h = xxhash.xxh3_128_intdigest("\2".join([kind, _TIGHT.sub("", x), *names]))
                    if h not in seen:
                        seen.add(h)
                        out.append((r, (h >> 64) - (1 << 63), f"{h:032x}", kind, names, digits, " ".join(unit_words(x, kind))))
            yield pd.DataFrame(out, columns=["rec", "unit", "copy", "kind", "titles", "digits", "words"])

    def values(c: str) -> F.Column:
        return F.transform(F.filter(c, lambda e: e["value"].isNotNull()), lambda e: e["value"])

    return records.where(F.col(rec).isNotNull()).select(F.col(rec).cast("long").alias("rec"), values(titles).alias("t"), values(abstracts).alias("x")).mapInPandas(make, _UNITS)


def token_sketch(units: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many units hold a token of each hash bucket, over all units; ``2**bits`` counters."""
    room = 1 << bits

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(room, dtype=np.int64)
        for b in batches:
            for kind, words in zip(b["kind"], b["words"], strict=True):
                np.add.at(acc, unit_tokens(words.split(" "), kind) & (room - 1), 1)
        hit = np.flatnonzero(acc)
        yield pd.DataFrame({"b": hit.astype(np.int32), "n": acc[hit]})

    table = np.zeros(room, dtype=np.int32)
    got = units.select("kind", "words").mapInPandas(tally, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()  # at most 2**bits rows
    table[got["b"].to_numpy(dtype=np.int64)] = np.minimum(got["n"].to_numpy(dtype=np.int64), 2**31 - 1)
    return table


def postings(units: DataFrame, sketch: np.ndarray, threshold: float, buckets: int, hot: int = HOT) -> DataFrame:
    """The rare-token prefix of every unit, once for each digits of its titles.

    Returns token (the key), unit, size (of its set), place (of the token in the set's order), held (whether the smaller of two
    sets must be held by ``HELD``) and keys (over how many ones the token's postings are spread).
    """
    known = units.sparkSession.sparkContext.broadcast(sketch)
    mask = len(sketch) - 1

    def cut_prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            toks, keys, size = [], [], []
            for kind, words in zip(b["kind"], b["words"], strict=True):
                a = unit_tokens(words.split(" "), kind)
                n = len(a)
                often = known.value[a & mask]
                order = np.lexsort((a, often))[: n - math.ceil(threshold * n) + 1]
                toks.append(a[order])
                keys.append(np.minimum(1 + often[order] // hot, buckets).astype(np.int32))
                size.append(n)
            yield pd.DataFrame({"unit": b["unit"], "size": size, "held": b["kind"] == "abstract", "digits": b["digits"], "rare": toks, "keys": keys})

    rare = units.select("unit", "kind", "digits", "words").mapInPandas(cut_prefix, "unit long, size int, held boolean, digits array<string>, rare array<long>, keys array<int>")
    each = rare.select("unit", "size", "held", F.explode("digits").alias("d"), "rare", "keys").select("unit", "size", "held", "d", F.posexplode(F.arrays_zip("rare", "keys")).alias("place", "e"))
    token = F.shiftright(F.xxhash64("e.rare", "d"), 2) + F.pmod("unit", F.col("e.keys"))
    return each.select(token.alias("token"), "unit", "size", "place", "held", F.col("e.keys").alias("keys"))


def _digits(c: F.Column) -> F.Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _titles_agree(a: F.Column, b: F.Column, edits: int) -> F.Column:
    """Some title of each side is the same but for a few edits (at most a tenth of the longer one's length), none of them in a number."""
    most = lambda x, y: F.least(F.lit(edits), F.greatest(F.lit(2), F.floor(F.greatest(F.length(x), F.length(y)) / 10)))
    near = lambda x, y: (_digits(x) == _digits(y)) & (F.levenshtein(x, y, edits) >= 0) & (F.levenshtein(x, y, edits) <= most(x, y))
    return F.exists(a, lambda x: F.exists(b, lambda y: near(x, y)))


def _same_work(a: F.Column, b: F.Column) -> F.Column:
    """For titles alone: at most two edits, no part number or sequel mark at the end, equal digits."""
    return (F.levenshtein(a, b) <= 2) & (_digits(a) == _digits(b)) & (F.right(a, F.lit(1)) == F.right(b, F.lit(1)))


def _pairs(words: F.Column) -> F.Column:
    """The distinct pairs of neighbours, as strings."""
    w = F.split(words, " ")
    return F.array_distinct(F.when(F.size(w) < 2, w).otherwise(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda x, y: F.concat(x, F.lit(" "), y))))


def _candidates(probes: DataFrame, index: DataFrame, threshold: float, batch: int) -> DataFrame:
    """Pairs (x, y) of units whose overlap may be large enough, judged by a token that both have in their prefixes."""
    p, q = probes.alias("p"), index.alias("q")
    c = F.col
    small, large = F.least("p.size", "q.size"), F.greatest("p.size", "q.size")
    jaccard = F.ceil(F.lit(threshold / (1 + threshold)) * (small + large) - F.lit(1e-9))
    need = F.greatest(jaccard, F.when(c("p.held"), F.ceil(F.lit(HELD) * small - F.lit(1e-9))).otherwise(F.lit(0)))
    most = F.least("p.place", "q.place") + F.least(c("p.size") - c("p.place"), c("q.size") - c("q.place"))
    smaller = F.when(c("p.size") <= c("q.size"), c("p.place")).otherwise(c("q.place"))
    other = (c("q.batch") < F.lit(batch)) | (c("p.unit") > c("q.unit"))
    on = (c("p.token") == c("q.token")) & other & (small >= large * F.lit(threshold)) & (most >= need) & (smaller <= small - need)
    return p.join(q, on).select(c("p.unit").alias("x"), c("q.unit").alias("y"))


class HistoryIndex:
    """The index kept between batches, in a folder that all executors share.

    Tables: keys (of ids and whole units, each with its first record), units, postings, links and classes. The first three are
    bucketed, so history is never shuffled. ``add`` finds the links of a batch to history and within itself and accepts it;
    ``firsts`` tells the batch's records that came before, with the first one; ``classes`` tells this of all records. An index
    is opened again by its folder, with the ``buckets`` it was made with (by default two for each core). A batch whose ``add`` broke off can be added again: rows written twice change no result.
    """

    def __init__(self, spark: SparkSession, folder: str, threshold: float = THRESHOLD, title_edits: int = TITLE_EDITS, buckets: int | None = None, hot: int = HOT) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.threshold, self.title_edits, self.hot = threshold, title_edits, hot
        self._name = "inkwarp_" + hashlib.sha256(self.folder.encode()).hexdigest()[:20]
        self._sketch: np.ndarray | None = None
        self.batches = 0
        self._members: DataFrame | None = None
        self.buckets = buckets or max(8, 2 * spark.sparkContext.defaultParallelism)
        if self._exists("batches"):
            kept = spark.read.schema("batch int, buckets int").json(f"{self.folder}/batches").agg(F.max("batch"), F.max("buckets")).first()
            self.batches, self.buckets = kept[0] + 1, kept[1]
            self._sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
            rarity = spark.read.parquet(f"{self.folder}/rarity").toPandas()  # at most 2**SKETCH_BITS rows
            self._sketch[rarity["b"].to_numpy()] = rarity["n"].to_numpy()
        for name, (by, columns) in _TABLES.items():
            spark.sql(f"create table if not exists {self._name}_{name} ({columns}) using parquet clustered by ({by}) into {self.buckets} buckets location '{self.folder}/{name}'")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self._name}_{name}")

    def _append(self, name: str, df: DataFrame, **added: F.Column) -> None:
        """One file a bucket; the shuffle is that of the new rows, without the columns that are ``added`` behind it."""
        placed = df.repartition(self.buckets, _TABLES[name][0]).withColumns(added)
        placed.select(*self._table(name).columns).write.insertInto(f"{self._name}_{name}")
        self.spark.catalog.refreshTable(f"{self._name}_{name}")  # a stream's batch is written by a session of its own

    def _stage(self, name: str, df: DataFrame) -> DataFrame:
        """A table of the batch at hand, compressed and in columns, where a checkpoint would keep whole rows as they are."""
        path = f"{self.folder}/staged/{self.batches}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, units: DataFrame, keys: DataFrame) -> None:
        """Accept a batch: its units (see :func:`article_units`) and the keys (rec LONG, key STRING) of its ids.

        Rows of ``keys`` with a null are left out; an empty batch is accepted as well.
        """
        b = self.batches
        self._delete(f"{self.folder}/staged/{b - 1}")
        raw = self._stage("units", units)
        named = raw.select("rec", F.concat(F.lit("="), "copy").alias("key")).unionByName(keys.select("rec", "key").where("rec is not null and key is not null"))
        heads = named.groupBy("key").agg(F.min("rec").alias("head"), F.max("rec").alias("top"))
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            heads = heads.repartition(self.buckets, "key")  # else the join would shuffle the history's side
        old = self._table("keys").groupBy("key").agg(F.min("rec").alias("old"))
        first = self._stage("keys", heads.join(old, "key", "left"))
        repeated = first.where("top > head or old is not null").select("key", F.coalesce("old", "head").alias("b"))
        star = named.join(repeated, "key").where("rec <> b").select(F.col("rec").alias("a"), "b")
        new = first.where("old is null and key like '=%'").select(F.substring("key", 2, 40).alias("copy"), F.col("head").alias("rec"))
        fresh = raw.join(new, ["copy", "rec"])
        if self._sketch is None:
            self._sketch = token_sketch(raw)
            hit = np.flatnonzero(self._sketch)
            self.spark.createDataFrame(pd.DataFrame({"b": hit.astype(np.int32), "n": self._sketch[hit]}), "b int, n int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/rarity")
        fresh = self._stage("fresh", fresh)
        posted = postings(fresh, self._sketch, self.threshold, self.buckets, self.hot)
        # shuffled in four numbers a row
        packed = posted.select("token", "unit", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("place")).alias("sp"), (F.col("keys") * 2 + F.col("held").cast("int")).alias("kh"))
        parts = {"size": F.shiftright("sp", 32).cast("int"), "place": F.col("sp").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"), "held": F.col("kh") % 2 == 1, "keys": F.shiftright("kh", 1), "batch": F.lit(b)}
        self._together(lambda: self._append("units", fresh.drop("copy", "digits")), lambda: self._append("postings", packed, **parts))
        links = star.unionByName(self._near(b)).distinct()
        # the keys come after the units: a batch that broke off is not taken for one that history has
        self._together(lambda: links.write.mode("overwrite").parquet(f"{self.folder}/links/batch={b}"), lambda: self._append("keys", first.where("old is null").select("key", F.col("head").alias("rec"))))
        self._mark(b)
        self.batches += 1
        self._members = named.select("rec").distinct()

    def _together(self, *jobs) -> None:
        """Small jobs of one batch side by side."""
        with ThreadPoolExecutor(len(jobs)) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(job)) for job in jobs]:
                done.result()

    def _mark(self, b: int) -> None:
        """The number of the batch and of the buckets, in one small file."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batches/{b:09d}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(json.dumps({"batch": b, "buckets": self.buckets}), "utf-8"))
        out.close()

    def _near(self, b: int) -> DataFrame:
        """Verified links (a, b) of the units of a batch to those of earlier batches, and among themselves."""
        index = self._table("postings")
        mine = index.where(F.col("batch") == b)
        spread = mine.where("keys > 1").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)))
        spread = spread.withColumn("token", F.col("token") - F.pmod("unit", "keys") + F.col("s")).drop("s")
        once = mine.where("keys = 1")
        rows, keys = mine.agg(F.count(F.lit(1)), F.max("keys")).first()
        if rows <= HASHED * self.buckets:
            once = once.hint("shuffle_hash")
        found = _candidates(once, index.where("keys = 1"), self.threshold, b)
        if (keys or 1) > 1:
            found = found.unionByName(_candidates(spread, index.where("keys > 1"), self.threshold, b))
        found = found.distinct()
        units = self._table("units")

        def side(end: str, rec: str) -> DataFrame:
            return units.select(F.col("unit").alias(end), F.col("rec").alias(rec), F.col("kind").alias(f"kind_{end}"), F.col("titles").alias(f"titles_{end}"), F.col("words").alias(f"words_{end}"))

        c = F.col
        title = c("kind_x") == "title"
        work = lambda x: F.replace(c(x), F.lit(" "), F.lit(""))
        agree = F.when(title, _same_work(work("words_x"), work("words_y"))).otherwise(_titles_agree(c("titles_x"), c("titles_y"), self.title_edits))
        both = F.size(F.array_intersect("px", "py"))
        alike = (both >= F.lit(self.threshold) * (F.size("px") + F.size("py") - both)) & (title | (both >= F.lit(HELD) * F.least(F.size("px"), F.size("py"))))
        pairs = found.join(side("x", "a"), "x").join(side("y", "b"), "y").where((c("kind_x") == c("kind_y")) & agree)
        return pairs.withColumns({"px": _pairs(c("words_x")), "py": _pairs(c("words_y"))}).where(alike & (c("a") != c("b"))).select("a", "b")

    def links(self, batch: int | None = None) -> DataFrame:
        """All links (a, b), or those of one batch."""
        return self.spark.read.schema("a long, b long").parquet(f"{self.folder}/links" if batch is None else f"{self.folder}/links/batch={batch}").select("a", "b")

    def classes(self) -> DataFrame:
        """(rec, first): every record of all batches whose article came before."""
        if not self.batches:
            return self.spark.createDataFrame([], "rec long, first long")
        return components(self.links()).select(F.col("node").alias("rec"), F.col("component").alias("first"))

    def firsts(self) -> DataFrame:
        """(rec, first) of the records of the batch added last that came before.

        Classes are kept as rows (rec, first) in which later rows may lead further: the links' ends are followed until nothing
        changes, joined with each other, and every record that has another first one now, of the batch or of history, is written.
        """
        if self._members is None:
            raise ValueError("no batch was added since the index was opened")
        number = self.batches - 1
        links = self.links(number)
        known = self.spark.read.schema("rec long, first long").parquet(f"{self.folder}/classes") if self._exists("classes") else None
        ends = cut(links.select(F.explode(F.array("a", "b")).alias("rec")).distinct().withColumn("first", F.col("rec")))
        while known is not None:
            step = known.groupBy("rec").agg(F.min("first").alias("next")).withColumnRenamed("rec", "first")
            further = cut(ends.join(step, "first", "left").select("rec", F.coalesce("next", "first").alias("first"), (F.col("next") < F.col("first")).alias("moved")))
            ends = further.select("rec", "first")
            if further.where("moved").isEmpty():
                break
        root = lambda end: ends.select(F.col("rec").alias(end), F.col("first").alias(f"r{end}"))
        joined = components(links.join(root("a"), "a").join(root("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        now = cut(ends.join(joined.withColumnRenamed("node", "first"), "first", "left").select("rec", "first", F.coalesce("component", "first").alias("now")))
        rows = now.select("rec", F.col("now").alias("first")).unionByName(now.select(F.col("first").alias("rec"), F.col("now").alias("first"))).where("rec <> first").distinct()
        rows.write.mode("overwrite").parquet(f"{self.folder}/classes/batch={number}")
        return cut(now.where("rec <> now").join(self._members, "rec", "left_semi").select("rec", F.col("now").alias("first")))

    def drop(self) -> None:
        """Remove the index with its folder."""
        for name in _TABLES:
            self.spark.sql(f"drop table if exists {self._name}_{name}")
        self._delete(self.folder)


def dedup_batches(spark: SparkSession, batches: list[tuple[DataFrame, DataFrame]], **options) -> DataFrame:
    """(rec, first) of all records after the batches (units, keys) were added one after the other to a new index."""
    index = HistoryIndex(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}", **options)
    for units, keys in batches:
        index.add(units, keys)
    found = index.classes()
    index.drop()
    return found


def dedup_all(units: DataFrame, keys: DataFrame, **options) -> DataFrame:
    """First load: every record whose article came before (rec, first), by keys or by text."""
    return dedup_batches(units.sparkSession, [(units, keys)], **options)
