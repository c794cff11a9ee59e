"""Bibliographic harvest: plan, pages, records, checks and sinks. A page is fetched by a function given by the caller.

The pages of a query depend on each other (a repeated or empty page ends it), so a query is one row of work and the queries run in parallel.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "array<struct<value:string,attributes:map<string,string>>>"
RECORD = (
    "struct<source:string,source_id:string,article_id:string,journal:struct<name:string,publisher:string,year:string,month:string,volume:string,issue:string>,"
    f"titles:{ENTRIES},authors:{ENTRIES},abstracts:{ENTRIES},categories:{ENTRIES},pages:struct<first:string,last:string>,doi:string,uci:string,url:string,citation_count:string,verified:string>"
)
PAGE = f"query_group string, field string, term string, page int, total int, status string, error string, payload binary, records array<{RECORD}>"
HIDDEN = b"***REDACTED***"
ENDED = ("ok", "repeated-page-stopped")

# Element names of a response.
_JOURNAL = {"name": "journal-name", "publisher": "publisher-name", "year": "pub-year", "month": "pub-mon", "volume": "volume", "issue": "issue"}
_GROUPS = {"titles": ("title-group", "article-title"), "authors": ("author-group", "author"), "abstracts": ("abstract-group", "abstract"), "categories": ("article-categories", "category")}
_SINGLE = {"doi": "doi", "uci": "uci", "url": "url", "citation_count": "citation-count", "verified": "verified"}


def _name(e) -> str:
    return e.tag.rpartition("}")[2]


def _inner(e) -> str | None:
    return " ".join(e.text.split()) or None if e is not None and e.text else None


def _below(e, name: str):
    return None if e is None else next((x for x in e if _name(x) == name), None)


def parse_records(root, source: str = "harvest", prefix: str = "KX") -> list[dict]:
    """The records of a response, whatever its namespaces; one without article data is left out."""
    out = []
    for r in root.iter():
        if _name(r) != "record" or (article := _below(r, "articleInfo")) is None:
            continue
        journal, ident = _below(r, "journalInfo"), article.attrib.get("article-id")
        row = {"source": source, "source_id": f"{prefix}:{ident}" if ident else None, "article_id": ident, "journal": {k: _inner(_below(journal, v)) for k, v in _JOURNAL.items()}}
        for k, (group, item) in _GROUPS.items():
            row[k] = [{"value": _inner(x), "attributes": dict(x.attrib)} for x in (_below(article, group) if _below(article, group) is not None else ()) if _name(x) == item and _inner(x)]
        row["pages"] = {"first": _inner(_below(article, "fpage")), "last": _inner(_below(article, "lpage"))}
        out.append(row | {k: _inner(_below(article, v)) for k, v in _SINGLE.items()})
    return out


def parse_page(payload: bytes, source: str = "harvest", prefix: str = "KX") -> tuple[list[dict], int | None]:
    """(records, total) of a response; RuntimeError if it reports an error. A total that is no number is None."""
    root = ElementTree.fromstring(payload)
    if any(_inner(e) for e in root.iter() if _name(e) in ("error", "message")):
        raise RuntimeError("the source returned an error")
    total = next((_inner(e) for e in root.iter() if _name(e) == "total"), None)
    return parse_records(root, source, prefix), int(total) if total and total.isdigit() else None


def redact(payload: bytes, secret: str) -> bytes:
    """The payload without the secret; RuntimeError if it is still there."""
    if not secret:
        return payload
    clean = payload.replace(secret.encode(), HIDDEN)
    if secret.encode() in clean:
        raise RuntimeError("the secret could not be removed")
    return clean


def fingerprint(records: list[dict]) -> str:
    return hashlib.sha256("|".join(r["article_id"] or "" for r in records).encode()).hexdigest()


def harvest_plan(spark: SparkSession, groups: list[dict], fields: list[str], selected: list[str] | None = None) -> DataFrame:
    """A row for each group, term and field; ValueError if no group is selected."""
    kept = [(i, g["id"], g["terms"]) for i, g in enumerate(groups, 1) if not selected or g["id"] in selected]
    if not kept:
        raise ValueError("no query group is selected")
    plan = spark.createDataFrame(kept, "group_no int, query_group string, terms array<string>")
    return plan.select("group_no", "query_group", F.posexplode("terms").alias("term_no", "term")).select("group_no", "query_group", (F.col("term_no") + 1).alias("term_no"), "term", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))


def planned_requests(plan: DataFrame) -> DataFrame:
    """Requests of a dry run by group."""
    return plan.groupBy("query_group").agg(F.count(F.lit(1)).alias("requests"))


def remaining_pages(plan: DataFrame, max_pages: int, log: DataFrame) -> DataFrame:
    """Planned pages that the query log does not report as done; a null page in the log counts as 0."""
    pages = plan.select("query_group", "field", "term", F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page"))
    done = log.where(F.col("status").isin(*ENDED)).select("query_group", "field", "term", F.coalesce("page", F.lit(0)).alias("page"))
    return pages.join(done, ["query_group", "field", "term", "page"], "left_anti")


def fetch_pages(pages: DataFrame, fetch: Callable[[str, str, int], bytes], secret: str = "", attempts: int = 3, delays: tuple[float, ...] = (1, 3, 9), pause: float = 0.0, source: str = "harvest", prefix: str = "KX") -> DataFrame:
    """Pages of every query in order (:data:`PAGE`): ok, repeated-page-stopped, or failed; what follows an empty, repeated or failed page is not asked for.

    ``fetch(field, term, page)`` is tried ``attempts`` times with ``delays`` between; errors are kept by their type's name only.
    """

    def asked(field: str, term: str, page: int) -> bytes:
        for n in range(attempts):
            try:
                return fetch(field, term, page)
            except Exception:
                if n + 1 == attempts:
                    raise
                time.sleep(delays[min(n, len(delays) - 1)])
        raise RuntimeError("no attempt")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows, seen = [], set()
        for x in g.sort_values("page").itertuples(index=False):
            head = (x.query_group, x.field, x.term, x.page)
            try:
                payload = asked(x.field, x.term, x.page)
                records, total = parse_page(payload, source, prefix)
            except Exception as e:
                rows.append((*head, None, "failed", type(e).__name__, None, []))
                break
            mark = fingerprint(records)
            if mark in seen:
                rows.append((*head, total, "repeated-page-stopped", None, None, []))
                break
            seen.add(mark)
            rows.append((*head, total, "ok", None, redact(payload, secret), records))
            if not records:
                break
            time.sleep(pause)
        out = pd.DataFrame(rows, columns=["query_group", "field", "term", "page", "total", "status", "error", "payload", "records"])
        return out.astype({"total": "Int32"})

    return pages.groupBy("query_group", "field", "term").applyInPandas(run, PAGE)


def write_raw(pages: DataFrame, path: str) -> None:
    """Raw responses, without the secret; refuses a folder that exists."""
    pages.where("status = 'ok'").select("query_group", "field", "term", "page", "payload").write.mode("errorifexists").parquet(path)


def write_records(records: DataFrame, log: DataFrame, folder: str) -> None:
    """Records and query log as JSON lines."""
    records.write.option("ignoreNullFields", "false").json(f"{folder}/records")
    log.write.option("ignoreNullFields", "false").json(f"{folder}/query-log")


def read_runs(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """Records of several runs (``*/records.jsonl`` or the like), with the folder's name as run_id."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(pattern).withColumn("run_id", F.element_at(F.split("_metadata.file_path", "/"), -2))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored PDF files: path, article id (from the name), whether they are PDF, size and SHA-256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    ident = F.regexp_extract(F.element_at(F.split("path", "/"), -1), "^(ART\\d+)\\.pdf$", 1)
    return files.select("path", F.nullif(ident, F.lit("")).alias("article_id"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"), F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def pdf_place(root: str, article_id: str, archive: str | None = None, file_id: str | None = None, prefix: str = "KX") -> str:
    """Where a PDF file goes, without its ending: below the archive's name, or below 'portal' for one known by a file id.

    ValueError unless just one of the two is given and all have their form.
    """
    if (archive is None) == (file_id is None):
        raise ValueError("give an archive or a file id")
    if archive is not None and not re.fullmatch(r"[a-z0-9-]+", archive):
        raise ValueError("an archive has small letters, digits and hyphens only")
    if file_id is not None and not re.fullmatch(rf"{prefix}_FI\d+", file_id):
        raise ValueError(f"a file id is {prefix}_FI and digits")
    if not re.fullmatch(r"ART\d+", article_id):
        raise ValueError("an article id is ART and digits")
    return f"{root.rstrip('/')}/{archive or 'portal'}/{article_id}"


def store_pdf(payload: bytes, place: str, **about: str) -> dict:
    """Keep a PDF file and its description beside it; RuntimeError if it is none, or if either is there already."""
    if not payload.startswith(b"%PDF-"):
        raise RuntimeError("the response is no PDF file")
    if os.path.exists(f"{place}.pdf") or os.path.exists(f"{place}.json"):
        raise RuntimeError("a stored file is not written over")
    os.makedirs(os.path.dirname(place), exist_ok=True)
    described = {**about, "article_id": os.path.basename(place), "sha256": hashlib.sha256(payload).hexdigest(), "bytes": len(payload)}
    with open(f"{place}.pdf", "xb") as f:
        f.write(payload)
    with open(f"{place}.json", "x", encoding="utf-8") as f:
        json.dump(described, f, ensure_ascii=False, indent=2)
    return described


def verified_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Stored PDF files with their descriptions: path, article_id, is_pdf, bytes, sha256, and whether the description says the same."""
    said = spark.read.schema("article_id string, sha256 string, bytes long").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path, multiLine=True)
    told = said.select(F.regexp_replace(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/"), "\\.json$", ".pdf").alias("path"), F.struct("article_id", "bytes", "sha256").alias("said"))
    files = pdf_files(spark, path)
    return files.join(told, "path", "left").withColumn("described", F.coalesce(F.col("said") == F.struct("article_id", F.col("bytes").cast("long"), "sha256"), F.lit(False))).drop("said")
