"""Text sources and sinks: whole files, manifests, ledgers, protect lists, allow profiles, receipts."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = (
    "anchor_id string, document_id string, rule_id string, start int, end int, line int, column int, evidence string, context string, paragraph int, sentence_in_paragraph int, "
    "is_paragraph_first boolean, is_paragraph_last boolean, paragraph_kind string, section_heading string, is_document_last boolean, body_paragraphs_to_end int, shape string, "
    "review_method string, verdict string, reason string"
)
MANIFEST = "documents array<struct<id:string,path:string,role:string,include:boolean,reason:string>>"
PAIRS = "schema_version string, documents array<struct<id:string,before:string,after:string,scopes:array<string>,include:boolean>>"
EXCLUDED = "manifest에서 제외됨"


def texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole files: path, text."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def one_text(spark: SparkSession, text: str, document_id: str = "single-input") -> DataFrame:
    """A literal text as a document."""
    return spark.createDataFrame([(document_id, text)], "document_id string, text string")


def _file_uri(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def _with_texts(rows: DataFrame, root: str, columns: dict[str, str]) -> DataFrame:
    """``rows`` with the text of each path column (path: name of the text); all files below ``root`` are listed once, none by the driver's loop.

    Raises ValueError if a file is missing.
    """
    files = rows.sparkSession.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias("__uri"), F.col("value").alias("__text"))
    for path, name in columns.items():
        rows = rows.withColumn("__uri", F.concat(F.lit(root.rstrip("/") + "/"), path)).join(files, "__uri", "left").withColumnRenamed("__text", name).drop("__uri")
    lost = rows.where(" or ".join(f"{name} is null" for name in columns.values())).select(*columns).first()
    if lost:
        raise ValueError(f"manifest document not found: {', '.join(lost)}")
    return rows


def listed_documents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(included, excluded) rows of a corpus list: document_id, path, role, include, reason and whatever else they have.

    A null role is prose, a null flag includes, and a row left out without a reason gets the usual one.
    """
    told = rows.withColumn("role", F.coalesce("role", F.lit("prose"))).withColumn("include", F.coalesce("include", F.lit(True)))
    return told.where("include"), told.where("not include").withColumn("reason", F.coalesce("reason", F.lit(EXCLUDED)))


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(included, excluded) documents of a corpus manifest: document_id, path, role and text or reason.

    Paths are relative to the manifest. Raises ValueError for an empty list, a missing or repeated id, or a missing file.
    """
    root = os.path.dirname(_file_uri(path))
    listed = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.inline("documents"))
    rows = listed.select(F.trim(F.coalesce("id", F.lit(""))).alias("document_id"), F.trim(F.coalesce("path", F.lit(""))).alias("path"), "role", "include", "reason")
    faults = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("document_id") == "") | (F.col("path") == "")).alias("blank"), F.count_distinct("document_id").alias("ids")).first()
    if not faults.n:
        raise ValueError("a manifest needs documents")
    if faults.blank or faults.ids < faults.n:
        raise ValueError("manifest documents need an id of their own and a path")
    included, excluded = listed_documents(rows)
    return _with_texts(included.select("document_id", "path", "role"), root, {"path": "text"}), excluded.select("document_id", "path", "role", "reason")


def pair_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a before-and-after manifest (schema_version 0.1): document_id, scopes, before, after; include=false is left out."""
    root = os.path.dirname(_file_uri(path))
    raw = spark.read.schema(PAIRS).json(path, multiLine=True)
    if raw.where("schema_version = '0.1'").isEmpty():
        raise ValueError("manifest schema_version must be 0.1")
    rows = raw.select(F.inline("documents")).where("include is distinct from false").select(F.col("id").alias("document_id"), "scopes", F.col("before").alias("b"), F.col("after").alias("a"))
    return _with_texts(rows, root, {"b": "before", "a": "after"}).select("document_id", "scopes", "before", "after")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A review ledger in JSON lines; blank lines are skipped, a line that is no object fails the read."""
    return spark.read.schema(LEDGER).option("mode", "FAILFAST").json(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """A review ledger as JSON lines, nulls kept."""
    ledger.write.option("ignoreNullFields", "false").json(path)


def protect_list(spark: SparkSession, path: str) -> list[str]:
    from inkwarp.functions.spans import protect_values

    return protect_values(spark.read.text(path))


def allow_profile(path: str) -> dict:
    """An allow profile; the entries are checked when the rules are known."""
    with open(path, encoding="utf-8") as f:
        profile = json.load(f)
    if not isinstance(profile, dict):
        raise ValueError("an allow profile is an object")
    return profile


def receipt(summary: DataFrame, path: str | None = None) -> str:
    """A one-row summary as indented JSON, also written to ``path`` if given."""
    row = summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(2).collect()
    if len(row) != 1:
        raise ValueError("a receipt is made of one row")
    text = json.dumps(json.loads(row[0].j), ensure_ascii=False, indent=2) + "\n"
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text
