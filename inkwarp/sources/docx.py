"""Paragraphs of word-processor files (OOXML): binary files in, one row for each paragraph out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPHS = "path string, paragraph int, text string, style string, numbered boolean, bold_runs int, bold_ratio double"
FINDINGS = ["path", "rule_id", "kind", "paragraph", "paragraphs", "evidence", "context"]


def _said(node) -> str:
    return "".join(t.text or "" for t in node.iter(W + "t"))


def document_paragraphs(payload: bytes) -> Iterator[tuple]:
    """(paragraph, text, style, numbered, bold runs, bold ratio) of the body's own paragraphs, not those in tables."""
    with zipfile.ZipFile(io.BytesIO(payload)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    n = 0
    for body in root.iter(W + "body"):
        for p in body.findall(W + "p"):
            n += 1
            text = _said(p)
            style = p.find(f"{W}pPr/{W}pStyle")
            bold = [r for r in p.findall(W + "r") if (b := r.find(f"{W}rPr/{W}b")) is not None and b.get(W + "val") not in ("0", "false", "off", "none")]
            ratio = sum(len(_said(r).strip()) for r in bold) / max(1, len(text.strip()))
            yield n, text, style.get(W + "val", "") if style is not None else "", p.find(f"{W}pPr/{W}numPr") is not None, len(bold), round(ratio, 3)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of all files below ``path`` that end in .docx."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *x) for p, c in zip(b["path"], b["content"], strict=True) for x in document_paragraphs(bytes(c))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARAGRAPHS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInPandas(run, PARAGRAPHS)


def format_findings(paragraphs: DataFrame, run: int = 3) -> DataFrame:
    """Emoji, bold body paragraphs, short headings, and runs of numbered paragraphs (:data:`FINDINGS`)."""
    text = F.coalesce("text", F.lit(""))
    size = F.length(F.regexp_replace(text, "(?U)^\\s+|\\s+\\z", ""))
    heading = F.lower("style").startswith("heading") | F.col("style").startswith("제목")
    none = F.lit(None).cast("array<int>")
    cut = F.substring(text, F.lit(1), F.lit(120))
    rows = paragraphs.withColumn("h", F.coalesce(heading, F.lit(False)))
    one = lambda kind, evidence: [F.col("path"), F.lit("KH-S10").alias("rule_id"), F.lit(kind).alias("kind"), F.col("paragraph"), none.alias("paragraphs"), evidence.alias("evidence"), cut.alias("context")]
    emoji = rows.withColumn("e", F.explode(F.regexp_extract_all(text, F.lit("([\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}])"), F.lit(1)))).select(*one("emoji", F.col("e")))
    bold = rows.where(~F.col("h") & (size >= 8) & (F.col("bold_ratio") >= 0.6)).select(*one("body-bold", F.concat(F.lit("bold_ratio="), F.col("bold_ratio").cast("string"))))
    short = rows.where(F.col("h") & size.between(1, 24)).select(*one("short-heading", F.col("style")))
    order = Window.partitionBy("path").orderBy("paragraph")
    islands = rows.withColumn("g", F.sum((~F.coalesce("numbered", F.lit(False))).cast("int")).over(order)).where("numbered")
    lists = islands.groupBy("path", "g").agg(F.array_sort(F.collect_list("paragraph")).alias("paragraphs")).where(F.size("paragraphs") >= run)
    lists = lists.select("path", F.lit("KH-S28").alias("rule_id"), F.lit("list-run").alias("kind"), F.lit(None).cast("int").alias("paragraph"), "paragraphs", F.concat(F.size("paragraphs").cast("string"), F.lit("개 연속 목록")).alias("evidence"), F.lit(None).cast("string").alias("context"))
    return emoji.unionByName(bold).unionByName(short).unionByName(lists)
