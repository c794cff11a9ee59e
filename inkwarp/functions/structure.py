"""Paragraphs, headings, sentences and section paths of Markdown text, as arrays on the document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarp.functions.offsets import find_all, let, settle, split_spans

PARAGRAPHS = "array<struct<start:int,end:int,kind:string,heading:string,heading_level:int,sentences:array<struct<start:int,end:int,value:string>>,paragraph:int,section_heading:string,bodies:int>>"

# Patterns of the structure.
BLANK_LINES = "(?U)\\n\\s*\\n"
HEADING = "(?dU)^[ \\t]*(#{1,6})[ \\t]+(.+?)\\s*$"
SENTENCE = "(?d)[^.!?\\n]+(?:[.!?]+(?:\\*\\*)?|$)"
COMMENT = "(?s)<!--.*?-->"
EDGES = "(?U)^\\s+|\\s+\\z"
FENCE = "(?dms)^```[^\\n]*\\n.*?^```[ \\t]*$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def with_structure(df: DataFrame, text: str, name: str = "structure") -> DataFrame:
    """``df`` with the paragraphs of a text: offsets, kind (heading or body), sentences, and section path.

    Blocks lie between blank lines; one is a heading only if it is one heading line. ``bodies`` counts the body blocks up to and
    with this one. A null text has none.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    whole = F.length(t)
    out = settle(df, __gaps=F.filter(split_spans(t, BLANK_LINES), lambda p: strip(p["value"]) != ""))
    # without blank lines before and after
    out = settle(out, __cores=F.transform("__gaps", lambda p: F.struct(p["start"].alias("at"), F.length(F.regexp_extract(p["value"], "(?U)^(\\s*\\n)", 1)).alias("lead"), F.regexp_extract(p["value"], "(?sU)^(?:\\s*\\n)?(.*\\S[^\\n]*)", 1).alias("core"))))
    # with the line feed that ends the last line
    out = settle(out, __blocks=F.transform("__cores", lambda c: F.struct((c["at"] + c["lead"]).alias("start"), F.least(c["at"] + c["lead"] + F.length(c["core"]) + 1, whole).alias("end"), c["core"].alias("core"))))
    out = settle(
        out,
        __told=F.transform(
            "__blocks",
            lambda p: F.struct(
                p["start"].alias("start"),
                p["end"].alias("end"),
                F.when(F.instr(p["core"], "\n") == 0, F.regexp_extract(strip(p["core"]), HEADING, 1)).otherwise("").alias("mark"),
                strip(p["core"]).alias("line"),
                F.filter(find_all(F.substring(t, p["start"] + 1, p["end"] - p["start"]), SENTENCE), lambda s: strip(s["value"]) != "").alias("found"),
            ),
        ),
    )

    def described(p: Column) -> Column:
        moved = F.transform(p["found"], lambda s: F.struct((s["start"] + p["start"]).alias("start"), (s["end"] + p["start"]).alias("end"), s["value"].alias("value")))
        alone = F.array(F.struct(p["start"].alias("start"), p["end"].alias("end"), p["line"].alias("value")))
        head = p["mark"] != ""
        return F.struct(
            p["start"].alias("start"),
            p["end"].alias("end"),
            F.when(head, "heading").otherwise("body").alias("kind"),
            F.when(head, F.regexp_extract(p["line"], HEADING, 2)).otherwise("").alias("heading"),
            F.length(p["mark"]).alias("heading_level"),
            F.when(F.size(p["found"]) > 0, moved).otherwise(alone).alias("sentences"),
        )

    out = settle(out, __described=F.transform("__told", described))
    zero = F.struct(F.array().cast("array<string>").alias("path"), F.lit(0).alias("bodies"), F.array().cast(PARAGRAPHS).alias("out"))

    def placed(acc: Column, p: Column) -> Column:
        path = F.when(p["kind"] == "heading", F.concat(F.slice(acc["path"], F.lit(1), F.greatest(p["heading_level"] - 1, F.lit(0))), F.array(p["heading"]))).otherwise(acc["path"])
        bodies = acc["bodies"] + (p["kind"] == "body").cast("int")
        row = F.struct(p["start"].alias("start"), p["end"].alias("end"), p["kind"].alias("kind"), p["heading"].alias("heading"), p["heading_level"].alias("heading_level"), p["sentences"].alias("sentences"), (F.size(acc["out"]) + 1).alias("paragraph"), F.array_join(path, " > ").alias("section_heading"), bodies.alias("bodies"))
        return F.struct(path.cast("array<string>").alias("path"), bodies.alias("bodies"), F.concat(acc["out"], F.array(row)).cast(PARAGRAPHS).alias("out"))

    return settle(out, **{name: F.aggregate("__described", zero, placed, lambda acc: acc["out"])}).drop("__gaps", "__cores", "__blocks", "__told", "__described")


def location(structure: Column, at: Column) -> Column:
    """Where an offset lies: paragraph, sentence, first and last flags, kind, section, distance to the document's end."""
    bodies = F.coalesce(F.try_element_at(structure, F.lit(-1))["bodies"], F.lit(0))
    none = F.lit(False)

    def placed(p: Column, sentence: Column) -> Column:
        body = p["kind"] == "body"
        return F.struct(
            F.coalesce(p["paragraph"], F.lit(0)).alias("paragraph"),
            F.when(p.isNotNull(), sentence).otherwise(0).alias("sentence_in_paragraph"),
            F.coalesce(sentence == 1, none).alias("is_paragraph_first"),
            F.coalesce(sentence == F.size(p["sentences"]), none).alias("is_paragraph_last"),
            F.coalesce(p["kind"], F.lit("unknown")).alias("paragraph_kind"),
            F.coalesce(p["section_heading"], F.lit("")).alias("section_heading"),
            F.coalesce(body & (p["bodies"] == bodies), none).alias("is_document_last"),
            F.when(body, bodies - p["bodies"] + 1).otherwise(0).alias("body_paragraphs_to_end"),
        )

    def sentence(p: Column) -> Column:
        # sentences are in order: the first that ends after the place, if it has begun there; the last one otherwise
        ended = F.size(F.filter(p["sentences"], lambda s: s["end"] <= at))
        return let(ended, lambda n: F.when(F.coalesce(F.get(p["sentences"], n)["start"] <= at, none), n + 1).otherwise(F.size(p["sentences"])))

    return let(F.try_element_at(F.filter(structure, lambda x: x["start"] <= at), F.lit(-1)), lambda p: let(sentence(p), lambda s: placed(p, s)))


def _all_lines(raw: Column, pattern: str) -> Column:
    lines = F.filter(F.split(raw, "\n", -1), lambda x: strip(x) != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(pattern))


def rhythm_kind(text: Column, p: Column) -> Column:
    """What a paragraph is to its document's rhythm: prose, or the first that holds of heading, blockquote, list, table, horizontal_rule."""
    raw = strip(F.substring(text, p["start"] + 1, p["end"] - p["start"]))
    return (
        F.when(p["kind"] == "heading", "heading")
        .when(raw.rlike("^\\s*>"), "blockquote")
        .when(_all_lines(raw, "(?U)^\\s*(?:[-+*]|\\d+[.)])\\s+"), "list")
        .when(_all_lines(raw, "(?U)^\\s*\\|.*\\|\\s*$"), "table")
        .when(raw.rlike("(?U)^\\s*(?:[-*_]\\s*){3,}$"), "horizontal_rule")
        .otherwise("prose")
    )
