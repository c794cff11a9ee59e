"""Queries of problem 4: records whose article an earlier record already has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarp.functions.normal import nfkc_sql
from inkwarp.llm.history_dedup import HELD, THRESHOLD, TITLE_EDITS, article_units, dedup_batches
from inkwarp.sources.tables import table


def article_key(col: Column) -> Column:
    """An article id as one string: upper case, no white space or dashes, no source prefix.

    Null for what stands for a missing id: no letters, no digits, or nothing but zeros as digits.
    """
    plain = F.regexp_replace(F.regexp_replace(F.upper(col), "[\\s\\p{Z}\\p{Pd}_]+", ""), "^.*:", "")
    digits = F.regexp_replace(plain, "[^0-9]", "")
    return F.when(digits.rlike("[1-9]") & plain.rlike("^[A-Z]"), plain)


def doi_key(col: Column) -> Column:
    """A DOI as one string: lower case, no white space, no resolver or scheme; null if it has no '10.' and suffix."""
    plain = F.regexp_replace(F.lower(col), "[\\s\\p{Z}]+", "")
    return F.nullif(F.regexp_extract(plain, "(10\\.[0-9]+/.+)$", 1), F.lit(""))


def record_keys(records: DataFrame) -> DataFrame:
    """(rec, key) of the true ids of records: article id, source id and DOI."""
    found = F.array(
        F.concat(F.lit("a:"), article_key(F.col("article_id"))),
        F.concat(F.lit("a:"), article_key(F.col("source_id"))),
        F.concat(F.lit("d:"), doi_key(F.col("doi"))),
    )
    return records.select(F.col("rec_no").cast("long").alias("rec"), F.explode(F.array_distinct(F.filter(found, lambda k: k.isNotNull()))).alias("key"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each record of an article that a smaller record has, with the smallest such record.

    The harvest's batches are added to the index one after the other, in the order of ``batch_no`` (rows without one last).
    """
    records = table(spark, folder, "records")
    numbers = [r[0] for r in records.select("batch_no").distinct().orderBy(F.col("batch_no").asc_nulls_last()).collect()]  # one for each batch
    batches = [records.where(F.col("batch_no").eqNullSafe(F.lit(n))) for n in numbers]
    found = dedup_batches(spark, [(article_units(b), record_keys(b)) for b in batches])
    return found.select(F.col("first").alias("first_rec_no"), F.col("rec").alias("rec_no"))


def brute_force_sql() -> str:
    """DuckDB form of :func:`p4_found`: every pair of records, no index; for small tables."""
    fold = lambda x: f"lower({nfkc_sql(x)})"
    tight = lambda x: f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    values = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda e: coalesce({fold('e.value')}, '')), lambda x: {tight('x')} <> '')"
    digits = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"
    dense = "[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}\\x{0e00}-\\x{0eff}\\x{1000}-\\x{109f}\\x{1780}-\\x{17ff}]"
    words = f"flatten(list_transform(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+'), lambda w: case when regexp_matches(w, '{dense}') then string_split(w, '') else [w] end))"
    article = lambda c: f"regexp_replace(regexp_replace(upper({c}), '[\\s\\p{{Z}}\\p{{Pd}}_]+', '', 'g'), '^.*:', '')"
    true_id = lambda c: f"case when regexp_matches({digits(article(c))}, '[1-9]') and regexp_matches({article(c)}, '^[A-Z]') then 'a:' || {article(c)} end"
    doi = "'d:' || nullif(regexp_extract(regexp_replace(lower(doi), '[\\s\\p{Z}]+', '', 'g'), '(10\\.[0-9]+/.+)$', 1), '')"
    return f"""with recursive r as (select rec_no as rec, list_sort(list_distinct(list_transform({values("titles")}, lambda x: {tight("x")}))) as names, {values("abstracts")} as xs, article_id, source_id, doi from records),
t as (select rec, names, 'abstract' as kind, unnest(xs) as x from r union all select rec, names, 'title', unnest(names) from r where len(xs) = 0),
w as (select *, {tight("x")} as tight, case when kind = 'title' then string_split(x, '') else {words} end as words from t),
u as (select *, case when len(words) < 2 then list_distinct(words) else list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) end as tokens from w),
c as (select a.rec as ra, b.rec as rb, a.kind, a.tight as ta, b.tight as tb, a.names as na, b.names as nb, a.tokens as pa, b.tokens as pb from u a join u b on a.rec < b.rec and a.kind = b.kind
  where len(list_filter(a.names, lambda x: len(list_filter(b.names, lambda y: {digits("x")} = {digits("y")})) > 0)) > 0),
d as (select * from c where case when kind = 'title' then levenshtein(ta, tb) <= 2 and {digits("ta")} = {digits("tb")} and ta[-1] = tb[-1]
  else len(list_filter(na, lambda x: len(list_filter(nb, lambda y: {digits("x")} = {digits("y")} and levenshtein(x, y) <= least({TITLE_EDITS}, greatest(2, greatest(length(x), length(y)) // 10)))) > 0)) > 0 end),
o as (select *, len(list_intersect(pa, pb)) as both_n from d),
near as (select ra, rb from o where both_n >= {THRESHOLD} * (len(pa) + len(pb) - both_n) and (kind = 'title' or both_n >= {HELD} * least(len(pa), len(pb)))),
k as (select rec, unnest([{true_id("article_id")}, {true_id("source_id")}, {doi}]) as key from r),
e as (select * from near union select a.rec, b.rec from k a join k b on a.key = b.key and a.rec < b.rec union select a.rec, b.rec from u a join u b on a.rec < b.rec and a.kind = b.kind and a.tight = b.tight and a.names = b.names),
both_ways as (select ra as x, rb as y from e union select rb, ra from e),
reach as (select x, y from both_ways union select reach.x, b.y from reach join both_ways b on reach.y = b.x)
select min(y) as first_rec_no, x as rec_no from reach group by x having min(y) < x"""


def queries() -> dict:
    return {"p4_found": p4_found}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": brute_force_sql()}
