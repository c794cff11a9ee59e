from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwarp.functions.normal import rule_form, word_form
from inkwarp.llm.term_counts import BurstTrie, count_terms, mark, pack, route_of, unpack
from pyspark.sql import functions as F

SCHEMA = "kind string, value string, record string, n long"


def brute(rows):
    occ, recs = Counter(), defaultdict(set)
    for kind, value, record, n, *_ in rows:
        if value is not None:
            occ[kind, value] += n or 0
            if record is not None:
                recs[kind, value].add(record)
            else:
                recs[kind, value]
    return {k: (occ[k], len(v)) for k, v in recs.items()}


@pytest.mark.parametrize("target,routes", [(20_000, 4096), (2, 4096), (1, 3)])
def test_counts_equal_brute_force(spark, target, routes):
    rows = [(k, f"{p}{i % m}", f"d{i % 11}", 1) for k, p, m, n in (("x", "ab", 97, 600), ("x", "abc", 5, 300), ("y", "ab", 40, 200), ("y", "", 3, 50)) for i in range(n)]
    rows += [("x", "hot", f"d{i % 7}", 1) for i in range(800)] + [("x", None, "d1", 1), ("x", "alone", None, 1), ("x", "none", "d2", None), ("x", "", "d3", 2), ("x", "긴" * 3000, "d3", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("route", F.lit(1)).repartition(5)
    got = {(r.kind, r.value): (r.occurrences, r.records) for r in count_terms(df, burst=4, flush=50, target=target, max_routes=routes).collect()}
    assert got == brute(rows)


def test_terms_with_a_long_common_prefix_are_spread(spark):
    rows = [("x", "http://a.example/long/path/" + str(i % 400), f"d{i % 11}", 1) for i in range(1200)] + [("x", "http", "d", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counted = count_terms(df, burst=4, flush=100, target=20, max_routes=8, max_depth=5)
    assert {(r.kind, r.value): (r.occurrences, r.records) for r in counted.collect()} == brute(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = counted.withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["at"] for r in placed}) > 1


def test_empty_table(spark):
    assert count_terms(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab\x00é", max_size=6), st.integers(1, 5)), max_size=60))
def test_trie_keeps_all(terms):
    trie = BurstTrie(2, 4)
    for t, n in terms:
        trie.add(t, n, 1)
    out = Counter()
    for route, ends, box in trie.drain():
        _, r, e, n, *rest = pack("k", route, ends, box)
        assert n == len(box) and (r, e) == (route, ends)
        for t, o, _ in unpack(*rest):
            assert t.startswith(route)
            out[t] += o
    want = Counter()
    for t, n in terms:
        want[t] += n
    assert out == want


def test_routes():
    assert route_of("abc", {"", "a"}) == ("ab", False)
    assert route_of("a", {"", "a"}) == ("a", True)
    assert route_of("x", set()) == ("", False)


def test_forms():
    assert [rule_form(x) for x in ("kr_a01", "KR‑A01 ", "ＫＲ - A01", "KR–A01")] == ["KR-A01"] * 4
    assert word_form("  Ｆinal\tof ｃ\n") == "final of c"


def test_mark(spark):
    df = spark.createDataFrame([(1, 9), (5, 1), (3, 3)], "a int, b int")
    assert [r.mark for r in mark(df, F.col("a") < 2, F.col("b") < 2).collect()] == ["rare", "common", None]
