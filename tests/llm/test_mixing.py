import random

from inkwarp.llm.mixing import budgets, mix, plan_mix, row_hash, shares, source_key
from pyspark.sql import functions as F

SCHEMA = "id long, source string, tokens long"


def _sized(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("h", row_hash(F.col("id"), 1))


def test_shares_match_weights_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, "abc"[min(2, i % 7)], rng.randrange(1, 60)) for i in range(4000)]
    sized = _sized(spark, rows)
    targets = [("a", 2.0, 3), ("b", 1.0, 2), ("c", 7.0, 1), ("gone", 1e-9, 1)]
    plans = plan_mix(sized, targets)
    got = {r.source: r for r in shares(sized, plans).collect()}
    brute = {s: sum(t for _, x, t in rows if x == s) for s in "abc"}
    whole = sum(brute.values())
    for s, w, most in targets[:3]:
        assert abs(got[s].tokens_taken - min(whole * w / 10, brute[s] * most)) <= 30
        assert got[s].most_repeats <= most
        assert abs(got[s].actual_share - w / 10) < 0.01
    assert got["gone"].tokens_taken == 0 and got["gone"].actual_share == 0
    taken = mix(sized, plans).groupBy("id").count().collect()
    assert max(r["count"] for r in taken) <= 3


def test_scarce_source_does_not_shrink_the_mix(spark):
    rows = [(i, "big", 10) for i in range(2000)]
    targets = [("big", 1.0, 1), ("scarce", 1.0, 2)]

    def by_source(given):
        sized = _sized(spark, given)
        return {r.source: r for r in shares(sized, plan_mix(sized, targets)).collect()}

    without, with_it = by_source(rows), by_source([*rows, (9000, "scarce", 10)])
    assert without["big"].tokens_taken == 10000 and without["scarce"].tokens_short == 10000
    assert abs(with_it["big"].tokens_taken - 10000) <= 10
    assert with_it["scarce"].tokens_taken == 20 and abs(with_it["scarce"].tokens_short - 9985) < 1


def test_budget_cannot_be_filled(spark):
    assert budgets({"a": 10, "b": 100}, [("a", 1.0, 2), ("b", 1.0, 1)], 100) == {"a": (50, 20), "b": (50, 50)}


def test_nested_budgets(spark):
    sized = _sized(spark, [(i, "a", 7) for i in range(500)])
    small = {r.id for r in mix(sized, plan_mix(sized, [("a", 1.0, 1)], 700)).collect()}
    large = {r.id for r in mix(sized, plan_mix(sized, [("a", 1.0, 1)], 1400)).collect()}
    assert small < large and abs(len(small) - 100) <= 1


def test_nested_budgets_of_uneven_rows(spark):
    rng = random.Random(11)
    rows = [(i, "a", 40_000 if i == 77 else int(rng.paretovariate(1.1) * 5)) for i in range(600)]
    sized = _sized(spark, rows)
    size = dict((i, t) for i, _, t in rows)
    last: set[int] = set()
    for total in (500, 3000, 9000, 20_000, 30_000, 60_000):
        now = {r.id for r in mix(sized, plan_mix(sized, [("a", 1.0, 1)], total)).collect()}
        assert last <= now
        missed = abs(min(total, sum(size.values())) - sum(size[i] for i in now))
        assert missed <= max(size.values()) / 2
        last = now


def test_empty_and_null(spark):
    sized = _sized(spark, [(1, None, 5), (2, "a", 0)])
    plans = plan_mix(sized, [("a", 1.0, 1)])
    assert mix(sized, plans).count() == 0
    assert shares(sized, plans).first().actual_share == 0
    assert [r[0] for r in spark.createDataFrame([(" KX-Abstracts ",), ("  ",), (None,)], "s string").select(source_key(F.col("s"))).collect()] == ["kx_abstracts", None, None]
