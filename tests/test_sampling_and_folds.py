from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import folds as FO
from corpusloom.operators import sampling as S


def test_allocation_examples():
    assert S.allocate({"high": 302, "med": 784, "low": 1687, "mono": 31819}, 850, take_all=("high",)) == {"high": 302, "med": 183, "low": 183, "mono": 182}
    assert S.allocate({"high": 389, "med": 2238, "low": 6908, "mono": 25906}, 850) == {"high": 213, "med": 213, "low": 212, "mono": 212}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=4, max_size=4), st.integers(0, 900), st.booleans())
def test_allocation_bounds(sizes, budget, whole):
    available = dict(zip(S.DENSITY_ORDER, sizes))
    got = S.allocate(available, budget, take_all=("high",) if whole else ())
    assert all(0 <= got[s] <= available[s] for s in available)
    assert sum(got.values()) <= budget
    if available["mono"] >= budget:
        assert sum(got.values()) == budget


def test_allocation_as_expression(spark):
    available = {"high": 20, "low": 5, "mono": 900}
    df = spark.createDataFrame(list(available.items()), "stratum string, available long")
    got = {r.stratum: r.taken for r in S.allocation(df, 100, take_all=("high",)).collect()}
    assert got == S.allocate(available, 100, take_all=("high",))


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(f"c{i}", f"v{i % 7 if i % 3 else 0}", ("mono", "low", "med", "high")[min(3, i % 9 // 2)], i % 10 != 0, "mono", 9) for i in range(600)]
    return spark.createDataFrame(rows, "comment_id string, video_id string, density string, density_eligible boolean, screen_bucket string, n_tokens int")


def test_draw(spark, pool):
    natural = S.natural_probe(pool, 50)
    enriched, strata = S.enriched_draw(pool, natural, 120)
    ids = [r.comment_id for r in natural.unionByName(enriched).collect()]
    assert len(ids) == len(set(ids)) == 170
    assert Counter(r.density for r in enriched.collect()) == {s: n for s, (_, n) in strata.items()}
    assert all(r.density_eligible for r in enriched.collect())
    by_video = Counter(r.video_id for r in enriched.where("density = 'mono'").collect())
    assert max(by_video.values()) - min(by_video.values()) <= 1  # round-robin
    retest = S.retest_draw(natural.unionByName(enriched), 30).collect()
    assert len(retest) == 30 and {r.comment_id for r in retest} <= set(ids) and min(Counter(r.density for r in retest).values()) >= 7
    batched = [S.batches(df, name, 20) for df, name in ((natural, "natural"), (enriched, "enriched"), (natural.limit(5), "retest"))]
    rows = S.manifest(*batched, pool.count(), strata).collect()
    assert {r.batch for r in rows if r["sample"] == "natural"} == {"natural_01", "natural_02", "natural_03"}
    assert {r.inclusion_prob for r in rows if r["sample"] == "natural"} == {"0.083333"}
    assert all(0 <= float(r.inclusion_prob) <= 1 for r in rows if r["sample"] == "enriched")
    assert {r.inclusion_prob for r in rows if r["sample"] == "retest"} == {""}


def test_draw_cuts_rounds_before_it_shuffles(spark, pool):
    plan = S.spread(pool, {"mono": 5}, "density")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # both windows are cut before they shuffle


def test_small_and_empty_pools(spark, pool):
    assert S.natural_probe(pool.limit(0), 5).count() == 0
    enriched, strata = S.enriched_draw(pool.limit(3), pool.limit(0), 100)
    assert enriched.count() <= 3 and sum(n for _, n in strata.values()) == enriched.count()
    assert S.spread(pool, {}, "density").count() == 0
    assert S.pilot(pool, 40, 0.5).count() == 40 and S.pilot(pool, 40).count() == 40


def test_spot_check(spark):
    rows = spark.createDataFrame([(str(i), "low" if i < 4 else "high") for i in range(54)], "id string, confidence string")
    got = S.spot_check(rows)
    assert got.where("confidence = 'low'").count() == 4 and got.count() == 4 + 6


def test_folds(spark):
    rows = spark.createDataFrame([(f"c{i}", ("pos|mono", "neg|low", "neu|high")[i % 3 if i % 5 else 0]) for i in range(310)], "comment_id string, stratum string")
    got = FO.make_folds(rows).collect()
    assert len(got) == 310
    for cell in {r.stratum for r in got}:
        own = [r for r in got if r.stratum == cell]
        assert sum(r.split == "test" for r in own) == round(len(own) * 0.15)
        sizes = Counter(r.fold for r in own if r.split == "train")
        assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    frozen = FO.nested(FO.make_folds(rows), 5)
    back = {(r.comment_id, r.split, r.fold) for r in FO.flat(frozen).collect()}
    assert back == {(r.comment_id, r.split, r.fold) for r in got}


def test_fold_reports(spark):
    rows = FO.make_folds(spark.createDataFrame([(f"c{i}", "pos|low", "low") for i in range(60)], "comment_id string, stratum string, density string"))
    counts = {r.part: r.n for r in FO.fold_counts(rows, "density", ("low",)).collect()}
    assert sum(counts.values()) == 60 and counts["test"] == 9
    thin = {r.value: (r.least, r.thin) for r in FO.thin(rows, "density", ("low", "high"), 5).collect()}
    assert thin["high"] == (0, True) and thin["low"][0] == 10


def test_order_is_the_same_everywhere(spark):
    one = spark.range(100).select(F.col("id").cast("string").alias("comment_id"))
    assert S.natural_probe(one, 10).collect() == S.natural_probe(one.repartition(7), 10).collect()
