"""The sliced and blocked forms give the same result as the plain ones, also on hot groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codonloom.functions.numeric import upper_tail
from codonloom.learn import evaluate, neighbors
from codonloom.operators import enrich, ordering, relate, sampling, summarize


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group."""
    return spark.range(3000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("g"),
        (F.col("id") * 7919 % 101).cast("double").alias("score"))


def test_hash_rank_equals_window(skewed):
    plain = Window.partitionBy("g").orderBy(ordering.hash_order(["row_id"], 5), "row_id")
    ranked = ordering.hash_rank(skewed, ["row_id"], ["g"], seed=5, digits=2)
    wrong = ranked.withColumn("expected", F.row_number().over(plain)).filter("rank <> expected")
    assert wrong.count() == 0 and ranked.count() == 3000


def test_running_sums_equal_window(skewed):
    counts = skewed.groupBy("g", "score").agg(F.count("*").alias("n"))
    got = ordering.running_sums(counts, "score", {"upto": "n"}, ["g"], slices=16)
    plain = Window.partitionBy("g").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    wrong = got.withColumn("expected", F.sum("n").over(plain)).filter("upto <> expected")
    assert wrong.count() == 0
    totals = {r.g: r.total_upto for r in got.select("g", "total_upto").distinct().collect()}
    assert totals == {"hot": 2000, "cold": 1000}


def test_sort_spreads_equal_keys(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id")
    assert [r.k for r in ordering.sort_rows(df, "k").select("k").collect()] == [1] * 1000
    by = ordering.sort_by_degree(spark.createDataFrame([(1, "b"), (2, "c"), (2, "a")], "times int, P2_entrez string"))
    assert [tuple(r) for r in by.collect()] == [(2, "a"), (2, "c"), (1, "b")]


def test_undersample(skewed):
    kept = sampling.undersample(skewed, "g", ["row_id"], ("hot", "cold"), seed=1)
    assert {r.g: r["count"] for r in kept.groupBy("g").count().collect()} == {"hot": 1000, "cold": 1000}
    lowest = Window.partitionBy("g").orderBy(ordering.hash_order(["row_id"], 1), "row_id")
    expected = skewed.withColumn("n", F.row_number().over(lowest)).filter("n <= 1000").drop("n")
    assert kept.exceptAll(expected).count() == 0
    again = sampling.undersample(skewed.repartition(5), "g", ["row_id"], ("hot", "cold"), seed=1)
    assert again.exceptAll(kept).count() == 0


def test_small_undersample(spark):
    df = spark.createDataFrame([(i, "driver" if i < 3 else "passenger") for i in range(13)], "id bigint, y string")
    kept = sampling.undersample(df, "y", ["id"])
    assert {r.y: r["count"] for r in kept.groupBy("y").count().collect()} == {"driver": 3, "passenger": 3}


def test_folds_are_even_and_repeatable(skewed):
    folds = sampling.assign_folds(skewed, "g", ["row_id"], 7, seed=3)
    sizes = folds.groupBy("g", "fold").count().groupBy("g").agg((F.max("count") - F.min("count")).alias("gap"))
    assert max(r.gap for r in sizes.collect()) <= 1 and folds.count() == 3000
    again = sampling.assign_folds(skewed.repartition(3), "g", ["row_id"], 7, seed=3)
    assert folds.exceptAll(again).count() == 0


def test_stratified_fraction(skewed):
    part = sampling.stratified_fraction(skewed, "g", ["row_id"], 0.25, ("hot", "cold"))
    assert {r.g: r["count"] for r in part.groupBy("g").count().collect()} == {"hot": 500, "cold": 250}


def test_member_parts_keep_every_member(spark):
    pairs = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("m")).union(
        spark.createDataFrame([(2, 5), (2, 3), (2, 3)], "k int, m bigint"))
    got = summarize.member_strings(pairs, "k", "m", part_size=100).collect()
    hub = [r for r in got if r.k == 1]
    assert len(hub) == 10 and {r.times for r in hub} == {1000}
    assert sorted(int(x) for r in hub for x in r.members.split(",")) == list(range(1000))
    assert [(r.members, r.times, r.part) for r in got if r.k == 2] == [("3,5", 2, 0)]


def test_tail_against_exact_binomials():
    draw = random.Random(7)
    cases = []
    for _ in range(400):
        u = draw.randint(1, 900)
        m, n = draw.randint(0, u), draw.randint(0, u)
        cases.append((draw.randint(0, min(n, m) + 1), n, m, u))
    with np.errstate(all="ignore"):
        got = upper_tail(*np.array(cases, dtype=float).T)
    for (k, n, m, u), p in zip(cases, got):
        ways = sum(math.comb(m, i) * math.comb(u - m, n - i) for i in range(k, min(n, m) + 1))
        assert p == pytest.approx(ways / math.comb(u, n), rel=1e-9, abs=1e-13)


def test_enrichment_small_case(spark):
    # Universe of 10 genes, a set of 4, a group of 3 with 2 in the set: p = 40/120.
    sets = spark.createDataFrame(
        [("A", g) for g in (1, 2, 3, 4)] + [("B", g) for g in (5, 6, 7, 8, 9, 10)], "term string, gene bigint")
    groups = spark.createDataFrame([(1, 1), (1, 2), (1, 9), (1, 99), (2, 77)], "group bigint, gene bigint")
    got = {r.term: r for r in enrich.enrichment(groups, sets, smallest=2).filter("group = 1").collect()}
    assert (got["A"].k, got["A"].n_query, got["A"].m_term, got["A"].n_universe) == (2, 3, 4, 10)
    assert got["A"].p == pytest.approx(1 / 3)
    best = {r.group: r.term for r in enrich.best_terms(groups, enrich.enrichment(groups, sets, 2)).collect()}
    assert best == {1: "A", 2: None}


def test_adjusted_p(spark):
    df = spark.createDataFrame([(1, f"t{i}", p) for i, p in enumerate((0.01, 0.03, 0.04, 0.2))], "group int, term string, p double")
    got = [r.p_adj for r in enrich.adjust_p(df).orderBy("p").collect()]
    assert got == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])


def test_area_with_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.5), (0, 0.5), (1, 0.9)], "y int, s double")
    assert evaluate.auc(df, "y", "s", 1).first().auc == pytest.approx(0.875)


def test_area_of_reversed_score(skewed):
    df = skewed.withColumn("minus", -F.col("score"))
    forward = evaluate.auc(df, "g", "score", "hot").first().auc
    backward = evaluate.auc(df, "g", "minus", "hot").first().auc
    assert forward + backward == pytest.approx(1.0)


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([("passenger", "passenger", 0.1)], "obs string, pred string, score double")
    got = evaluate.confusion_metrics(evaluate.confusion(df, "obs", "pred")).first()
    assert got.accuracy == 1.0 and got.sensitivity is None and got.mcnemar_chi2 is None
    assert evaluate.auc(df, "obs", "score").first().auc is None


@pytest.mark.parametrize("block_rows", [10, 1000])
def test_neighbors_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 4)), rng.normal(size=(25, 4))
    train = spark.createDataFrame(
        [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)], "row_id bigint, features array<double>, label int")
    test = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "row_id bigint, features array<double>")
    got = neighbors.nearest(train, test, 3, block_rows=block_rows)
    found = {}
    for r in got.orderBy("row_id", "rank").collect():
        found.setdefault(r.row_id, []).append(r.neighbor)
    expected = np.argsort(((y[:, None, :] - x[None, :, :]) ** 2).sum(2), axis=1)[:, :3]
    assert found == {i: list(map(int, e)) for i, e in enumerate(expected)}
    assert neighbors.neighbor_scores(got, 3).count() == 25


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_broadcast(spark, skewed, how):
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("other", 3)], "k string, v int")
    spread = relate.spread_join(skewed, table, "g", "k", how)
    plain = skewed.join(table, F.col("g") == F.col("k"), how).drop("k")
    assert plain.count() == (4000 if how == "inner" else 5000) and plain.columns == spread.columns
    assert plain.exceptAll(spread).count() == 0 and spread.exceptAll(plain).count() == 0


def test_equal_rows_of_a_hot_key_are_split(spark):
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        hot = spark.range(0, 200_000, 1, 16).select(F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"))
        table = spark.createDataFrame([("hot", 1), ("7", 2)], "k string, v int")
        joined = relate.spread_join(hot, table, "g", "k", "left")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_categories_are_discovered_whole(spark):
    from codonloom.operators import reshape

    rows = spark.createDataFrame([("a", "di-methyl"), ("a", "di methyl"), ("b", None), ("b", "NA"), ("b", "-"), ("a", "di-methyl")], "k string, c string")
    names, missing = reshape.discovered(rows, "c")
    assert names == {"-": "blank", "NA": "na_2", "di methyl": "di_methyl", "di-methyl": "di_methyl_2"} and missing == "na"
    got = {r.k: r.asDict() for r in reshape.category_counts(rows, "k", "c", names, missing).collect()}
    assert got["a"]["di_methyl_2"] == 2 and got["a"]["di_methyl"] == 1 and got["b"]["na"] == got["b"]["na_2"] == got["b"]["blank"] == 1
    assert sum(sum(v for n, v in r.items() if n != "k") for r in got.values()) == 6
    assert reshape.discovered(rows.limit(0), "c") == ({}, None)
    with pytest.raises(ValueError):
        reshape.discovered(rows, "c", limit=3)
