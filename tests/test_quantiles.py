"""Exact quantiles equal ``percentile``; buckets are monotone; missing values."""

import random

import pytest
from pyspark.sql import functions as F

from somnolyt.operators import evaluate, profile, quantiles, split
from somnolyt.operators.quantiles import column_quantiles, even_buckets, exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def numbers(spark):
    r = random.Random(1)
    draw = [lambda: r.gauss(0, 1), lambda: float(r.randrange(3)), lambda: r.expovariate(1) ** 8, lambda: 7.0]
    rows = [(g if g < 3 else None, None if r.random() < 0.1 else draw[g]()) for g in range(4) for _ in range(1500)]
    return spark.createDataFrame(rows + [(9, None), (8, 1.0), (7, 1.0), (7, 2.0)], "g int, v double").repartition(5)


@pytest.mark.parametrize("accuracy", [10_000, 50, 20])
def test_equal_percentile(numbers, accuracy):
    got = {r.g: list(r.q) for r in exact_quantiles(numbers, ["g"], "v", PROBS, accuracy).collect()}
    want = {r.g: r.q for r in numbers.groupBy("g").agg(F.percentile("v", PROBS).alias("q")).collect() if r.q}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(list(want[g]))


def test_columns(numbers):
    both = numbers.select("v", F.lit(None).cast("double").alias("none"), (F.col("v") * 2).alias("w"))
    got = column_quantiles(both, ["v", "none", "w"], [0.5], accuracy=50)
    assert got["none"] is None and got["w"][0] == pytest.approx(2 * got["v"][0])


def test_buckets_do_not_decrease(numbers):
    b = numbers.select("v", even_buckets(numbers, "v").alias("b")).orderBy("v").collect()
    seen = [r.b for r in b if r.v is not None]
    assert seen == sorted(seen) and len(set(seen)) > 100
    assert all(r.b is None for r in b if r.v is None)


def test_missing_labels_keep_their_rows(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.when(F.col("id") % 5 != 0, F.col("id") % 2).alias("label"))
    got = split.stratified_split(df)
    assert got.count() == 100
    assert got.filter("label is null and split = 'test'").count() == 4
    folds = split.stratified_folds(df)
    assert folds.count() == 100 and {r["count"] for r in folds.filter("label is null").groupBy("fold").count().collect()} == {4}


def test_missing_scores_are_not_on_the_curve(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.3), (0, 0.1), (1, None), (None, 0.5)]
    df = spark.createDataFrame(rows, "label int, score double")
    pts = {r.threshold: (r.fpr, r.tpr) for r in evaluate.roc_curve(df).collect()}
    assert pts == {None: (0.0, 0.0), 0.9: (0.0, 0.5), 0.8: (0.5, 0.5), 0.3: (0.5, 1.0), 0.1: (1.0, 1.0)}
    assert evaluate.roc_auc(df).first().auc == 0.75
    pr = {r.threshold: (r.precision, r.recall) for r in evaluate.pr_curve(df).collect()}
    assert pr[None] == (1.0, 0.0) and pr[0.3] == (2 / 3, 1.0) and len(pr) == 5
    hist = evaluate.score_histogram(df, bins=2).collect()
    assert sum(r.n for r in hist) == 5


def test_missing_values_are_not_binned(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (None, 2.0), (2.0, 2.0)], "a double, b double")
    assert {(r.bin_x, r.bin_y): r.n for r in profile.binned_pairs(df, ["a", "b"], 2).collect()} == {(0, 0): 1, (1, 1): 1}


def test_confusion_matrix_of_classes_only_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (None, 1)], "label long, prediction long")
    got = {(r.label, r.prediction): r.n for r in evaluate.confusion_matrix(df).collect()}
    assert got == {(a, b): int((a, b) in {(0, 0), (0, 2), (1, 1)}) for a in range(3) for b in range(3)}


@pytest.mark.parametrize("accuracy", [50, 20])
def test_large_groups_are_counted_slice_by_slice(numbers, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "SPAN", 0)
    test_equal_percentile(numbers, accuracy)
    odd = numbers.select(F.lit(1).alias("g"), F.when(F.col("v") > 1, float("inf")).when(F.col("v") < -1, float("-inf")).otherwise(F.col("v")).alias("v"))
    got = exact_quantiles(odd, ["g"], "v", [0.5, 0.4], accuracy).first().q
    assert list(got) == pytest.approx(odd.agg(F.percentile("v", [0.5, 0.4])).first()[0])
    assert exact_quantiles(numbers, [], "v", [0.3], accuracy).first().q[0] == pytest.approx(numbers.agg(F.percentile("v", 0.3)).first()[0])


def test_many_groups_are_not_sent(numbers, monkeypatch):
    monkeypatch.setattr(quantiles, "MAX_SENT", 2)
    test_equal_percentile(numbers, 50)


def test_rows_are_not_shuffled_by_group(spark, numbers):
    """Between the scan and the first aggregation there is no exchange, also without broadcasts by size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exact_quantiles(numbers, ["g"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
