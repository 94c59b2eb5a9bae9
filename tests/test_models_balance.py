"""Balanced training, saved models, SVM map, guards, balancing properties."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from somnolyt.operators import balance, models, stats
from somnolyt.plans.matrix import fit_model_matrix, select_target


@pytest.fixture(scope="module")
def matrix(spark):
    from somnolyt.plans.preprocess import preprocess_cohort
    from somnolyt.sources.cohort import cohort
    pre = preprocess_cohort(cohort(spark, SF_SMALL), "median")
    m, params = fit_model_matrix(pre.withColumn("seen", F.lit(datetime.date(2020, 1, 1))), "binario")
    return m.cache(), params


@pytest.fixture(scope="module")
def clouds(spark):
    """Two close clouds of unequal size (ratio over 1.5) that touch each other."""
    rows = [(i, int(i % 4 == 0), [math.sin(i * 1.7) + (i % 4 == 0) * 0.4, math.cos(i * 2.3)]) for i in range(80)]
    return spark.createDataFrame(rows, "row_id long, label int, vector array<double>")


def test_dates_are_no_features(matrix):
    assert "seen" not in matrix[1].features


def test_absent_columns_are_left_out_of_the_comparison(spark):
    df = spark.createDataFrame([(1.0, "a", 1), (2.0, "b", 2)], "x double, c string, g int")
    got = stats.comparison_table(df, F.col("g"), ["x", "gone"], ["c", "missing"])
    assert {r.feature for r in got.collect()} == {"x", "c"}


def test_target_needs_a_known_mode_and_its_column(spark):
    df = spark.range(1)
    with pytest.raises((ValueError, KeyError)):
        select_target(df, "nothing")
    with pytest.raises((ValueError, KeyError)):
        select_target(df, "binario")


def test_training_rows_are_balanced_and_test_rows_are_not_synthetic(matrix):
    m, params = matrix
    grown = models.balanced(m, params.features, "binario", "patient_id")
    counts = {r.label: r["count"] for r in grown.filter("is_synthetic").groupBy("label").count().collect()}
    before = {r.label: r["count"] for r in m.groupBy("label").count().collect()}
    needs = max(before.values()) / min(before.values()) > 1.5
    assert bool(counts) == needs and grown.columns[:1] == ["patient_id"]
    fitted, pred, metrics = models.train_evaluate(m, params.features, "SVM", key="patient_id")
    assert pred.count() == models.holdout(m, "patient_id")[1].count()
    assert pred.filter("score < 0 or score > 1 or score is null").count() == 0
    assert {r.metric for r in metrics.collect()} >= {"accuracy", "roc_auc"}


def test_saved_model_scores_alone(spark, matrix, tmp_path):
    m, params = matrix
    model = models.fit(m, params.features, "RandomForest", params={"numTrees": 5, "maxDepth": 4})
    path = models.save(model, f"file://{tmp_path}/forest", params, models.metrics_table(models.predict(model, m, "patient_id")))
    back = models.load_named(f"file://{tmp_path}", ["forest"])["forest"]
    assert models.load_params(path).features == params.features
    a, b = (models.predict(x, m, "patient_id").orderBy("patient_id").select("score").collect() for x in (model, back))
    assert a == b and spark.read.parquet(f"{path}/metrics").count() > 0
    with pytest.raises(ValueError):
        models.save(None, f"file://{tmp_path}/none")


def test_degree_two_map_is_the_kernel():
    x, y, gamma = [1.0, -2.0, 0.5], [0.3, 4.0, 2.0], 1.7

    def mapped(v, g):
        expanded = []
        for i in range(len(v)):
            expanded += [v[i], *[v[j] * v[i] for j in range(i + 1)]]
        return [a * w for a, w in zip(expanded, models.degree_two_weights(len(v), g))]
    dot = sum(a * b for a, b in zip(x, y))
    assert sum(a * b for a, b in zip(mapped(x, gamma), mapped(y, gamma))) == pytest.approx((gamma * dot) ** 2)
    assert mapped(x, 1.0) != mapped(x, 2.0)


def test_balancing_gate_and_fallback(spark, clouds):
    even = clouds.filter("row_id < 40").withColumn("label", (F.col("row_id") % 2).cast("int"))
    assert balance.balance(even).filter("is_synthetic").count() == 0
    apart = spark.createDataFrame(
        [(i, int(i >= 40), [100.0 * (i >= 40) + i * 0.01]) for i in range(60)], "row_id long, label int, vector array<double>")
    with pytest.raises(balance.NoForeignNeighbours):
        balance.adasyn(apart)
    got = balance.balance(apart, "multiclase").groupBy("label").count().collect()
    assert {r["count"] for r in got} == {40}


def test_adasyn_and_tomek_properties(clouds):
    counts = {r.label: r["count"] for r in balance.adasyn(clouds).groupBy("label").count().collect()}
    assert counts[0] == 60 and abs(counts[1] - 60) <= 20
    links = balance.tomek_links(clouds).collect()
    assert links and all(r.la != r.lb for r in links) and {(r.a, r.b) for r in links} == {(r.b, r.a) for r in links}
    left = balance.remove_tomek(clouds).count()
    assert left == 80 - len({r.a for r in links})


def test_results_do_not_depend_on_partitions(clouds):
    one, many = (sorted(map(str, balance.smote(clouds.repartition(n)).collect())) for n in (1, 8))
    assert one == many
