"""The SVM by quadratic forms against Spark's LinearSVC on the expanded map."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import ElementwiseProduct, PolynomialExpansion, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from somnolyt.operators import models, svm

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(500, 3))
    x[:, 2] = 1.0                   # its square does not vary
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 0] + 0.3 * r.normal(size=500) > 0).astype(int) + 2 * (x[:, 1] > 1)
    return spark.createDataFrame([(i, *v, int(c)) for i, (v, c) in enumerate(zip(x.tolist(), y))],
                                 "row_id long, a double, b double, c double, label int").cache()


def objective(coefficients, intercept, phi, sign, reg):
    spread = phi.std(axis=0, ddof=1)
    return np.maximum(0, 1 - sign * (phi @ coefficients + intercept)).mean() + reg / 2 * ((coefficients * spread) ** 2).sum()


def test_reaches_the_loss_of_the_expanded_map(rows):
    gamma, reg = 0.7, 0.02
    df = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows.withColumn("label", (F.col("label") % 2).cast("int")))
    own = svm.QuadraticSVM(numFeatures=3, gamma=gamma, regParam=reg, tol=1e-3).fit(df)
    i, j = svm.pairs(3)
    data = np.array(rows.orderBy("row_id").select(*NAMES, "label").collect(), float)
    x, sign = data[:, :3], np.where(data[:, 3] % 2 == 1, 1.0, -1.0)
    phi = x[:, i] * x[:, j] * svm.factors(3, gamma)
    got = svm.json.loads(own.getOrDefault("forms"))[0]
    q = np.array(got["form"])
    mine = objective(q[i, j] * np.where(i == j, 1, 2) / svm.factors(3, gamma), got["intercept"], phi, sign, reg)
    wide = ElementwiseProduct(scalingVec=Vectors.dense(models.degree_two_weights(3, gamma)), inputCol="poly", outputCol="mapped").transform(
        PolynomialExpansion(degree=2, inputCol="features", outputCol="poly").transform(df))
    theirs = LinearSVC(featuresCol="mapped", regParam=reg, tol=1e-7).fit(wide)
    # Spark's order: for each i the linear term, then x_0 x_i ... x_i x_i
    order = [k for k, w in enumerate(models.degree_two_weights(3, gamma)) if w]
    c = dict(zip([(b, a) for a in range(3) for b in range(a + 1)], theirs.coefficients.toArray()[order]))
    spark_loss = objective(np.array([c[k] for k in zip(i.tolist(), j.tolist())]), theirs.intercept, phi, sign, reg)
    assert mine <= spark_loss + 1e-3 and q[2, 2] == 0.0
    a, b = (np.array([r[0] for r in t.orderBy("row_id").select("prediction").collect()]) for t in (own.transform(df), theirs.transform(wide)))
    assert (a == b).mean() > 0.97


def test_folds_share_passes_and_equal_fits_of_their_own(rows, monkeypatch):
    df = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows.filter("label < 2").withColumn("f", F.col("row_id") % 2))
    monkeypatch.setattr(svm, "CHUNK_ROWS", 64)
    monkeypatch.setattr(svm, "ROWS_A_TASK", 90)
    passes = []
    summed = svm._summed
    monkeypatch.setattr(svm, "_summed", lambda *a: passes.append(1) or summed(*a))
    fit = svm.QuadraticSVM(numFeatures=3, gamma=0.7, C=5.0, tol=0.01)
    monkeypatch.setattr(svm, "LOOK_BACK", 2)
    together = fit.fitted(df, F.col("f"), 2)
    shared, alone = len(passes), []
    for part, model in zip((df.filter("f != 0"), df.filter("f != 1"), df), together):
        passes.clear()
        one = fit.fit(part)
        alone.append(len(passes))
        a, b = (np.array(svm.json.loads(m.getOrDefault("forms"))[0]["form"]) for m in (model, one))
        assert a == pytest.approx(b, abs=1e-6)
    assert shared == max(alone) < sum(alone)


def test_four_classes_are_fitted_in_one_run_saved_and_guarded(rows, tmp_path):
    params = {"C": 5.0, "gamma": 0.7}
    model = models.fit(rows, NAMES, "SVM", True, params)
    pred = models.predict(model, rows).orderBy("row_id").collect()
    assert {len(r.scores) for r in pred} == {4} and np.mean([r.label == r.prediction for r in pred]) > 0.6
    path = models.save(model, f"file://{tmp_path}/svm")
    assert models.predict(models.load(path), rows).orderBy("row_id").collect() == pred
    assert models.predict(model, rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        models.fit(rows, NAMES, "SVM", False, params)
    with pytest.raises(Exception):
        models.fit(rows.withColumn("a", F.when(F.col("row_id") > 0, F.col("a"))), NAMES, "SVM", True, params)
