"""Multinomial boosting against hand-worked gradients and a plain-loop grower."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from somnolyt.operators import boosting, models

NAMES = ["a", "b", "c"]


def table(n=300, classes=4, seed=3):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), r.integers(0, 5, n), r.random(n)])
    y = (np.digitize(x[:, 0] + 0.7 * (x[:, 1] == 2) + r.normal(size=n) * 0.3, [-0.8, 0.2, 1.0])) % classes
    return x, y


def frame(spark, x, y):
    rows = [(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "row_id long, label int, a double, b double, c double")


def plain(x, y, cuts, k_classes, rounds, step, depth, least=1):
    """The same trees by loops over rows and every cut, in floating point."""
    share = np.array([(y == k).mean() for k in range(k_classes)])
    margins = np.tile(np.log(share), (len(x), 1))
    for _ in range(rounds):
        e = np.exp(margins)
        p = e / e.sum(axis=1, keepdims=True)
        new = margins.copy()
        for k in range(k_classes):
            g = (y == k) - p[:, k]

            def down(rows, left):
                best = None
                if left and len(rows) >= 2 * least:
                    for f in range(x.shape[1]):
                        for cut in cuts[f]:
                            low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                            if min(len(low), len(high)) < least:
                                continue
                            gain = len(low) * len(high) / len(rows) * (g[low].mean() - g[high].mean()) ** 2
                            if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                                best = gain, low, high
                if best is None:
                    h = (abs(g[rows]) * (1 - abs(g[rows]))).sum()
                    new[rows, k] += step * (k_classes - 1) / k_classes * g[rows].sum() / h
                else:
                    down(best[1], left - 1)
                    down(best[2], left - 1)
            down(np.arange(len(x)), depth)
        margins = new
    return margins


def test_gradients_by_hand():
    margins = np.log(np.array([[0.5, 0.25, 0.25]]))
    assert boosting.residuals(margins, np.array([1]))[0] == pytest.approx([-0.5, 0.75, -0.25])
    m, y, d = np.array([[0.3, -1.2, 2.0]]), np.array([0]), 1e-6
    loss = lambda z: -math.log(boosting.softmax(z)[0, y[0]])
    for k in range(3):
        e = np.eye(3)[k] * d
        assert boosting.residuals(m, y)[0, k] == pytest.approx(-(loss(m + e) - loss(m - e)) / (2 * d), abs=1e-6)


@pytest.mark.parametrize("least", [1, 12])
def test_equals_plain_loops(spark, least):
    x, y = table()
    df = frame(spark, x, y)
    grown = boosting.grow(df, NAMES, max_iter=4, step=0.3, max_depth=2, least=least)
    cuts = boosting.feature_cuts(df, NAMES)
    assert cuts[1] == [0.5, 1.5, 2.5, 3.5] and len(cuts[0]) <= boosting.BINS
    want = plain(x, y, cuts, 4, 4, 0.3, 2, least)
    assert boosting._margins(grown, x) == pytest.approx(want, abs=1e-4)


def test_trees_do_not_depend_on_partitions_or_chunks(spark, monkeypatch):
    x, y = table()
    df = frame(spark, x, y)
    kw = dict(max_iter=3, max_depth=2, rate=0.7, step=0.2)
    one = boosting.grow(df.coalesce(1), NAMES, **kw)
    monkeypatch.setattr(boosting, "ROWS_A_TASK", 40)
    monkeypatch.setattr(boosting, "MAX_CELLS", 600)   # a few nodes a job
    monkeypatch.setattr(boosting, "REBASE", 1)
    assert boosting.grow(df.repartition(7), NAMES, **kw) == one
    assert boosting.grow(df, NAMES, **{**kw, "rate": 1.0}) != one


def test_draws_follow_the_rate():
    draw = np.arange(20000, dtype=np.int64) - 10000
    taken = [boosting.drawn(draw, r, 0.6) for r in range(2)]
    assert all(abs(t.mean() - 0.6) < 0.02 for t in taken) and abs((taken[0] & taken[1]).mean() - 0.36) < 0.02


def test_odd_rows(spark):
    x, y = table(120)
    df = frame(spark, x, y)
    odd = spark.createDataFrame([(900, None, 1.0, 1.0, 1.0)], df.schema)
    a, b = (boosting.grow(t, NAMES, key=["row_id"], max_iter=2) for t in (df, df.unionByName(odd)))
    assert a == b
    gaps = df.withColumn("a", F.when(F.col("row_id") % 3 > 0, F.col("a")))
    assert boosting.grow(gaps, NAMES, max_iter=2) == boosting.grow(gaps.fillna(0.0), NAMES, max_iter=2)
    flat = boosting.grow(df.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(None).cast("double")).withColumn("c", F.lit(0.0)),
                         NAMES, max_iter=2)
    assert all(len(t["feature"]) == 1 for trees in flat["rounds"] for t in trees)
    with pytest.raises(ValueError):
        boosting.grow(odd, NAMES)


def test_model_in_a_pipeline(spark, tmp_path):
    x, y = table(600)
    df = frame(spark, x, y)
    params = {"maxIter": 8, "stepSize": 0.3, "maxDepth": 2}
    model = models.fit(df.filter("row_id < 400"), NAMES, "GradientBoosting", True, params)
    test = df.filter("row_id >= 400")
    pred = models.predict(model, test)
    got = pred.orderBy("row_id").collect()
    probs = np.array([r.scores for r in got])
    assert probs.shape == (200, 4) and probs.sum(axis=1) == pytest.approx(np.ones(200))
    assert [r.prediction for r in got] == probs.argmax(axis=1).tolist()
    label = np.array([r.label for r in got])
    commonest = np.bincount(y[:400]).argmax()
    assert np.mean(label == probs.argmax(axis=1)) > np.mean(label == commonest) + 0.2
    shares = np.bincount(y[:400], minlength=4) / 400
    assert -np.log(probs[np.arange(200), label]).mean() < 0.8 * -np.log(shares[label]).mean()
    fi = models.feature_importance(model, NAMES).collect()
    assert fi[0].feature == "a" and sum(r.importance for r in fi) == pytest.approx(1.0)
    path = models.save(model, f"file://{tmp_path}/boosted")
    assert models.predict(models.load(path), test).orderBy("row_id").collect() == got
    assert models.predict(model, test.limit(0)).count() == 0
