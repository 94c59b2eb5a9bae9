"""The one-aggregation search against plain loops; balanced training folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from somnolyt.operators import models, search, split


def frame(spark, n=240, gap=1.5):
    r = np.random.default_rng(4)
    y = (r.random(n) < 0.3).astype(int)
    x = r.normal(size=(n, 4)) + gap * y[:, None] * np.array([1, 0, -1, 0.2])
    return spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))],
                                 "row_id long, label int, vector array<double>").repartition(3)


def test_equals_plain_loops(spark):
    df = frame(spark)
    got = {r["trial"]: r for r in search.linear_search(df, n_iter=12, k=4, seed=7).collect()}
    rows = split.stratified_folds(df, "label", "row_id", 4, 7).collect()
    x, y, fold = np.array([r["vector"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["fold"] for r in rows])
    for t in range(12):
        w = np.array([2 * search.drawn(7, t, p, "weight") - 1 for p in range(4)])
        z, share, test, train = x @ w, search.drawn(7, t, "share"), [], []
        for f in range(4):
            m0, m1 = (z[(fold != f) & (y == c)].mean() for c in (0, 1))
            cut = m0 + share * (m1 - m0)
            said = (z >= cut) if m1 >= m0 else (z <= cut)
            for out, part in ((test, fold == f), (train, fold != f)):
                out.append(np.mean([(said[part & (y == c)] == c).mean() for c in (0, 1)]))
        row = got[t]
        assert (row["mean_score"], row["std_score"], row["mean_train_score"]) == pytest.approx(
            (np.mean(test), np.std(test), np.mean(train)), abs=1e-9)


def test_odd_rows_take_no_part(spark):
    df = frame(spark)
    odd = spark.createDataFrame([(900, None, [0.0] * 4), (901, 1, None), (902, 0, [1.0]), (903, 2, [0.0] * 4), (904, 1, [None] * 4)],
                                "row_id long, label int, vector array<double>")
    a, b = (search.linear_search(x, n_iter=3, k=3).orderBy("trial").collect() for x in (df, df.unionByName(odd)))
    assert a == b
    with pytest.raises(ValueError):
        search.linear_search(odd.filter("label is null"))


def test_best_trials_are_ranked(spark):
    trials = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7), (3, 0.1)], "trial int, mean_score double")
    assert [(r["rank"], r["trial"]) for r in models.top_trials(trials, 3).collect()] == [(1, 1), (2, 2), (3, 0)]


def test_no_synthetic_row_derives_from_a_scored_row(spark):
    df = frame(spark, 150).select("row_id", "label", *[F.col("vector")[i].alias(f"f{i}") for i in range(4)])
    names = [f"f{i}" for i in range(4)]
    folded = split.stratified_folds(df, "label", "row_id", 3, 42)
    train = folded.filter("fold <> 0")
    got = models.training_rows(folded, 0, names, "binario", "row_id", 42)
    known = {tuple(r) for r in train.filter("label = 1").select(*names).collect()}
    made = [tuple(r) for r in got.join(train, "row_id", "left_anti").select(*names).collect()]
    lo, hi = (np.array([f(c) for c in zip(*known)]) for f in (min, max))
    assert made and all((np.array(m) >= lo - 1e-9).all() and (np.array(m) <= hi + 1e-9).all() for m in made)
    held = {r["row_id"] for r in folded.filter("fold = 0").collect()}
    assert not held & {r["row_id"] for r in got.filter("row_id < 150").collect()}
    plain = models.training_rows(folded, 0, names, "binario", "row_id", 42, "none")
    assert plain.count() == train.count()
    with pytest.raises(ValueError):
        models.training_rows(folded, 0, names, "binario", "row_id", 42, "all")
