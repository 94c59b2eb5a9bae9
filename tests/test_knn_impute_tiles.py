"""kNN imputation over tiles against comparing all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from somnolyt.operators import knn

COLS = ["a", "b", "c", "d"]


def brute(x, keys, k):
    d2, out = knn.pair_d2(x, x), x.copy()
    for i, j in zip(*np.nonzero(np.isnan(x))):
        near = [r for r in np.lexsort((keys, d2[i])) if np.isfinite(d2[i, r]) and not np.isnan(x[r, j])][:k]
        d, v = np.sqrt(d2[i, near]), x[near, j]
        if not near:
            out[i, j] = np.nanmean(x[:, j])
        else:
            out[i, j] = v[d == 0].mean() if (d == 0).any() else (v / d).sum() / (1 / d).sum()
    return out


def table(spark, x, keys):
    rows = [(int(i), *[None if np.isnan(v) else float(v) for v in r]) for i, r in zip(keys, x)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double").repartition(3)


def holes(n, share, seed):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 4)) * [10, 1, 30, 3], 2)
    x[:40] = x[0]
    x[r.random(x.shape) < share] = np.nan
    x[50:52] = np.nan
    return x, r.permutation(n)


@pytest.mark.parametrize("share", [0.03, 0.5])
@pytest.mark.parametrize("block", [60, 65536])
def test_equals_all_pairs(spark, share, block):
    x, keys = holes(500, share, 5)
    got = knn.knn_impute(table(spark, x, keys), COLS, "row_id", 5, block, block).collect()
    at = {r["row_id"]: [r[c] for c in COLS] for r in got}
    assert np.allclose([at[i] for i in keys], brute(x, keys, 5))


def test_more_sets_of_coordinates_than_boxes(spark, monkeypatch):
    monkeypatch.setattr(knn, "MAX_BOXES", 3)
    x, keys = holes(300, 0.2, 6)
    got = {r["row_id"]: [r[c] for c in COLS] for r in knn.knn_impute(table(spark, x, keys), COLS, "row_id", 3, 50, 50).collect()}
    assert np.allclose([got[i] for i in keys], brute(x, keys, 3))


def test_receivers_skip_tiles_and_leaves(spark, monkeypatch):
    """Pairs that meet grow far below receivers x donors (before: all of them)."""
    r = np.random.default_rng(7)
    x = r.uniform(size=(6000, 4)) * [100, 100, 100, 1]
    x[:300, 3] = np.nan
    asked, real = [], knn.materialize

    def counted(frame, *args):
        out = real(frame, *args)
        if "_u" in out.columns:
            asked.append(out.count())
        return out
    monkeypatch.setattr(knn, "materialize", counted)
    assert knn.knn_impute(table(spark, x, np.arange(6000)), COLS, "row_id", 3, 300, 300).filter(F.col("d").isNull()).count() == 0
    assert sum(asked) < 300 * 10    # 20 tiles
    sides, leaves, pairs, scan = knn.Sides(x[:300], x), knn.Leaves(x), [], knn.scan
    monkeypatch.setattr(knn, "scan", lambda s, b, u, rows, cols, *a: pairs.append(len(rows) * len(cols)) or scan(s, b, u, rows, cols, *a))
    best, bound = knn.Nearest(300, 3, np.arange(6000)), np.full(300, np.inf)
    for has, rows in knn._by_pattern(x[:300]):
        for part in knn._halved(x[:300], rows, 16):
            leaves.search(sides, best, bound, part, has, np.arange(300), False, 3)
    assert sum(pairs) < 0.5 * 300 * 6000
