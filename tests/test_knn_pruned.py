"""The pruned kNN join against comparing all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from somnolyt.operators import knn
from somnolyt.operators.knn import knn_join


def brute(x, keys, groups, k, queries, exclude_self=True):
    out = {}
    for q in queries:
        same = [j for j in range(len(x)) if groups[j] == groups[q] and not (exclude_self and keys[j] == keys[q])]
        d2 = [(float(sum((a - b) ** 2 for a, b in zip(x[q], x[j]))), keys[j]) for j in same]
        out[keys[q]] = sorted(d2)[:k]
    return out


@pytest.mark.parametrize("kind", ["clusters", "spread", "copies", "tiny_group"])
@pytest.mark.parametrize("k", [1, 4])
def test_equals_all_pairs(spark, kind, k):
    r = np.random.default_rng(11)
    n = 600
    x = r.normal(size=(n, 3))
    if kind == "clusters":
        x = x / 30 + r.normal(size=(8, 3))[r.integers(0, 8, n)]
    if kind == "copies":
        x[:250] = x[0]
    x = np.round(x, 3)
    groups = [int(i % 3 == 0) for i in range(n)]
    if kind == "tiny_group":
        groups = [int(i < 2) for i in range(n)]
    keys = [7 * i + 1 for i in range(n)]
    df = spark.createDataFrame(list(zip(keys, groups, x.tolist())), "row_id long, label int, vector array<double>").repartition(3)
    got = {}
    for row in knn_join(df, df, "vector", k, by=["label"], exclude_self=True, q_block_rows=50, d_block_rows=40).collect():
        got.setdefault(row["row_id"], []).append((row["rank"], row["d2"], row["nbr"]))
    want = brute(x.tolist(), keys, groups, k, range(n))
    assert set(got) == {q for q, w in want.items() if w}
    for q, found in got.items():
        assert [i for _, _, i in sorted(found)] == [i for _, i in want[q]]
        assert np.allclose([d for _, d, _ in sorted(found)], [d for d, _ in want[q]], rtol=1e-12)


def test_queries_skip_cells_that_cannot_hold_a_neighbour(spark, monkeypatch):
    """Rows that meet grow far below queries x donor blocks."""
    r = np.random.default_rng(3)
    x = r.normal(size=(20, 4))[r.integers(0, 20, 4000)] + r.normal(size=(4000, 4)) / 50
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vector array<double>")
    met, real = [], knn.materialize

    def counted(frame, *args):
        out = real(frame, *args)
        if "_u" in out.columns:
            met.append(out.count())
        return out
    monkeypatch.setattr(knn, "materialize", counted)
    found = knn_join(df, df, "vector", 3, exclude_self=True, d_block_rows=100, q_block_rows=200)
    assert found.count() == 3 * 4000
    assert sum(met) < 0.25 * 4000 * 40


def test_gaps_and_empty_sides(spark):
    rows = [(i, [float(i % 7), None if i % 5 == 0 else 1.0 * i]) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, vector array<double>")
    assert knn_join(df, df, "vector", 2, exclude_self=True, d_block_rows=10).count() == 240
    whole = df.filter(F.col("row_id") % 5 != 0)
    assert knn_join(whole.limit(0), whole, "vector", 2, d_block_rows=10).count() == 0
    assert knn_join(whole, whole.limit(0), "vector", 2, d_block_rows=10).count() == 0


def test_queries_meet_tiles_not_cells(spark, monkeypatch):
    """Where nothing can be ruled out, a query travels once a tile of many cells."""
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(2000, 24)))], "row_id long, vector array<double>")
    met, real = [], knn.materialize

    def counted(frame, *args):
        out = real(frame, *args)
        if "_u" in out.columns:
            met.append(out.count())
        return out
    monkeypatch.setattr(knn, "materialize", counted)
    knn_join(df, df, "vector", 3, exclude_self=True, d_block_rows=50).count()
    assert sum(met) <= 2000 * (2 * spark.sparkContext.defaultParallelism + 2)  # 40 blocks of 50 donors


@pytest.mark.parametrize("gaps", [False, True])
def test_rough_distances_miss_no_neighbour(gaps):
    """Far from the origin, with ties and infinities: the same as comparing all pairs."""
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(300, 6)), 1) + 1e6
    x[5:9] = x[4]
    if gaps:
        x[r.random(x.shape) < 0.2] = np.nan
        x[7, 2] = np.inf
    keys, k = np.arange(300)[::-1].copy(), 4
    sides, best, bound = knn.Sides(x, x), knn.Nearest(300, k, keys), np.full(300, np.inf)
    for at in range(0, 300, 70):
        knn.scan(sides, best, bound, np.arange(300), slice(at, min(at + 70, 300)), keys, True)
    d2 = knn.pair_d2(x, x)
    d2[~np.isfinite(d2)] = np.nan
    np.fill_diagonal(d2, np.nan)
    for i in range(300):
        near = [j for j in np.lexsort((keys, d2[i])) if not np.isnan(d2[i, j])][:k]
        assert best.at[i][best.at[i] >= 0].tolist() == near
        assert best.d[i][:len(near)].tolist() == d2[i, near].tolist()
