"""Masked Gram correlations against numpy; test statistics against known values."""

import math

import numpy as np
import pytest

from somnolyt.operators import gram, profile, stats


def test_correlations_equal_numpy(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 5)) + 1e6 * np.array([0, 1, 5, 0, 0])
    x[:, 3] = x[:, 0] * 2 + r.normal(size=400) / 10
    x[:, 4] = 0.1
    x[r.random(x.shape) < 0.2] = np.nan
    cols = [f"c {i}" for i in range(5)]
    rows = [[None if math.isnan(v) else float(v) for v in row] for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols)).repartition(7)
    got = {(r["var1"], r["var2"]): r["corr"] for r in gram.pair_correlations(df, cols).collect()}
    assert len(got) == 10
    for i in range(5):
        for j in range(i):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if i == 4:
                assert got[cols[i], cols[j]] is None
            else:
                assert got[cols[i], cols[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    flags = {(r["var1"], r["var2"]): r["corr"] for r in profile.missing_correlation(df, cols).collect()}
    gone = np.isnan(x).astype(float)
    assert flags[cols[2], cols[1]] == pytest.approx(np.corrcoef(gone[:, 2], gone[:, 1])[0, 1], abs=1e-9)


def test_few_rows_and_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 4.0)], "a double, b double")
    assert gram.pair_correlations(df, ["a", "b"]).first()["corr"] is None
    assert gram.pair_correlations(df, ["a"]).count() == 0
    assert gram.pair_correlations(df.limit(0), ["a", "b"]).filter("corr is not null").count() == 0
    assert "Expand" not in gram.pair_correlations(df, ["a", "b"])._jdf.queryExecution().toString()


@pytest.mark.parametrize("x, dof, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (11.070498, 5, 0.05), (6.634897, 1, 0.01),
                                       (23.209251, 10, 0.01), (0.0, 3, 1.0), (2.365974, 3, 0.5), (124.342113, 100, 0.05)])
def test_chi2_p_has_tabulated_values(x, dof, p):
    assert stats.chi2_p(x, dof) == pytest.approx(p, abs=1e-6)


def _independence(spark, table):
    rows = [("f", f"l{i}", f"g{j}", n) for i, row in enumerate(table) for j, n in enumerate(row) if n]
    rows += [("f", None, "g0", 50), ("one", "l", "g0", 3), ("one", "l", "g1", 4)]
    df = spark.createDataFrame(rows, "feature string, level string, grp string, n long")
    got = {r["feature"]: r for r in stats.chi2_independence(df, "feature", "level", "grp", "n").collect()}
    assert got["one"]["chi2"] is None and got["one"]["p"] is None
    return got["f"]


@pytest.mark.parametrize("table", [[[10, 20], [30, 5]], [[10, 20, 7], [30, 5, 9]], [[10, 0], [30, 5]], [[9, 0], [0, 5]],
                                   [[10, 0, 3], [30, 5, 0]]])
def test_independence_equals_plain_loops(spark, table):
    t = np.array(table, float)
    e = t.sum(axis=1)[:, None] * t.sum(axis=0) / t.sum()
    off = np.abs(t - e)
    if t.shape == (2, 2):
        off -= np.minimum(0.5, off)
    row = _independence(spark, table)
    assert row["chi2"] == pytest.approx((off * off / e).sum()) and row["dof"] == (t.shape[0] - 1) * (t.shape[1] - 1)


def test_comparison_has_welch(spark):
    a, b = [1.0, 2.0, 3.0, 4.5], [2.0, 5.0, 9.0]
    df = spark.createDataFrame([("a", v, "x") for v in a] + [("b", v, "y") for v in b] + [(None, 100.0, "z")], "g string, v double, c string")
    from pyspark.sql import functions as F
    rows = {r["feature"]: r for r in stats.comparison_table(df, F.col("g"), ["v"], ["c"]).collect()}
    sa, sb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 3
    assert rows["v"]["statistic"] == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(sa + sb))
    assert rows["v"]["dof"] == pytest.approx((sa + sb) ** 2 / (sa ** 2 / 3 + sb ** 2 / 2))
    assert 0 < rows["v"]["p"] < 1 and rows["c"]["dof"] == 1.0
