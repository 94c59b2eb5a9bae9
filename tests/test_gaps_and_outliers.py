"""Missing labels and predictions in the metrics; the simultaneous outlier rule."""

import pytest
from pyspark.sql import functions as F

from somnolyt.operators import balance, evaluate, outliers


def test_missing_labels_and_predictions_are_no_class(spark):
    rows = [(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)]
    odd = [(None, 1), (1, None), (None, None), (None, 0)]
    full, gaps = (spark.createDataFrame(r, "label int, prediction int") for r in (rows, rows + odd))
    for metric in (evaluate.binary_metrics, evaluate.macro_metrics, evaluate.classification_report, evaluate.confusion_matrix):
        assert sorted(map(str, metric(gaps).collect())) == sorted(map(str, metric(full).collect()))
    assert evaluate.binary_metrics(gaps).first()["n"] == 5
    assert {r["class"] for r in evaluate.per_class(gaps).collect()} == {0, 1}


def test_simultaneous_bounds_see_all_rows(spark):
    # a's far values sit on b's middle rows: without them b's quartiles move
    rows = [(i, float(i % 10), float(i // 10)) for i in range(200)]
    rows += [(200 + i, 1000.0, 9.0) for i in range(3)] + [(300, 5.0, 500.0), (301, None, 600.0)]
    df = spark.createDataFrame(rows, "patient_id long, a double, b double")
    got, audit = outliers.outlier_filter_sequential(df, ["a", "b"], simultaneous=True)
    lines = {r["column"]: r for r in audit.collect()}
    for c in ("a", "b"):
        q1, q3 = df.agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
        lo, hi = q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)
        assert (lines[c]["lower"], lines[c]["upper"]) == pytest.approx((lo, hi))
        assert lines[c]["n_rows"] == 205 and lines[c]["n_outliers"] == df.filter(f"{c} < {lo} or {c} > {hi}").count()
    assert {r.patient_id for r in got.collect()} == set(range(200))
    _, one_by_one = outliers.outlier_filter_sequential(df, ["a", "b"])
    assert [r.n_rows for r in one_by_one.orderBy("step").collect()] == [205, 202]


def test_adasyn_counts_follow_the_rounding(spark):
    """Each row's draws are round(r / sum r * missing rows), halves to even."""
    import math
    rows = [(i, int(i % 4 == 0), [math.sin(i * 1.7) + (i % 4 == 0) * 0.4, math.cos(i * 2.3)]) for i in range(80)]
    few = [r for r in rows if r[1] == 1]
    share = []
    for i, _, v in few:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j, c) for j, c, w in rows if j != i)[:5]
        share.append(sum(c != 1 for _, _, c in near) / 5)
    want = sum(round(s / sum(share) * (60 - len(few))) for s in share)
    df = spark.createDataFrame(rows, "row_id long, label int, vector array<double>")
    assert balance.adasyn(df).filter("is_synthetic").count() == want


@pytest.mark.parametrize("width", [1, 2, 3, 8])
def test_measuring_ahead_changes_nothing(spark, monkeypatch, width):
    """The sequential rule by plain loops, whatever number of columns is measured at once."""
    import numpy as np
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 6))
    for c in (1, 2, 4):
        x[r.choice(300, 5, replace=False), c] = 40.0
    x[:60, 5] = 30.0          # too many to be removed
    x[r.random((300, 6)) < 0.03] = np.nan
    names = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in row)) for i, row in enumerate(x)],
                               "patient_id long, " + ", ".join(f"{c} double" for c in names))
    left, want = np.arange(300), []
    for c in range(6):
        q1, q3 = np.nanpercentile(x[left, c], [25, 75])
        out = (x[left, c] < q1 - 3 * (q3 - q1)) | (x[left, c] > q3 + 3 * (q3 - q1))
        gone = 0 < out.sum() < len(left) * 0.05
        want.append((names[c], pytest.approx(q1), pytest.approx(q3), out.sum(), len(left), "removed" if gone else "kept" if out.any() else "none"))
        left = left[~out] if gone else left
    monkeypatch.setattr(outliers, "FIRST_WIDTH", width)
    got, audit = outliers.outlier_filter_sequential(df, names)
    assert [(a.column, a.q1, a.q3, a.n_outliers, a.n_rows, a.action) for a in audit.orderBy("step").collect()] == want
    assert sorted(a.patient_id for a in got.collect()) == left.tolist()
    assert sum(w[-1] == "removed" for w in want) >= 2
