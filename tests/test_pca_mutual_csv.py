"""Principal components, nearest-neighbour mutual information and typed CSV
against plain versions of themselves."""

import numpy as np
import pytest

from somnolyt.operators import mutual, pca
from somnolyt.sources import typed_csv


def test_components_equal_numpy(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 4)) @ r.normal(size=(4, 4)) + [0, 1e5, 0, -3]
    cols = ["a", "b c", "d", "e"]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)],
                               "id long, a double, `b c` double, d double, e double").repartition(5)
    got = pca.fit(df, cols, 3)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert got.variances == pytest.approx(values[::-1][:3]) and got.total == pytest.approx(values.sum())
    assert got.loadings @ got.loadings.T == pytest.approx(np.eye(3), abs=1e-9)
    for mine, theirs in zip(got.loadings, vectors.T[::-1]):
        assert mine[np.abs(mine).argmax()] > 0 and abs(mine @ theirs) == pytest.approx(1)
    seen = {(p.id, p.component): p.value for p in got.project(df, ["id"]).collect()}
    assert len(seen) == 900
    assert [seen[7, c] for c in range(3)] == pytest.approx(list(got.loadings @ x[7]))
    gaps = spark.createDataFrame([(1, None, 2.0), (2, 1.0, float("nan"))], "id long, a double, e double")
    two = pca.Components(["a", "e"], np.ones(1), np.array([[0.6, 0.8]]), 1.0)
    assert sorted(p.value for p in two.project(gaps, ["id"]).collect()) == pytest.approx([0.6, 1.6])
    with pytest.raises(ValueError):
        pca.fit(df, ["a"])


def _psi(n):
    return sum(1 / i for i in range(1, n)) - 0.5772156649015329


def _plain(rows, k=3):
    """Mutual information of (label, value) rows by loops."""
    sizes = {c: sum(a == c for a, _ in rows) for c, _ in rows}
    rows = [row for row in rows if sizes[row[0]] > 1]
    total = 0.0
    for at, (label, v) in enumerate(rows):
        kk = min(k, sizes[label] - 1)
        radius = sorted(abs(v - o) for i, (c, o) in enumerate(rows) if c == label and i != at)[kk - 1]
        m = sum(o == v if radius == 0 else v - radius < o < v + radius for _, o in rows)
        total += _psi(kk) - _psi(sizes[label]) - _psi(m)
    return max(0.0, _psi(len(rows)) + total / len(rows)) if rows else 0.0


def test_mutual_information_equals_loops(spark):
    r = np.random.default_rng(1)
    label = r.integers(0, 3, 120)
    columns = {"noise": r.normal(size=120), "signal": label + r.normal(size=120) / 4, "flag": (label > 0) * 1.0,
               "ties": r.integers(0, 6, 120) / 4, "flat": np.zeros(120)}
    rows = [(f, int(c), float(v)) for f, x in columns.items() for c, v in zip(label, x)]
    rows += [("one", 0, 1.0), ("one", 1, 2.0), ("signal", 9, 0.5), ("flat", None, 1.0), ("flat", 1, None), ("ties", 2, float("nan"))]
    tall = spark.createDataFrame(rows, "feature string, label int, value double").repartition(6)
    whole = {f: [(c, v) for g, c, v in rows if g == f and c is not None and v is not None and v == v] for f in [*columns, "one"]}
    for block in (mutual.BLOCK, 8):
        got = {p.feature: p.mutual_info for p in mutual.mutual_information_knn(tall, block=block).collect()}
        assert got == pytest.approx({f: _plain(x) for f, x in whole.items()}, abs=1e-9)
    assert got["signal"] > 0.3 > got["noise"] and got["one"] == 0


def test_digamma(spark):
    got = spark.range(1, 60).select("id", mutual.digamma(pca.F.col("id")).alias("psi")).collect()
    assert all(p.psi == pytest.approx(_psi(p.id), abs=1e-10) for p in got)


def test_rows_that_do_not_fit_are_kept_apart(spark, tmp_path):
    good = [f"{i},{i / 2},{'true' if i % 2 else 'False'},2020-01-{i % 28 + 1:02d},\"a \"\"{i}\"\",\nb\"" for i in range(200)]
    bad = ["x,1.5,true,2020-01-01,t", "7,1.5", "8,1.5,true,2020-01-01,t,more", "9,1.5,maybe,2020-13-01,t"]
    odd = [" NA ,,nan,null,", "12345678901234567890,1,true,2020-01-01,t"]
    (tmp_path / "a.csv").write_text("n,x,flag,day,note\n" + "\n".join(good + bad[:2]) + "\n")
    (tmp_path / "b.csv").write_text("n,x,flag,day,note\n" + "\n".join(bad[2:] + odd) + "\n")
    got = typed_csv.read_typed(spark, str(tmp_path), tolerance=0.02)
    assert got.kinds == {"n": "bigint", "x": "double", "flag": "boolean", "day": "date", "note": "string"}
    kept, apart = got.rows.collect(), got.quarantine.collect()
    assert len(kept) + len(apart) == len(good) + len(bad) + len(odd)
    assert sorted((q.reason, tuple(q.columns)) for q in apart) == [
        ("fields", ()), ("fields", ()), ("value", ("flag", "day")), ("value", ("n",)), ("value", ("n",))]
    assert any("12345678901234567890" in q.record for q in apart) and any(q.record == "7,1.5" for q in apart)
    assert {p.note for p in kept if p.n == 5} == {'a "5",\nb'} and sum(p.n is None for p in kept) == 1
    strict = typed_csv.read_typed(spark, str(tmp_path), tolerance=0.0)
    assert strict.kinds["n"] == "string" and strict.rows.count() + strict.quarantine.count() == len(kept) + len(apart)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "c.csv").write_text("n,x\n")
    none = typed_csv.read_typed(spark, str(tmp_path / "empty"))
    assert none.kinds == {"n": "string", "x": "string"} and none.rows.count() == none.quarantine.count() == 0
