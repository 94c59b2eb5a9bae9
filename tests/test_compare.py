"""Models are compared on one balanced train part."""

import pytest

from somnolyt.operators import forest, models


def rows(spark, n=240):
    return spark.createDataFrame([(i, float(i % 17), float((i * 7) % 11), int((i * 7) % 11 + i % 17 > 9)) for i in range(n)],
                                 "row_id long, a double, b double, label int")


def test_compared_models_share_the_balanced_rows(spark, monkeypatch):
    """The train part is balanced once (before: once a model); figures are those of each model alone."""
    data, made, balanced = rows(spark), [], models.balanced
    monkeypatch.setattr(models, "balanced", lambda *a, **k: made.append(1) or balanced(*a, **k))
    monkeypatch.setitem(models.RF_DEFAULTS, "numTrees", 5)
    monkeypatch.setitem(models.GBT_DEFAULTS, "maxIter", 3)
    names = ["RandomForest", "GradientBoosting"]
    got = {(r["model"], r["metric"]): r["value"] for r in models.compare(data, ["a", "b"], names).collect()}
    assert len(made) == 1
    for name in names:
        for r in models.train_evaluate(data, ["a", "b"], name)[2].collect():
            assert got.pop((name, r["metric"])) == pytest.approx(r["value"])
    assert not got


def test_tasks_fill_the_cores_before_they_are_added():
    """Before: 180 tasks of 5,000 rows, each with the counts of all open nodes."""
    assert [forest.n_tasks(n, 8) for n in (0, 1, 5_001, 60_000, 900_000, 5_400_000)] == [1, 1, 2, 12, 18, 108]
