"""The forest that is grown in pieces: quality, independence of partitions, saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from somnolyt.operators import forest, models


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(900, 4)), 2)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(int)
    data = [(i, *v, int(c)) for i, (v, c) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(data, "row_id long, a double, b double, c double, d double, label int").cache()


@pytest.mark.parametrize("local_rows", [60, 50_000])
def test_learns_whatever_the_size_of_the_pieces(spark, rows, local_rows, monkeypatch, tmp_path):
    monkeypatch.setattr(forest, "LOCAL_ROWS", local_rows)
    train, test = rows.filter("row_id % 3 > 0"), rows.filter("row_id % 3 = 0")
    features, params = ["a", "b", "c", "d"], {"numTrees": 20}
    model = models.fit(train, features, "RandomForest", params=params)
    found = {r["row_id"]: r for r in models.predict(model, test).collect()}
    assert len(found) == 300 and np.mean([r["prediction"] == r["label"] for r in found.values()]) > 0.85
    assert all(abs(sum(r["scores"]) - 1) < 1e-6 for r in found.values())
    if local_rows == 60:   # no group grows a whole tree, and the driver holds only the upper levels
        assert model.stages[-1].subtrees.count() > 20
    other = models.fit(train.repartition(7), features, "RandomForest", params=params)
    assert models.feature_importance(other, features).collect() == models.feature_importance(model, features).collect()
    path = str(tmp_path / "forest")
    models.save(model, path)
    assert {r["row_id"]: r for r in models.predict(models.load(path), test).collect()} == found


def test_gaps_and_four_classes(spark, rows):
    four = rows.withColumn("label", F.col("label") + F.when(F.col("d") > 0, 2).otherwise(0))
    four = four.withColumn("a", F.when(F.col("row_id") % 10 > 0, F.col("a"))).withColumn("label", F.when(F.col("row_id") % 11 > 0, F.col("label")))
    model = models.fit(four, ["a", "b", "c", "d"], "RandomForest", True, {"numTrees": 10, "maxDepth": 12, "featureSubsetStrategy": "all"})
    got = models.predict(model, four).collect()
    assert len(got) == 900 and {len(r["scores"]) for r in got} == {4}
    assert np.mean([r["prediction"] == r["label"] for r in got if r["label"] is not None]) > 0.9


def test_a_subtree_is_exact_where_nothing_is_drawn():
    """Every feature at every node: pure leaves hold each row's label."""
    r = np.random.default_rng(1)
    bins = r.integers(0, 40, (200, 3)).astype(np.uint8)
    y = (bins.astype(int).sum(axis=1) % 2).astype(np.int64)
    f, cut, left, counts, gains = forest.grow_subtree(bins, y, np.ones(200, np.int64), 60, np.ones(2), 3, 1, (1,))
    said = counts[forest.place(f, cut, left, bins)]
    agree = said.argmax(axis=1) == y
    assert agree.mean() > 0.98 and counts[0].sum() == 200 and gains.sum() > 0
