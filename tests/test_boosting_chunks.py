"""Boosting's counting in chunks: joint values, sister nodes, mirrored trees."""

import numpy as np
import pyarrow as pa
import pytest

from somnolyt.operators import boosting, models


def test_joint_values_add_up_to_each_feature():
    r = np.random.default_rng(2)
    sizes = [64, 2, 3, 40, 2, 2, 5]
    n, k = 700, 3
    bins = np.stack([r.integers(0, s, n) for s in sizes]).astype(np.uint8)
    label, draw = r.integers(0, k, n).astype(np.int32), r.integers(-9, 9, n)
    start = [-1.0, -0.5, -2.0]
    trees = [boosting.Tree() for _ in range(k)]
    trees[1].split(0, 0, 20, 0.0)
    nodes = [(0, 0), (1, 2), (1, 1), (2, 0)]
    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (np.ascontiguousarray(bins), label, np.zeros(0), draw)]
    batch = pa.RecordBatch.from_arrays(blobs, ["bins", "label", "margins", "draw"])
    groups = boosting.joined(sizes)
    assert len(groups) < len(sizes) and sorted(sum(groups, [])) == list(range(len(sizes)))
    [got] = boosting.cell_sums([batch], [], trees, nodes, start, sizes, 64, 0, 1.0)
    grad = boosting.residuals(np.tile(start, (n, 1)), label)
    want = np.zeros((3, len(nodes), len(sizes), 64), np.int64)
    for i, (c, node) in enumerate(nodes):
        for row in range(n):
            if node and (bins[0, row] <= 20) != (node == 1):
                continue
            g = grad[row, c]
            for f in range(len(sizes)):
                want[:, i, f, bins[f, row]] += np.array([np.rint(g * boosting.STEPS), np.rint(abs(g) * (1 - abs(g)) * boosting.STEPS), 1]).astype(int)
    out = np.zeros((3, want[0].size), np.int64)
    for at, name in enumerate("ghn"):
        out[at, np.asarray(got.column("cell"))] = np.asarray(got.column(name))
    assert (out.reshape(want.shape) == want).all()


@pytest.mark.parametrize("few", [0, 31])
def test_rows_reach_their_leaf(few, monkeypatch):
    monkeypatch.setattr(boosting, "FEW_NODES", few)
    tree = boosting.Tree()
    tree.split(0, 1, 3, 3.5)
    tree.split(2, 0, 1, 1.5)
    x = np.array([[0, 1, 2, 5, np.nan], [3, 4, 4, 3, np.nan]])
    assert tree.place(x, tree.threshold).tolist() == [1, 3, 4, 1, 4]


def test_two_classes_count_one_tree_and_the_smaller_sister(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 10), float(i % 3), int(i % 10 < 3 or i % 3 == 0)) for i in range(120)],
                                 "row_id long, a double, b double, label int")
    assert type(models.build("GradientBoosting", ["a", "b"], False).getStages()[-1]) is boosting.MultinomialBoosting
    asked, level = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda rows, args, *rest: asked.append(args[2]) or level(rows, args, *rest))
    grown = boosting.grow(rows, ["a", "b"], key=["row_id"], max_iter=1, max_depth=2, most_classes=2)
    assert [len(nodes) for nodes in asked] == [1, 1]
    a, b = grown["rounds"][0]
    assert a["feature"] == b["feature"] and a["value"] == [-v for v in b["value"]]
    with pytest.raises(ValueError):
        boosting.grow(rows.withColumn("label", rows.label + 1), ["a", "b"], max_iter=1, most_classes=2)
