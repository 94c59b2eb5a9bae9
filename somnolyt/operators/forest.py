"""Random forest whose trees are grown, kept and applied in pieces.

The upper levels of all trees grow one level a job: tasks count (node, drawn
feature, bin, class) cells, one task a tree adds them and picks the cuts, and
the driver gets only the cuts.  A node of at most ``LOCAL_ROWS`` drawn rows goes,
with its rows, to one group that grows the whole subtree below it.  Subtrees are
a table of packed nodes; the driver holds the upper levels alone.  Scoring sends
chunks of rows to the subtrees that they reach and adds up the trees' shares.

* Features are binned once (``boosting.feature_cuts``): a bin a value where there
  are few, else exact quantiles.
* Every tree draws each row Poisson(1) times (once without ``bootstrap``) by a
  hash of the row's key, and every node its own features.  Counts are whole
  numbers, so trees do not depend on partitions.
* Cuts maximise the weighted Gini gain; a node ends where it is pure, too deep,
  or no cut gains.  A leaf votes with its weighted class shares.

Defined results: rows without a label take no part in the fit; missing values
and NaN are greater than every cut in the fit and when scoring; a table without
labelled rows is refused.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..session import materialize
from .boosting import feature_cuts

#: Drawn rows of a node whose subtree one group grows.
LOCAL_ROWS = 50_000
#: Rows that a task packs at a time.
CHUNK_ROWS = 50_000
#: Rows below which a further task is not worth its start, and rows that a task takes where there are enough for all cores.
ROWS_A_TASK, FULL_TASK_ROWS = 5_000, 50_000
#: Least gain (in weighted rows) of a cut, for rounding.
LEAST_GAIN = 1e-9

#: Probability of at most 0, 1, ... draws of a row.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def n_tasks(rows: int, cores: int) -> int:
    """Tasks for so many rows.  A task's counts have the size of the open nodes'
    cells whatever its rows, so beyond two tasks a core only full ones are added."""
    return max(1, min(math.ceil(rows / ROWS_A_TASK), max(2 * cores, math.ceil(rows / FULL_TASK_ROWS))))


def n_drawn_features(strategy: str, p: int) -> int:
    """Features a node draws of p."""
    if strategy in ("auto", "sqrt"):
        return max(1, math.ceil(math.sqrt(p)))
    if strategy == "log2":
        return max(1, math.ceil(math.log2(p)))
    if strategy == "onethird":
        return max(1, math.ceil(p / 3))
    if strategy == "all":
        return p
    x = float(strategy)
    return min(p, int(x) if "." not in strategy else max(1, math.ceil(x * p)))


def draws(draw: np.ndarray, tree: int, bootstrap: bool) -> np.ndarray:
    """How often a tree draws each row."""
    if not bootstrap:
        return np.ones(len(draw), np.int64)
    x = draw.view(np.uint64) + np.uint64(((tree + 1) * 0x9E3779B97F4A7C15) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(POISSON, (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0 ** 64, side="right")


def drawn_features(seed: tuple, n_nodes: int, p: int, m: int) -> np.ndarray:
    return np.argsort(np.random.default_rng(seed).random((n_nodes, p)), axis=1)[:, :m]


def place(feature, cut, left, bins: np.ndarray) -> np.ndarray:
    """The leaf of every row; the right child follows the left one."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(rows):
        f = feature[at[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        at[rows] = left[at[rows]] + (bins[rows, f] > cut[at[rows]])
    return at


def best_splits(cell: np.ndarray, counts: np.ndarray, m: int, weights: np.ndarray, least: int):
    """Best cut of every node from the class counts of ascending cells
    ((node * m + drawn feature) * 256 + bin): (node, cell, gain, counts left, counts right)."""
    group = cell >> 8
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(cell)])
    cum = np.cumsum(counts, axis=0)
    left = cum - np.repeat(cum[first] - counts[first], size, axis=0)
    total = np.repeat(left[first + size - 1], size, axis=0)
    right = total - left

    def purity(c):
        c = c * weights
        return np.divide((c * c).sum(axis=1), c.sum(axis=1), out=np.zeros(len(c)), where=c.sum(axis=1) > 0)
    gain = purity(left) + purity(right) - purity(total)
    gain[(left.sum(axis=1) < least) | (right.sum(axis=1) < max(1, least))] = -1.0
    node = group // m
    begins = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    best = np.maximum.reduceat(gain, begins)
    hits = np.flatnonzero(gain == np.repeat(best, np.diff(np.r_[begins, len(cell)])))
    at = hits[np.r_[True, node[hits][1:] != node[hits][:-1]]]
    return node[at], cell[at], gain[at], left[at], right[at]


def grow_subtree(bins: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, weights: np.ndarray, m: int, least: int, seed: tuple):
    """(feature, cut, left, counts, importance) of the tree below a node, a level at a time."""
    p, k = bins.shape[1], len(weights)
    feature, cut, left = [np.full(1, -1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    counts = [np.bincount(y, w, k).astype(np.int64)[None]]
    importance = np.zeros(p)
    slot, ids, n_nodes, payload = np.zeros(len(y), np.int64), np.zeros(1, np.int64), 1, (y << 5) | np.minimum(w, 31)
    splits = []
    for level in range(depth):
        live = np.concatenate([c for c in counts])[ids]
        grows = ((live > 0).sum(axis=1) > 1) & (live.sum(axis=1) >= 2 * max(1, least))
        keep = grows[slot]
        bins, payload, slot = bins[keep], payload[keep], (np.cumsum(grows) - 1)[slot[keep]]
        ids = ids[grows]
        if not len(ids):
            break
        drawn = drawn_features((*seed, level), len(ids), p, m)
        key = ((slot[:, None] * m + np.arange(m)) << 8 | np.take_along_axis(bins, drawn[slot], axis=1)) << 13 | payload[:, None]
        key = np.sort(key, axis=None)
        cell = key >> 13
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        label, times = (key >> 5) & 255, key & 31
        sums = np.column_stack([np.add.reduceat(np.where(label == c, times, 0), first) for c in range(k)])
        node, at, gain, lc, rc = best_splits(cell[first], sums, m, weights, least)
        good = gain > LEAST_GAIN
        node, at, gain, lc, rc = node[good], at[good], gain[good], lc[good], rc[good]
        if not len(node):
            break
        f, b = drawn[node, (at >> 8) % m], at & 255
        np.add.at(importance, f, gain)
        children = n_nodes + 2 * np.arange(len(node))
        splits.append((ids[node], f, b, children))
        n_nodes += 2 * len(node)
        counts.append(np.stack([lc, rc], axis=1).reshape(-1, k))
        where = np.full(len(ids), -1)
        where[node] = np.arange(len(node))
        now = where[slot]
        bins, payload, now = bins[now >= 0], payload[now >= 0], now[now >= 0]
        slot = 2 * now + (bins[np.arange(len(now)), f[now]] > b[now])
        ids = (children[:, None] + np.arange(2)).ravel()
    feature, cut, left = np.full(n_nodes, -1, np.int16), np.zeros(n_nodes, np.uint8), np.zeros(n_nodes, np.int32)
    for at, f, b, children in splits:
        feature[at], cut[at], left[at] = f, b, children
    return feature, cut, left, np.concatenate(counts), importance


def shares(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    c = counts * weights
    return c / np.maximum(c.sum(axis=1, keepdims=True), 1e-300)


def _binned(x: np.ndarray, cuts: list) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, x[:, i], side="left")    # NaN: after every cut
    return out


def _values(column, p: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)


def _bytes(column, p: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, p)


def _chunks(batches, rows: int):
    """Batches joined to at least ``rows`` rows (the last may have fewer)."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _split_by(at: np.ndarray):
    """(value, row numbers) of every distinct value."""
    order = np.argsort(at, kind="stable")
    ends = np.flatnonzero(np.r_[at[order][1:] != at[order][:-1], True]) + 1 if len(at) else []
    for a, b in zip(np.r_[0, ends[:-1]].astype(int), ends):
        yield int(at[order[a]]), order[a:b]


def grow(df: DataFrame, features: list[str], label: str, key: list[str], class_weights: dict, trees: int, max_depth: int,
         max_bins: int, strategy: str, bootstrap: bool, least: int, seed: int):
    """(upper trees, subtrees, cuts, importances by tree, class weights) of a labelled table."""
    labelled = df.filter(F.col(f"`{label}`").isNotNull())
    seen = {int(r[0]): r[1] for r in labelled.groupBy(F.col(f"`{label}`").cast("int")).count().collect()}
    if not seen:
        raise ValueError("no labelled rows")
    k, total, p = max(2, max(seen) + 1), sum(seen.values()), len(features)
    weights = np.array([float(class_weights.get(c, 1.0)) for c in range(k)])
    m = n_drawn_features(strategy, p)
    value = [F.when(~F.isnan(x), x) for x in (F.col(f"`{c}`").cast("double") for c in features)]
    filled = labelled.select(*[c for c in dict.fromkeys([*key, label]) if c not in features],
                             *[x.alias(c) for x, c in zip(value, features)])
    cuts = feature_cuts(filled, features, max_bins)

    def bin_rows(batches):
        for batch in batches:
            out = _binned(_values(batch.column("x"), p), cuts)
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("draw"),
                                              pa.array([r.tobytes() for r in out], pa.binary())], ["label", "draw", "bins"])
    rows = filled.select(F.col(f"`{label}`").cast("int").alias("label"), F.xxhash64(*[F.col(f"`{c}`") for c in key], F.lit(seed)).alias("draw"),
                         F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(float("nan"))) for c in features]).alias("x"))
    rows = (rows.mapInArrow(bin_rows, "label int, draw long, bins binary")
            .repartition(n_tasks(total, df.sparkSession.sparkContext.defaultParallelism)).persist(StorageLevel.MEMORY_AND_DISK))
    upper = [{"feature": [-1], "cut": [0], "left": [0], "counts": [None]} for _ in range(trees)]
    importance = np.zeros((trees, p))
    open_, depth_of = {t: [0] for t in range(trees)}, [{0: 0} for _ in range(trees)]
    local = [set() for _ in range(trees)]
    try:
        if total <= LOCAL_ROWS:
            local, open_ = [{0} for _ in range(trees)], {}
        level = 0
        while open_ and level < max_depth:
            for t, node, f, b, gain, lc, rc in _level(rows, upper, open_, level, p, k, m, weights, least, bootstrap, seed):
                tree = upper[t]
                if tree["counts"][node] is None:
                    tree["counts"][node] = (np.array(lc) + np.array(rc)).tolist()
                if gain <= LEAST_GAIN:
                    continue
                importance[t, f] += gain
                tree["feature"][node], tree["cut"][node], tree["left"][node] = f, b, len(tree["feature"])
                for c in (lc, rc):
                    child = len(tree["feature"])
                    for name, blank in (("feature", -1), ("cut", 0), ("left", 0), ("counts", list(c))):
                        tree[name].append(blank)
                    depth_of[t][child] = level + 1
            level += 1
            after = {}
            for t in open_:
                for node in range(len(upper[t]["feature"])):
                    c = upper[t]["counts"][node]
                    if upper[t]["feature"][node] >= 0 or c is None or depth_of[t][node] != level or (np.array(c) > 0).sum() < 2:
                        continue
                    if sum(c) <= LOCAL_ROWS:
                        local[t].add(node)
                    else:
                        after.setdefault(t, []).append(node)
            open_ = after
        for t in range(trees):
            for name in ("feature", "cut", "left"):
                upper[t][name] = np.array(upper[t][name])
            upper[t]["shares"] = [None if c is None else shares(np.array([c]), weights)[0].tolist() for c in upper[t].pop("counts")]

        def pack(batches):
            for chunk in _chunks(batches, CHUNK_ROWS):
                bins, y, draw = _bytes(chunk.column("bins"), p), chunk.column("label").to_numpy(), chunk.column("draw").to_numpy()
                for t, tree in enumerate(upper):
                    times = draws(draw, t, bootstrap)
                    mine = np.flatnonzero(times)
                    at = place(tree["feature"], tree["cut"], tree["left"], bins[mine])
                    out = [(t, node, depth_of[t][node], bins[mine[r]].tobytes(), y[mine[r]].astype(np.uint8).tobytes(),
                            np.minimum(times[mine[r]], 31).astype(np.uint8).tobytes())
                           for node, r in _split_by(at) if node in local[t]]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema=packed)
        names = ["tree", "node", "depth", "bins", "y", "w"]
        packed = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("depth", pa.int32()), *[(c, pa.binary()) for c in names[3:]]])
        piece = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.binary()), ("cut", pa.binary()),
                           ("left", pa.binary()), ("shares", pa.binary()), ("importance", pa.list_(pa.float64()))])

        def subtree(table):
            t, node, depth = (table.column(c)[0].as_py() for c in names[:3])
            bins = _bytes(table.column("bins"), p)
            y, w = (_bytes(table.column(c), 1)[:, 0].astype(np.int64) for c in ("y", "w"))
            # rows in an order of their own, so that nothing depends on the tasks
            f, b, left, counts, gains = grow_subtree(bins, y, w, max_depth - depth, weights, m, least, (seed, t, node))
            return pa.table([pa.array([x], kind) for x, kind in zip(
                [t, node, f.tobytes(), b.tobytes(), left.tobytes(), shares(counts, weights).astype(np.float32).tobytes(), gains.tolist()],
                piece.types)], schema=piece)
        blobs = rows.mapInArrow(pack, "tree int, node int, depth int, bins binary, y binary, w binary")
        pieces = materialize(blobs.repartition(max(trees, rows.sparkSession.sparkContext.defaultParallelism), "tree", "node")
                             .groupBy("tree", "node").applyInArrow(subtree, SUBTREES))
        gains = pieces.select("tree", F.posexplode("importance").alias("i", "x")).groupBy("tree", "i").agg(F.sum("x").alias("x"))
        for r in gains.collect():       # trees x features
            importance[r["tree"], r["i"]] += r["x"]
    finally:
        rows.unpersist()
    return upper, pieces, cuts, importance, weights


SUBTREES = "tree int, node int, feature binary, cut binary, left binary, shares binary, importance array<double>"


def _opened(row, k: int) -> tuple:
    """(feature, cut, left, shares) of a packed subtree."""
    f, c, left, values = (np.frombuffer(row[n], kind) for n, kind in (
        ("feature", np.int16), ("cut", np.uint8), ("left", np.int32), ("shares", np.float32)))
    return f, c, left, values.reshape(-1, k)


def _level(rows: DataFrame, upper: list, open_: dict, level: int, p: int, k: int, m: int, weights: np.ndarray, least: int,
           bootstrap: bool, seed: int):
    """Best cuts of the open nodes: (tree, node, feature, bin, gain, counts left, counts right)."""
    arrays = {t: tuple(np.array(upper[t][c]) for c in ("feature", "cut", "left")) for t in open_}
    drawn = {t: drawn_features((seed, t, 1 << 20, level), len(nodes), p, m) for t, nodes in open_.items()}

    def count(batches):
        sums = {t: np.zeros(len(nodes) * m * 256 * k, np.int64) for t, nodes in open_.items()}
        for batch in _chunks(batches, CHUNK_ROWS):
            bins, y, draw = _bytes(batch.column("bins"), p), batch.column("label").to_numpy().astype(np.int64), batch.column("draw").to_numpy()
            for t, nodes in open_.items():
                slots = np.full(len(arrays[t][0]), -1)
                slots[nodes] = np.arange(len(nodes))
                times = draws(draw, t, bootstrap)
                slot = slots[place(*arrays[t], bins)]
                mine = np.flatnonzero((times > 0) & (slot >= 0))
                cells = (((slot[mine, None] * m + np.arange(m)) << 8) + np.take_along_axis(bins[mine], drawn[t][slot[mine]], axis=1)) * k
                cells += y[mine, None]
                sums[t] += np.bincount(cells.ravel(), np.repeat(times[mine], m), len(sums[t])).astype(np.int64)
        for t, s in sums.items():
            seen = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "cell": pa.array([seen.tobytes()], pa.binary()),
                                              "n": pa.array([s[seen].tobytes()], pa.binary())})

    def pick(table):
        t = table.column("tree")[0].as_py()
        s = np.zeros(len(open_[t]) * m * 256 * k, np.int64)
        for c, n in zip(table.column("cell").to_pylist(), table.column("n").to_pylist()):
            s[np.frombuffer(c, np.int64)] += np.frombuffer(n, np.int64)
        counts = s.reshape(-1, k)
        cell = np.flatnonzero(counts.any(axis=1))
        node, at, gain, lc, rc = best_splits(cell, counts[cell], m, weights, least) if len(cell) else [np.zeros(0, int)] * 5
        return pa.table({"tree": pa.array([t] * len(node), pa.int32()), "node": pa.array(np.array(open_[t])[node], pa.int32()),
                         "feature": pa.array(drawn[t][node, (at >> 8) % m], pa.int32()), "bin": pa.array(at & 255, pa.int32()),
                         "gain": pa.array(gain, pa.float64()), "lc": pa.array(list(lc), pa.list_(pa.int64())),
                         "rc": pa.array(list(rc), pa.list_(pa.int64()))})
    found = (rows.mapInArrow(count, "tree int, cell binary, n binary").groupBy("tree")
             .applyInArrow(pick, "tree int, node int, feature int, bin int, gain double, lc array<long>, rc array<long>"))
    return sorted(found.collect(), key=lambda r: (r["tree"], r["node"]))   # one row an open node


class RandomForest(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of the forest.  ``featureNames`` are the table's columns; the
    model reads them assembled in ``featuresCol``."""

    featureNames = Param(Params._dummy(), "featureNames", "feature columns", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of the features", TypeConverters.toString)
    classWeights = Param(Params._dummy(), "classWeights", "weight of a row by its class", TypeConverters.toListFloat)
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features a node draws", TypeConverters.toString)
    bootstrap = Param(Params._dummy(), "bootstrap", "whether trees draw rows", TypeConverters.toBoolean)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows a leaf keeps", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featureNames=None, labelCol="label", featuresCol="features", classWeights=None, numTrees=100, maxDepth=30,
                 maxBins=64, featureSubsetStrategy="sqrt", bootstrap=True, minInstancesPerNode=1, seed=42):
        super().__init__()
        self._setDefault(labelCol="label", featuresCol="features", classWeights=[], numTrees=100, maxDepth=30, maxBins=64,
                         featureSubsetStrategy="sqrt", bootstrap=True, minInstancesPerNode=1, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "RandomForestModel":
        get = self.getOrDefault
        names, label, vector = get("featureNames"), get("labelCol"), get("featuresCol")
        key = [c for c in dataset.columns if c not in names and c not in (label, vector)] or names
        upper, pieces, cuts, importance, weights = grow(
            dataset.drop(vector), names, label, key, dict(enumerate(get("classWeights"))), get("numTrees"), get("maxDepth"), get("maxBins"),
            get("featureSubsetStrategy"), get("bootstrap"), get("minInstancesPerNode"), get("seed"))
        by_tree = importance.sum(axis=1, keepdims=True)
        share = np.divide(importance, by_tree, out=np.zeros_like(importance), where=by_tree > 0).sum(axis=0)
        whole = share.sum()
        model = RandomForestModel(featuresCol=vector, upper=json.dumps({
            "cuts": cuts, "importance": (share / whole if whole else share).tolist(), "classes": len(weights),
            "trees": [{c: (v if isinstance(v, list) else v.tolist()) for c, v in t.items()} for t in upper]}))
        model.subtrees = pieces
        return model


class _ForestWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.subtrees.write.parquet(f"{path}/subtrees")


class _ForestReader(MLReader):
    def load(self, path: str) -> "RandomForestModel":
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = RandomForestModel()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        model.subtrees = self.sparkSession.read.parquet(f"{path}/subtrees")
        return model


class RandomForestModel(Model, MLWritable, MLReadable):
    """Adds ``probability`` (vector) and ``prediction``: the class with the
    greatest probability, the smaller class on ties."""

    upper = Param(Params._dummy(), "upper", "cuts, importances and upper trees as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of the features", TypeConverters.toString)
    subtrees: DataFrame = None

    @keyword_only
    def __init__(self, *, upper=None, featuresCol="features"):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()

    @property
    def featureImportances(self) -> DenseVector:
        """Each feature's share of the gains of all cuts, every tree weighing the same."""
        return DenseVector(json.loads(self.getOrDefault("upper"))["importance"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = json.loads(self.getOrDefault("upper"))
        cuts, k, p, n_trees = held["cuts"], held["classes"], len(held["cuts"]), len(held["trees"])
        trees = [(np.array(t["feature"]), np.array(t["cut"]), np.array(t["left"]), t["shares"]) for t in held["trees"]]
        if dataset.isStreaming:
            return self._per_row(dataset, trees, cuts, k)
        local = {(r["tree"], r["node"]) for r in self.subtrees.select("tree", "node").collect()}   # a pair a subtree
        numbered = materialize(dataset.withColumn("_rid", F.monotonically_increasing_id()))
        sent = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("chunk", pa.int64()), ("rid", pa.binary()),
                          ("bins", pa.binary()), ("sums", pa.binary())])

        def send(batches):
            """Rows of a chunk by (tree, node) of their subtree, and what ended above (tree -1)."""
            for chunk in _chunks(batches, CHUNK_ROWS):
                rid = chunk.column("_rid").to_numpy()
                bins = _binned(_values(chunk.column("x").combine_chunks(), p), cuts)
                sums = np.zeros((len(rid), k))
                for t, (f, c, left, ended) in enumerate(trees):
                    out = []
                    for node, r in _split_by(place(f, c, left, bins)):
                        if (t, node) in local:
                            out.append((t, node, int(rid[0]), rid[r].tobytes(), bins[r].tobytes(), b""))
                        else:
                            sums[r] += ended[node]
                    yield pa.RecordBatch.from_pylist([dict(zip(sent.names, o)) for o in out], schema=sent)
                yield pa.RecordBatch.from_pylist([dict(zip(sent.names, (-1, 0, int(rid[0]), rid.tobytes(), b"", sums.tobytes())))], schema=sent)

        def vote(rows, pieces):
            if not rows.num_rows or not pieces.num_rows:
                return answered.empty_table()
            f, c, left, values = _opened(pieces.slice(0, 1).to_pylist()[0], k)
            out = []
            for row in rows.to_pylist():
                bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, p)
                out.append({"tree": row["tree"], "node": row["node"], "chunk": row["chunk"], "rid": row["rid"],
                            "sums": values[place(f, c, left, bins)].astype(float).tobytes()})
            return pa.Table.from_pylist(out, schema=answered)
        answered = pa.schema([sent.field(c) for c in ("tree", "node", "chunk", "rid", "sums")])

        def add(table):
            table = table.sort_by([("tree", "ascending"), ("node", "ascending")])
            parts = [np.frombuffer(x, np.int64) for x in table.column("rid").to_pylist()]
            rid, at = np.unique(np.concatenate(parts), return_inverse=True)
            sums, a = np.zeros((len(rid), k)), 0
            for part, s in zip(parts, table.column("sums").to_pylist()):
                sums[at[a:a + len(part)]] += np.frombuffer(s, float).reshape(-1, k)   # a row once a part
                a += len(part)
            return pa.table({"_rid": rid, "_p": pa.array(list(sums / n_trees), pa.list_(pa.float64()))})
        rows = numbered.select("_rid", vector_to_array(self.getOrDefault("featuresCol")).alias("x"))
        blobs = materialize(rows.mapInArrow(send, "tree int, node int, chunk long, rid binary, bins binary, sums binary"))
        votes = (blobs.filter("tree >= 0").groupBy("tree", "node").cogroup(self.subtrees.groupBy("tree", "node"))
                 .applyInArrow(vote, "tree int, node int, chunk long, rid binary, sums binary"))
        found = votes.unionByName(blobs.filter("tree < 0").select("tree", "node", "chunk", "rid", "sums"))
        found = found.groupBy("chunk").applyInArrow(add, "_rid long, _p array<double>")
        return (numbered.join(found, "_rid").drop("_rid").withColumn("probability", array_to_vector("_p"))
                .withColumn("prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")).drop("_p"))

    def _per_row(self, dataset: DataFrame, trees: list, cuts: list, k: int) -> DataFrame:
        """A stream cannot be grouped by chunk without state, so its tasks get the
        packed subtrees as a broadcast, as Spark's own forest does."""
        packed = {(r["tree"], r["node"]): (bytes(r["feature"]), bytes(r["cut"]), bytes(r["left"]), bytes(r["shares"]))
                  for r in self.subtrees.drop("importance").collect()}
        held = dataset.sparkSession.sparkContext.broadcast(packed)

        @pandas_udf("array<double>")
        def probabilities(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            bins = _binned(np.stack(vectors.to_numpy()).astype(float), cuts)
            sums = np.zeros((len(bins), k))
            for t, (f, c, left, ended) in enumerate(trees):
                for node, r in _split_by(place(f, c, left, bins)):
                    if (t, node) not in held.value:
                        sums[r] += ended[node]
                        continue
                    sf, sc, sl, values = _opened(dict(zip(("feature", "cut", "left", "shares"), held.value[t, node])), k)
                    sums[r] += values[place(sf, sc, sl, bins[r])]
            return pd.Series(list(sums / len(trees)))
        return (dataset.withColumn("_p", probabilities(vector_to_array(self.getOrDefault("featuresCol"))))
                .withColumn("probability", array_to_vector("_p"))
                .withColumn("prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")).drop("_p"))
