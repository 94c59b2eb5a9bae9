"""Multinomial gradient boosting: one tree a class and round on softmax gradients.

A round grows the trees of all classes together, one level a job.  Tasks hold
only per-cell sums: every row adds its gradient, its curvature and a one to the
cell (tree node, feature, bin) of each feature; cells are combined map-side, then
summed by one aggregation, and the driver picks each node's cut from its bins.
What a job sends is bounded by ``MAX_CELLS`` whatever the rows; a level with
more cells is grown in several jobs.

* Features are binned once.  A column with at most ``BINS`` distinct values has
  one bin a value, others are cut at exact quantiles.  Rows are kept in chunks of
  ``CHUNK_ROWS``, a feature's bins side by side.
* Features with few bins are counted together: a task sums by their joint value,
  of which there are at most 256, and adds that up to each feature's bins.
* Of two sister nodes only the smaller is counted; the other is what is left of
  their parent.
* Two classes have mirrored trees (their gradients differ in sign alone), so one
  tree a round is grown: logistic boosting.
* Gradients are added as fixed-point integers, so sums, and with them the trees,
  do not depend on how rows are partitioned.
* A row's margins are brought up to date in the task from the trees grown since
  they were last written; every ``REBASE`` rounds they are written again, so
  neither lineage nor the work of a round grows with the rounds.
* Cuts maximise n_l n_r / (n_l + n_r) (mean_l - mean_r)^2 of the gradients; ties
  go to the smaller feature, then the smaller cut.  Leaves are one Newton step,
  (K - 1) / K * sum(g) / sum(|g| (1 - |g|)), times the step size.  Margins
  start at the logarithms of the classes' shares.

Defined results: rows without a label take no part in the fit; a missing
feature counts as 0 in the fit and when scoring; NaN is greater than every cut;
a table without labelled rows is refused.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..session import materialize
from .quantiles import dense_quantiles

#: Bins of a feature (at most 256, as a bin is a byte).
BINS = 64
#: Cells (node, feature, bin) that one job sums.
MAX_CELLS = 1 << 18
#: Rounds after which margins are written again.
REBASE = 10
#: Fixed-point steps of a gradient of 1; 2^43 rows can be summed in 64 bits.
STEPS = 1 << 20
#: Rows below which a further task is not worth its start.
ROWS_A_TASK = 50_000
#: Rows of a chunk: with STEPS, its sums of gradients stay below 2^(ROW_BIT - 1) and those with rows below 2^53.
CHUNK_ROWS = 1 << 14
#: The bit from which rows are counted above a sum of gradients.
ROW_BIT = 37
#: Inner nodes up to which a tree is followed node by node, not level by level.
FEW_NODES = 31
#: Jobs' worth of nodes whose sums the driver keeps for the level below.
KEPT_JOBS = 16


@dataclass
class Tree:
    """A binary tree as parallel lists; a feature of -1 marks a leaf.  Rows with
    a bin of at most ``cut`` (a value of at most ``threshold``) go left."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    threshold: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, threshold: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.threshold[node] = feature, cut, threshold
        for side in (self.left, self.right):
            side[node] = len(self.feature)
            for column, blank in ((self.feature, -1), (self.cut, 0), (self.threshold, 0.0), (self.left, 0),
                                  (self.right, 0), (self.value, 0.0)):
                column.append(blank)
        return self.left[node], self.right[node]

    def place(self, x: np.ndarray, by: list) -> np.ndarray:
        """The leaf of every row; ``x`` has a line a feature (bins with ``by`` =
        cut, values with ``by`` = threshold)."""
        inner = [i for i, f in enumerate(self.feature) if f >= 0]
        if len(inner) <= FEW_NODES:
            at = np.zeros(x.shape[1], np.uint8)
            for i in inner:     # children follow their parent, the right one the left one
                side = np.uint8(self.right[i]) - (x[self.feature[i]] <= by[i]).view(np.uint8)
                if i:
                    np.copyto(at, side, where=at == i)
                else:
                    at = side
            return at
        feature, bound = np.asarray(self.feature), np.asarray(by)
        left, right = np.asarray(self.left), np.asarray(self.right)
        at, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        while len(rows):
            rows = rows[feature[at[rows]] >= 0]
            f = feature[at[rows]]
            at[rows] = np.where(x[f, rows] <= bound[at[rows]], left[at[rows]], right[at[rows]])
        return at


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def residuals(margins: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Negative gradients of the log loss: one where the class is the label, less its probability."""
    return (label[:, None] == np.arange(margins.shape[1])) - softmax(margins)


def raised(margins: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    """Margins after the given rounds of trees."""
    out = margins.copy(order="K")
    for trees in rounds:
        if len(trees) == 2:
            up = np.asarray(trees[1].value)[trees[1].place(bins, trees[1].cut)]
            out[:, 0] -= up
            out[:, 1] += up
            continue
        for k, tree in enumerate(trees):
            out[:, k] += np.asarray(tree.value)[tree.place(bins, tree.cut)]
    return out


def drawn(draw: np.ndarray, round_no: int, rate: float) -> np.ndarray:
    """Rows that take part in a round: a fixed draw by the row's own number."""
    if rate >= 1.0:
        return np.ones(len(draw), bool)
    x = draw.view(np.uint64) + np.uint64((round_no * 0x9E3779B97F4A7C15) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0 ** 64 < rate


def unpacked(batches, p: int, start: list[float]):
    """(bins, label, margins, draw) of every chunk: bins with a line a feature,
    margins with a line a row."""
    for batch in batches:
        for chunk in zip(*(batch.column(c) for c in ("bins", "label", "margins", "draw"))):
            bins, label, margins, draw = (np.frombuffer(x.as_buffer(), kind)
                                          for x, kind in zip(chunk, (np.uint8, np.int32, np.float64, np.int64)))
            margins = margins.reshape(len(start), -1) if len(margins) else np.tile(np.array(start)[:, None], len(label))
            yield bins.reshape(p, -1), label, margins.T, draw


def joined(sizes: list[int], most: int = 256) -> list[list[int]]:
    """Features to count together: sets whose numbers of bins multiply to at most ``most``."""
    out, room = [], []
    for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
        at = next((i for i, r in enumerate(room) if r >= sizes[f]), None)
        if at is None:
            out.append([f])
            room.append(most // sizes[f])
        else:
            out[at].append(f)
            room[at] //= sizes[f]
    return out


def joint_codes(bins: np.ndarray, group: list[int], sizes: list[int]) -> np.ndarray:
    """The joint value of a set of features: the first one's bin counts most."""
    code = bins[group[0]]
    for f in group[1:]:
        code = code * np.uint8(sizes[f]) + bins[f]
    return code


def by_feature(joint: np.ndarray, groups: list[list[int]], sizes: list[int], n_bins: int) -> np.ndarray:
    """(sums, nodes, features, bins) from sums by joint value (sums, nodes, groups, 256)."""
    out = np.zeros((*joint.shape[:2], len(sizes), n_bins), np.int64)
    for i, group in enumerate(groups):
        shape = [sizes[f] for f in group]
        cube = joint[:, :, i, :math.prod(shape)].reshape(*joint.shape[:2], *shape)
        for j, f in enumerate(group):
            out[:, :, f, :sizes[f]] = cube.sum(axis=tuple(2 + a for a in range(len(group)) if a != j))
    return out


def cell_sums(batches, pending: list, growing: list[Tree], nodes: list[tuple[int, int]], start: list[float],
              sizes: list[int], n_bins: int, round_no: int, rate: float):
    """Sums of gradient, curvature and rows by cell over a task's rows; a cell
    is (index in ``nodes``, feature, bin)."""
    groups, p = joined(sizes), len(sizes)
    asked: dict[int, list[int]] = {}
    for k, node in nodes:
        asked.setdefault(k, []).append(node)
    slots = {k: np.full(len(growing[k].feature), -1) for k in asked}
    for k, own in asked.items():
        slots[k][own] = np.arange(len(own))
    sums = {k: np.zeros((3, len(own), len(groups), 256), np.int64) for k, own in asked.items()}
    for bins, label, margins, draw in unpacked(batches, p, start):
        grad = residuals(raised(margins, bins, pending), label)
        takes_part = drawn(draw, round_no, rate)
        codes = [joint_codes(bins, group, sizes) for group in groups]
        for k, own in asked.items():
            slot = slots[k][growing[k].place(bins, growing[k].cut)]
            rows = np.flatnonzero((slot >= 0) & takes_part)
            g = grad[rows, k]
            # a chunk's sums stay below 2^53, so the floats are exact; gradients and rows are summed as one number
            both = np.rint(g * STEPS) + float(1 << ROW_BIT)
            curve = np.rint(np.abs(g) * (1.0 - np.abs(g)) * STEPS)
            first, size = slot[rows] << 8, len(own) << 8
            for i, code in enumerate(codes):
                cells = first + code[rows]
                got = np.bincount(cells, both, size).astype(np.int64)
                n = (got + (1 << (ROW_BIT - 1))) >> ROW_BIT
                for at, part in enumerate((got - (n << ROW_BIT), np.bincount(cells, curve, size).astype(np.int64), n)):
                    sums[k][at, :, i] += part.reshape(-1, 256)
    out = np.zeros((3, len(nodes), p, n_bins), np.int64)
    for k, own in asked.items():
        out[:, [nodes.index((k, node)) for node in own]] = by_feature(sums[k], groups, sizes, n_bins)
    out = out.reshape(3, -1)
    seen = np.flatnonzero(out[2])
    yield pa.RecordBatch.from_arrays([pa.array(seen), *[pa.array(x[seen]) for x in out]], ["cell", "g", "h", "n"])


def best_cut(g: np.ndarray, n: np.ndarray, least: int):
    """(gain, feature, cut) of a node's (p, bins) sums, or None.  A cut at b
    sends bins up to b to the left; both sides keep ``least`` rows."""
    gl, nl = np.cumsum(g, axis=1)[:, :-1].astype(float), np.cumsum(n, axis=1)[:, :-1].astype(float)
    gr, nr = g.sum(axis=1, keepdims=True) - gl, n.sum(axis=1, keepdims=True) - nl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = nl * nr / (nl + nr) * ((gl / nl - gr / nr) / STEPS) ** 2
    gain = np.where((nl >= max(1, least)) & (nr >= max(1, least)), gain, 0.0)
    if not gain.size or gain.max() <= 1e-12:
        return None
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def feature_cuts(df: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Ascending cuts of every feature: between all distinct values where there
    are few, else at exact quantiles.  The driver gets at most about 2 * bins
    numbers a feature."""
    n_values = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"c{i}") for i, c in enumerate(features)]).first()
    few = [c for i, c in enumerate(features) if n_values[i] <= bins]
    levels = {}
    if few:
        got = df.agg(*[F.array_sort(F.collect_set(F.col(f"`{c}`").cast("double"))).alias(f"c{i}") for i, c in enumerate(few)]).first()
        levels = {c: got[i] for i, c in enumerate(few)}
    many = dense_quantiles(df, [c for c in features if c not in levels or len(levels[c]) > bins],
                           [i / bins for i in range(bins + 1)])
    out = []
    for c in features:
        values = many[c] if c in many else levels[c]
        values = sorted({v for v in values or [] if not math.isnan(v)})
        out.append([a + (b - a) / 2 for a, b in zip(values, values[1:])])
    return out


def binned(df: DataFrame, features: list[str], label: str, key: list[str], cuts: list[list[float]], seed: int,
           tasks: int) -> DataFrame:
    """(label, draw, bins, margins): chunks of rows as the trees see them.  No
    margins stand for those of the start."""
    p = len(cuts)

    def bin_rows(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), dtype=float).reshape(-1, p)
            out = np.empty(x.shape, np.uint8)
            for i, c in enumerate(cuts):
                out[:, i] = np.searchsorted(c, x[:, i], side="left")
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("draw"), pa.array([r.tobytes() for r in out], pa.binary())],
                ["label", "draw", "bins"])

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                bins = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(-1, p)
                blobs = (np.asarray(part.column("label")).astype(np.int32), np.asarray(part.column("draw")),
                         np.ascontiguousarray(bins.T), np.zeros(0))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs],
                                                 ["label", "draw", "bins", "margins"])
    rows = df.filter(F.col(f"`{label}`").isNotNull()).select(
        F.col(f"`{label}`").cast("int").alias("label"), F.xxhash64(*[F.col(f"`{c}`") for c in key], F.lit(seed)).alias("draw"),
        F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features]).alias("x"))
    return (rows.mapInArrow(bin_rows, "label int, draw long, bins binary").repartition(tasks)
            .mapInArrow(pack, "label binary, draw binary, bins binary, margins binary"))


def _rebased(rows: DataFrame, pending: list, p: int, start: list[float]) -> DataFrame:
    def move(batches):
        for batch in batches:
            now = [raised(margins, bins, pending).T.tobytes() for bins, _, margins, _ in unpacked([batch], p, start)]
            yield batch.set_column(batch.schema.get_field_index("margins"), "margins", pa.array(now, pa.binary()))
    return materialize(rows.mapInArrow(move, rows.schema))


def _level(rows: DataFrame, args: tuple, n_nodes: int, p: int, n_bins: int) -> np.ndarray:
    """The nodes' sums as (3, nodes, p, bins)."""
    cells = (rows.mapInArrow(lambda batches: cell_sums(batches, *args), "cell long, g long, h long, n long")
             .groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow())
    out = np.zeros((3, n_nodes * p * n_bins), np.int64)
    for i, name in enumerate(("g", "h", "n")):
        out[i, np.asarray(cells.column("cell"))] = np.asarray(cells.column(name))
    return out.reshape(3, n_nodes, p, n_bins)


def grow(df: DataFrame, features: list[str], label: str = "label", key: list[str] | None = None, max_iter: int = 100,
         step: float = 0.1, max_depth: int = 3, least: int = 1, rate: float = 1.0, seed: int = 42,
         bins: int = BINS, most_classes: int | None = None) -> dict:
    """The boosted trees of a labelled table (labels 0, 1, ...): {"start",
    "rounds", "importance"} with one tree a class in every round.  Labels of
    ``most_classes`` and above are refused."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must lie between 2 and 256")
    key = key or [c for c in df.columns if c not in features and c != label] or features
    labelled = df.filter(F.col(f"`{label}`").isNotNull())
    shares = {int(r[0]): r[1] for r in labelled.groupBy(F.col(f"`{label}`").cast("int")).count().collect()}
    if not shares:
        raise ValueError("no labelled rows")
    if min(shares) < 0 or most_classes and max(shares) >= most_classes:
        raise ValueError(f"labels {sorted(shares)} are not 0 to {(most_classes or max(shares) + 1) - 1}")
    k_classes, total = max(2, max(shares) + 1), sum(shares.values())
    tiny = float(np.finfo(np.float32).eps)
    start = [math.log(min(max(shares.get(k, 0) / total, tiny), 1 - tiny)) for k in range(k_classes)]
    filled = labelled.select(*[c for c in dict.fromkeys([*key, label]) if c not in features],
                             *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in features])
    cuts = feature_cuts(filled, features, bins)
    sizes = [len(c) + 1 for c in cuts]
    p, n_bins = len(features), max(2, max(sizes))
    base = binned(filled, features, label, key, cuts, seed, max(1, math.ceil(total / ROWS_A_TASK))).persist(StorageLevel.MEMORY_AND_DISK)
    now, pending, rounds = base, [], []
    importance = np.zeros(p)
    width = max(1, MAX_CELLS // (p * n_bins))
    grown = [1] if k_classes == 2 else list(range(k_classes))
    try:
        for round_no in range(max_iter):
            if len(pending) == REBASE:
                older, now = now, _rebased(now, pending, p, start)
                older.unpersist()
                pending = []
            trees = [Tree() for _ in range(k_classes)]
            sums: dict[tuple[int, int], tuple[int, int]] = {}
            level, counted, left_over = [(k, 0) for k in grown], [(k, 0) for k in grown], {}
            for _ in range(max_depth):
                found, below = {}, []
                for first in range(0, len(counted), width):
                    nodes = counted[first:first + width]
                    got = _level(now, (pending, trees, nodes, start, sizes, n_bins, round_no, rate), len(nodes), p, n_bins)
                    found.update({node: got[:, i] for i, node in enumerate(nodes)})
                for node, (sister, parent) in left_over.items():
                    found[node] = parent - found[sister]
                counted, left_over = [], {}
                keeps = len(level) <= KEPT_JOBS * width
                for k, node in level:
                    g, h, n = found[k, node]
                    sums[k, node] = (int(g[0].sum()), int(h[0].sum()))
                    best = best_cut(g, n, least)
                    if best is None:
                        continue
                    gain, f, b = best
                    importance[f] += gain
                    sides = [(k, side) for side in trees[k].split(node, f, b, cuts[f][b])]
                    n_rows = []
                    for side, part in zip(sides, (slice(0, b + 1), slice(b + 1, None))):
                        sums[side] = (int(g[f, part].sum()), int(h[f, part].sum()))
                        n_rows.append(int(n[f, part].sum()))
                    more = [side for side, c in zip(sides, n_rows) if c >= 2 * max(1, least)]
                    below += more
                    small, large = sides if n_rows[0] <= n_rows[1] else sides[::-1]
                    if keeps and large in more:
                        counted.append(small)
                        left_over[large] = (small, found[k, node])
                    else:
                        counted += more
                level = below
                if not level:
                    break
            for (k, node), (g, h) in sums.items():
                if trees[k].feature[node] < 0:
                    trees[k].value[node] = step * (k_classes - 1) / k_classes * g / h if h else 0.0
            if k_classes == 2:
                trees[0] = replace(trees[1], value=[-v for v in trees[1].value])
            rounds.append(trees)
            pending = [*pending, trees]
    finally:
        now.unpersist()
        base.unpersist()
    whole = importance.sum()
    return {"start": start, "importance": (importance / whole if whole else importance).tolist(),
            "rounds": [[vars(t) for t in trees] for trees in rounds]}


class MultinomialBoosting(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of the boosted trees.  ``featureNames`` are the table's
    columns; the model reads them assembled in ``featuresCol``."""

    featureNames = Param(Params._dummy(), "featureNames", "feature columns", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of the features", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "step size", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows a leaf keeps", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows in a round", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the rounds' draws", TypeConverters.toInt)
    mostClasses = Param(Params._dummy(), "mostClasses", "labels from here on are refused (0: none)", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featureNames=None, labelCol="label", featuresCol="features", maxIter=100, stepSize=0.1,
                 maxDepth=3, minInstancesPerNode=1, subsamplingRate=1.0, maxBins=BINS, seed=42, mostClasses=0):
        super().__init__()
        self._setDefault(labelCol="label", featuresCol="features", maxIter=100, stepSize=0.1, maxDepth=3,
                         minInstancesPerNode=1, subsamplingRate=1.0, maxBins=BINS, seed=42, mostClasses=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "MultinomialBoostingModel":
        get = self.getOrDefault
        names, label, vector = get("featureNames"), get("labelCol"), get("featuresCol")
        key = [c for c in dataset.columns if c not in names and c not in (label, vector)]
        grown = grow(dataset.drop(vector), names, label, key, get("maxIter"), get("stepSize"), get("maxDepth"),
                     get("minInstancesPerNode"), get("subsamplingRate"), get("seed"), get("maxBins"),
                     get("mostClasses") or None)
        return MultinomialBoostingModel(trees=json.dumps(grown), featuresCol=vector)


class MultinomialBoostingModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` (vector) and ``prediction``: the class with the
    greatest probability, the smaller class on ties."""

    trees = Param(Params._dummy(), "trees", "start margins, trees by round and importances as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of the features", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees=None, featuresCol="features"):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**self._input_kwargs)

    @property
    def featureImportances(self) -> DenseVector:
        """Each feature's share of the gains of all cuts."""
        return DenseVector(json.loads(self.getOrDefault("trees"))["importance"])

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Margins of rows of feature values."""
        return _margins(json.loads(self.getOrDefault("trees")), x)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = dataset.sparkSession.sparkContext.broadcast(json.loads(self.getOrDefault("trees")))

        @pandas_udf("array<double>")
        def probabilities(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            return pd.Series(list(softmax(_margins(trees.value, np.stack(vectors.to_numpy()).astype(float)))))

        array = vector_to_array(self.getOrDefault("featuresCol"))
        return (dataset.withColumn("probability", array_to_vector(probabilities(array)))
                .withColumn("prediction", (F.array_position(vector_to_array("probability"),
                                                            F.array_max(vector_to_array("probability"))) - 1).cast("double")))


def _margins(grown: dict, x: np.ndarray) -> np.ndarray:
    out = np.tile(np.asarray(grown["start"], float)[:, None], len(x)).T
    x = np.ascontiguousarray(x.T)
    for trees in grown["rounds"]:
        for k, columns in enumerate(trees):
            tree = Tree(**columns)
            out[:, k] += np.asarray(tree.value)[tree.place(x, tree.threshold)]
    return out
