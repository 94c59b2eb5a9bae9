"""Linear SVM on the feature map of the kernel (gamma x.y)^2, without the map.

A margin over the map's p (p + 1) / 2 products is a quadratic form x'Qx + b, so
tasks hold the p features alone: margins are one matrix product a chunk, and the
gradient of all products is the matrix X' diag(c) X.  All problems of a fit (one
a class, or one a fold and one of all rows) share each pass over the rows.

The objective is that of Spark's ``LinearSVC`` on the expanded map: mean hinge
loss plus half regParam times the squared coefficients of the products scaled to
unit deviation (products that do not vary get none), with a free intercept.  It
is minimised by L-BFGS on the driver, which holds only coefficients; a step's
sums come from one job.  It ends after ``max_iter`` steps, where the loss fell
by at most ``tol`` of its start over the last twenty, or with a small gradient.

Defined results: rows without a label take no part in the fit; features that are
missing or not finite are refused.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

#: Rows of a chunk.
CHUNK_ROWS = 4_096
#: Rows below which a further task is not worth its start.
ROWS_A_TASK = 50_000
#: Steps that L-BFGS remembers, losses that its end looks back on, trials along a direction at most.
MEMORY, LOOK_BACK, ENOUGH, TRIES = 10, 20, 5, 20
#: Share of its mean square below which a product's variance is rounding.
NO_VARIANCE = 1e-12


@dataclass
class Problem:
    """Rows of class ``positive`` against all others, without the rows of fold ``without``."""

    positive: int
    without: int | None = None


def pairs(p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(p)


def factors(p: int, gamma: float) -> np.ndarray:
    """Factors of the products x_i x_j (i <= j) in the map of the kernel."""
    i, j = pairs(p)
    return np.where(i == j, gamma, math.sqrt(2.0) * gamma)


def form(coefficients: np.ndarray, gamma: float, p: int) -> np.ndarray:
    """The symmetric Q with x'Qx the margin, less the intercept, of coefficients of the map."""
    i, j = pairs(p)
    out = np.zeros((p, p))
    out[i, j] = coefficients * factors(p, gamma) / np.where(i == j, 1.0, 2.0)
    out[j, i] = out[i, j]
    return out


def margins(x: np.ndarray, forms: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """(rows, problems) margins of rows of feature values."""
    n, p = x.shape
    wide = (x @ np.concatenate(list(forms), axis=1)).reshape(n, len(forms), p)
    return np.einsum("nmp,np->nm", wide, x) + intercepts


def chunks(batches, p: int):
    for batch in batches:
        for chunk in zip(*(batch.column(c) for c in ("x", "label", "fold"))):
            x, label, fold = (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(chunk, (np.float64, np.int32, np.int32)))
            yield x.reshape(-1, p), label, fold


def hinge_sums(batches, p: int, problems: list, points: list):
    """By problem: sums of the hinge losses, of their slopes, and of slope times
    x_i x_j (i <= j) over a task's rows."""
    i, j = pairs(p)
    forms, intercepts = np.array([q for q, _ in points]), np.array([b for _, b in points])
    out = np.zeros((len(problems), 2 + len(i)))
    for x, label, fold in chunks(batches, p):
        at = margins(x, forms, intercepts)
        for m, problem in enumerate(problems):
            sign = np.where(label == problem.positive, 1.0, -1.0)
            slack = 1.0 - sign * at[:, m]
            rows = np.flatnonzero((slack > 0) if problem.without is None else (slack > 0) & (fold != problem.without))
            held = x[rows]
            out[m, 0] += slack[rows].sum()
            out[m, 1] -= sign[rows].sum()
            out[m, 2:] -= (held.T @ (held * sign[rows, None]))[i, j]
    yield _cells(out)


def moment_sums(batches, p: int, folds: int):
    """By fold: rows, sums of x_i x_j and of its square (i <= j) over a task's rows."""
    i, j = pairs(p)
    out = np.zeros((folds, 1 + 2 * len(i)))
    for x, _, fold in chunks(batches, p):
        for f in range(folds):
            held = x[fold == f]
            square = held * held
            out[f, 0] += len(held)
            out[f, 1:1 + len(i)] += (held.T @ held)[i, j]
            out[f, 1 + len(i):] += (square.T @ square)[i, j]
    yield _cells(out)


def _cells(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["cell", "value"])


def _summed(rows: DataFrame, kernel, shape: tuple) -> np.ndarray:
    cells = rows.mapInArrow(kernel, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(math.prod(shape))
    out[np.asarray(cells.column("cell"))] = np.asarray(cells.column("value"))
    return out.reshape(shape)


def packed(df: DataFrame, vector: Column, label: str, fold: Column, p: int, tasks: int) -> DataFrame:
    """(x, label, fold): chunks of rows."""
    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
                if len(x) != p * part.num_rows or not np.isfinite(x).all():
                    raise ValueError("features must be finite numbers")
                blobs = [x, *(np.asarray(part.column(c)).astype(np.int32) for c in ("label", "fold"))]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in blobs], ["x", "label", "fold"])
    rows = df.select(vector.alias("x"), F.col(f"`{label}`").cast("int").alias("label"), fold.cast("int").alias("fold"))
    return rows.repartition(tasks).mapInArrow(pack, "x binary, label binary, fold binary")


def minimised(size: int, max_iter: int, tol: float):
    """L-BFGS as a coroutine: yields a point, takes (loss, gradient) there, and
    returns the best point.  Steps satisfy the Wolfe conditions (the weak ones, as
    the hinge has corners), after ``ENOUGH`` trials Armijo's alone; where none of
    ``TRIES`` does, the memory is dropped once, then it ends."""
    x = np.zeros(size)
    loss, grad = yield x
    start, losses, memory, dropped = loss, [loss], [], False
    for step_no in range(max_iter):
        if np.linalg.norm(grad) <= max(tol * loss, 1e-8):
            break
        direction, alphas = -grad, []
        for s, y in reversed(memory):
            a = (s @ direction) / (s @ y)
            alphas.append(a)
            direction = direction - a * y
        if memory:
            s, y = memory[-1]
            direction = direction * ((s @ y) / (y @ y))
        for (s, y), a in zip(memory, reversed(alphas)):
            direction = direction + (a - (y @ direction) / (s @ y)) * s
        slope = grad @ direction
        alpha = 1.0 if memory else 1.0 / max(1.0, np.linalg.norm(grad))
        low, high, armijo = 0.0, math.inf, None
        for tried in range(TRIES):
            to = x + alpha * direction
            to_loss, to_grad = yield to
            along = to_grad @ direction
            if to_loss > loss + 1e-4 * alpha * slope:
                high = alpha
            else:
                if armijo is None or to_loss < armijo[1]:
                    armijo = to, to_loss, to_grad
                if along >= 0.9 * slope or tried >= ENOUGH:
                    break
                low = alpha
            alpha = 2.0 * low if math.isinf(high) else (low + high) / 2.0
        if armijo is None:
            if dropped or not memory:
                break
            memory, dropped = [], True
            continue
        to, to_loss, to_grad = armijo
        s, y = to - x, to_grad - grad
        if s @ y > 1e-12 * (y @ y):
            memory = [*memory, (s, y)][-MEMORY:]
        x, loss, grad = to, to_loss, to_grad
        losses = [*losses, loss][-LOOK_BACK:]
        if abs(loss - max(losses)) <= tol * start:
            break
    return x


def solve(df: DataFrame, vector: Column, p: int, problems: list[Problem], gamma: float, c: float, tol: float, max_iter: int,
          label: str = "label", fold: Column | None = None, folds: int = 1, reg: float | None = None) -> list[dict]:
    """A {"form", "intercept", "rows"} for every problem; regParam is 1 / (C n), n the problem's rows, unless given."""
    df = df.filter(F.col(f"`{label}`").isNotNull())
    total = df.count()
    if not total:
        raise ValueError("no labelled rows")
    rows = packed(df, vector, label, F.lit(0) if fold is None else fold, p,
                  max(1, math.ceil(total / ROWS_A_TASK))).persist(StorageLevel.MEMORY_AND_DISK)
    weight = factors(p, gamma)
    d = len(weight)
    try:
        moments = _summed(rows, lambda batches: moment_sums(batches, p, folds), (folds, 1 + 2 * d))
        runs = []
        for problem in problems:
            m = sum(moments[f] for f in range(folds) if f != problem.without)
            n = max(1.0, m[0])
            mean, square = weight * m[1:1 + d] / n, weight ** 2 * m[1 + d:] / n
            variance = (square - mean ** 2) * n / max(1.0, n - 1)
            spread = np.sqrt(np.where(variance > NO_VARIANCE * square, variance, 0.0))
            inverse = np.divide(1.0, spread, out=np.zeros(d), where=spread > 0)
            search = minimised(d + 1, max_iter, tol)
            runs.append({"n": n, "mean": mean, "inverse": inverse, "reg": reg if reg is not None else 1.0 / (c * n),
                         "search": search, "at": next(search), "done": m[0] == 0})

        def plain(run):
            a = run["at"][:d] * run["inverse"]
            return form(a, gamma, p), float(run["at"][d] - a @ run["mean"])
        while any(not run["done"] for run in runs):
            open_ = [i for i, run in enumerate(runs) if not run["done"]]
            asked, points = [problems[i] for i in open_], [plain(runs[i]) for i in open_]
            sums = _summed(rows, lambda batches: hinge_sums(batches, p, asked, points), (len(open_), 2 + d))
            for i, got in zip(open_, sums):
                run = runs[i]
                w, n = run["at"][:d], run["n"]
                gradient = (weight * got[2:] - got[1] * run["mean"]) * run["inverse"] / n + run["reg"] * w
                try:
                    run["at"] = run["search"].send((got[0] / n + run["reg"] / 2.0 * (w @ w), np.append(gradient, got[1] / n)))
                except StopIteration as end:
                    run["at"], run["done"] = end.value, True
        return [dict(zip(("form", "intercept", "rows"), (*plain(run), run["n"]))) for run in runs]
    finally:
        rows.unpersist()


class QuadraticSVM(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of the SVM: class 1 against 0, or with ``multiclass`` each
    class against all others.  A ``regParam`` of 0 or more goes before 1 / (C n)."""

    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of the features", TypeConverters.toString)
    numFeatures = Param(Params._dummy(), "numFeatures", "length of the vector", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "factor of the kernel", TypeConverters.toFloat)
    C = Param(Params._dummy(), "C", "weight of the losses", TypeConverters.toFloat)
    regParam = Param(Params._dummy(), "regParam", "weight of the squared coefficients", TypeConverters.toFloat)
    tol = Param(Params._dummy(), "tol", "tolerance of the search", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "steps of the search", TypeConverters.toInt)
    multiclass = Param(Params._dummy(), "multiclass", "each class against all others", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, labelCol="label", featuresCol="features", numFeatures=None, gamma=1.0, C=1.0, regParam=-1.0,
                 tol=0.01, maxIter=100, multiclass=False):
        super().__init__()
        self._setDefault(labelCol="label", featuresCol="features", gamma=1.0, C=1.0, regParam=-1.0, tol=0.01, maxIter=100,
                         multiclass=False)
        self._set(**self._input_kwargs)

    def fitted(self, dataset: DataFrame, fold: Column | None = None, folds: int = 0) -> list["QuadraticSVMModel | None"]:
        """One model without each fold (None where the others hold a single class), then the model of all rows."""
        get = self.getOrDefault
        label = get("labelCol")
        seen = (dataset.filter(F.col(f"`{label}`").isNotNull())
                .groupBy((F.lit(0) if fold is None else fold).cast("int").alias("fold"), F.col(f"`{label}`").cast("int").alias("label"))
                .count().collect())      # folds x classes
        classes = {r["label"] for r in seen}
        if not classes:
            raise ValueError("no labelled rows")
        if min(classes) < 0 or not get("multiclass") and max(classes) > 1:
            raise ValueError(f"labels {sorted(classes)} are not 0 and 1" if not get("multiclass") else "labels must be 0, 1, ...")
        if get("multiclass"):
            groups = [[Problem(k) for k in range(max(2, max(classes) + 1))]]
        else:
            two = [len({r["label"] for r in seen if r["fold"] != f}) > 1 for f in range(folds)]
            groups = [[Problem(1, f)] if ok else [] for f, ok in enumerate(two)] + [[Problem(1)]]
        reg = get("regParam")
        found = iter(solve(dataset, vector_to_array(F.col(get("featuresCol"))), get("numFeatures"), sum(groups, []), get("gamma"),
                           get("C"), get("tol"), get("maxIter"), label, fold, max(1, folds), reg if reg >= 0 else None))
        out = []
        for group in groups:
            got = [next(found) for _ in group]
            out.append(QuadraticSVMModel(forms=json.dumps([{"form": g["form"].tolist(), "intercept": g["intercept"]} for g in got]),
                                         featuresCol=get("featuresCol"), multiclass=get("multiclass")) if got else None)
        return out

    def _fit(self, dataset: DataFrame) -> "QuadraticSVMModel":
        return self.fitted(dataset)[-1]


class QuadraticSVMModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction`` (the margins of both classes, or of each class
    against the others) and ``prediction``: the class with the greatest margin, the smaller class on ties."""

    forms = Param(Params._dummy(), "forms", "quadratic forms and intercepts as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of the features", TypeConverters.toString)
    multiclass = Param(Params._dummy(), "multiclass", "each class against all others", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, forms=None, featuresCol="features", multiclass=False):
        super().__init__()
        self._setDefault(featuresCol="features", multiclass=False)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        got, multi = json.loads(self.getOrDefault("forms")), self.getOrDefault("multiclass")
        forms, intercepts = np.array([g["form"] for g in got]), np.array([g["intercept"] for g in got])

        @pandas_udf("array<double>")
        def raw(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            at = margins(np.stack(vectors.to_numpy()).astype(float), forms, intercepts)
            return pd.Series(list(at if multi else np.column_stack([-at[:, 0], at[:, 0]])))

        out = dataset.withColumn("rawPrediction", array_to_vector(raw(vector_to_array(F.col(self.getOrDefault("featuresCol"))))))
        held = vector_to_array("rawPrediction")
        return out.withColumn("prediction", (F.array_position(held, F.array_max(held)) - 1).cast("double"))
