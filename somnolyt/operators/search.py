"""Random search over linear rules: all trials and folds in one aggregation.

A trial draws a direction w and a share s.  Fitted on the training folds, its
threshold lies the share s of the way from class 0's mean score to class 1's
(the score of a row is w.x); rows on class 1's side are predicted 1.

The class means of all folds' scores follow from one sum of vectors per (fold,
class), whatever the trials, and one more pass counts (trial, fold, part, label,
prediction) for every trial and fold at once: a task multiplies its rows by all
directions and sends one small table of counts.  No trial costs a scan of its own.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import split


def drawn(*parts) -> float:
    """The md5 draw of ``split.uniform`` for plain values."""
    text = "|".join(map(str, parts))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / split.TWO32


def linear_trials(n_iter: int, width: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(directions, shares): weights in [-1, 1), shares in [0, 1)."""
    w = np.array([[2 * drawn(seed, t, p, "weight") - 1 for p in range(width)] for t in range(n_iter)])
    return w, np.array([drawn(seed, t, "share") for t in range(n_iter)])


def _vectors(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def class_sums(folded: DataFrame, vector: str, label: str) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """{(fold, label): (rows, sum of vectors)}; one row per pair reaches the driver."""
    def task(batches):
        sums: dict = {}
        for batch in batches:
            x, fold, y = _vectors(batch, 2), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for f, c in {*zip(fold.tolist(), y.tolist())}:
                rows = x[(fold == f) & (y == c)]
                n, total = sums.get((f, c), (0, 0.0))
                sums[f, c] = n + len(rows), total + rows.sum(axis=0)
        yield pa.RecordBatch.from_pylist([{"fold": f, "label": c, "n": n, "total": t} for (f, c), (n, t) in sums.items()], schema=pa.schema(
            [("fold", pa.int32()), ("label", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))]))
    parts = folded.select("fold", F.col(label).cast("int"), vector).mapInArrow(task, "fold int, label int, n long, total array<double>")
    rows = parts.select("fold", "label", "n", F.posexplode("total").alias("pos", "x")).groupBy("fold", "label", "pos").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("fold", "label", "pos").collect()
    out: dict = {}
    for r in rows:
        out.setdefault((r["fold"], r["label"]), (r["n"], []))[1].append(r["x"])
    return {key: (n, np.array(x)) for key, (n, x) in out.items()}


def fitted(sums: dict, w: np.ndarray, share: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(thresholds, signs) of every (trial, fold), fitted on the other folds."""
    threshold, sign = np.zeros((len(w), k)), np.ones((len(w), k))
    for f in range(k):
        mean = []
        for c in (0, 1):
            kept = [sums[g, c] for g in range(k) if g != f and (g, c) in sums]
            if not kept:
                raise ValueError(f"no rows of class {c} outside fold {f}")
            mean.append(w @ (sum(x for _, x in kept) / sum(n for n, _ in kept)))
        threshold[:, f] = mean[0] + share * (mean[1] - mean[0])
        sign[:, f] = np.where(mean[1] >= mean[0], 1.0, -1.0)
    return threshold, sign


def trial_counts(folded: DataFrame, vector: str, label: str, w: np.ndarray, threshold: np.ndarray, sign: np.ndarray) -> DataFrame:
    """(trial, fold, part, label, prediction, n) in one pass; part is ``test``
    for the fold's own rows and ``train`` for the others."""
    k = threshold.shape[1]

    def task(batches):
        counts = np.zeros((k, k, 2, 2, len(w)), np.int64)  # fitted fold, row's fold, label, prediction, trial
        for batch in batches:
            z = _vectors(batch, 2) @ w.T
            cell = 2 * batch.column(0).to_numpy().astype(np.int64) + batch.column(1).to_numpy()
            for f in range(k):
                said = (sign[:, f] * z >= sign[:, f] * threshold[:, f])
                for c in np.unique(cell).tolist():
                    rows = said[cell == c]
                    counts[f, c // 2, c % 2, 1] += rows.sum(axis=0)
                    counts[f, c // 2, c % 2, 0] += (~rows).sum(axis=0)
        f, g, c, p, t = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in (t, f, g, c, p)), pa.array(counts[f, g, c, p, t])],
                                         names=["trial", "fold", "row_fold", "label", "prediction", "n"])
    rows = folded.select("fold", F.col(label).cast("int"), vector).mapInArrow(
        task, "trial int, fold int, row_fold int, label int, prediction int, n long")
    part = F.when(F.col("fold") == F.col("row_fold"), "test").otherwise("train")
    return rows.groupBy("trial", "fold", part.alias("part"), "label", "prediction").agg(F.sum("n").alias("n"))


def linear_search(rows: DataFrame, n_iter: int = 50, k: int = 5, seed: int = 42, key: str = "row_id",
                  label: str = "label", vector: str = "vector") -> DataFrame:
    """Trials table (trial, params, mean_score, std_score, mean_train_score):
    macro recall over k stratified folds (std with divisor k).  Rows without a
    0/1 label or with a missing or uneven vector take no part."""
    base = rows.filter(F.col(label).isin(0, 1) & F.col(vector).isNotNull())
    width = base.agg(F.max(F.size(vector))).first()[0]
    if not width:
        raise ValueError("no labelled vectors to search on")
    base = base.filter((F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    folded = split.stratified_folds(base.select(key, label, F.col(vector).cast("array<double>").alias(vector)), label, key, k, seed)
    w, share = linear_trials(n_iter, width, seed)
    threshold, sign = fitted(class_sums(folded, vector, label), w, share, k)
    counts = trial_counts(folded, vector, label, w, threshold, sign)
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    recall = counts.groupBy("trial", "fold", "part", "label").agg((right / F.sum("n")).alias("recall"))
    score = recall.groupBy("trial", "fold", "part").agg(F.avg("recall").alias("score"))
    test, train = (F.when(F.col("part") == part, F.col("score")) for part in ("test", "train"))
    found = score.groupBy("trial").agg(F.avg(test).alias("mean_score"), F.stddev_pop(test).alias("std_score"),
                                       F.avg(train).alias("mean_train_score"))
    params = rows.sparkSession.createDataFrame(
        [(t, json.dumps({"share": round(float(share[t]), 6)})) for t in range(n_iter)], "trial int, params string")
    return found.join(F.broadcast(params), "trial").select("trial", "params", "mean_score", "std_score", "mean_train_score")  # n_iter rows
