"""Model training, cross-validation, random search, persistence and scoring
with Spark ML (``Pipeline`` of ``VectorAssembler`` + classifier).

Inputs are model matrices ``(key, features..., label)``; predictions come
back as ``(key, label, prediction, score, scores[])`` so the evaluation
operators apply unchanged.
"""

from __future__ import annotations

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import balance, boosting, encode, evaluate, forest, recode, split, svm

# Default hyper-parameters of the reference models.
RF_DEFAULTS = dict(maxBins=64, numTrees=100, maxDepth=30, featureSubsetStrategy="sqrt", bootstrap=True, seed=42)
GBT_DEFAULTS = dict(maxIter=100, stepSize=0.1, maxDepth=3, subsamplingRate=1.0, seed=42)
SVM_DEFAULTS = dict(C=10.496, gamma=2.912, tol=0.01)

# Random-search spaces (uniform ranges are [lo, lo + width], integers [lo, hi)).
# A depth of None (no limit) is 30, the deepest tree Spark grows; deeper choices are cut to it.
GBT_SPACE = {"maxIter": ("int", 50, 300), "stepSize": ("uniform", 0.01, 0.3), "maxDepth": ("int", 3, 10),
             "minInstancesPerNode": ("int", 1, 10), "subsamplingRate": ("uniform", 0.6, 0.4)}
SVM_SPACE = {"C": ("uniform", 0.001, 30.0), "gamma": ("uniform", 0.0001, 20.0)}
RF_SPACE = {"numTrees": ("int", 50, 300), "maxDepth": ("choice", [30, 10, 20, 30, 30, 30]),
            "minInstancesPerNode": ("int", 1, 10), "bootstrap": ("choice", [True, False]),
            "featureSubsetStrategy": ("choice", ["sqrt", "log2", "all", "0.3", "0.5", "0.7"])}
SEARCH_SCORE = {"GradientBoosting": "roc_auc", "SVM": "recall", "RandomForest": "recall"}


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def _class_weights(df: DataFrame, label: str = "label") -> list[float]:
    """Weight of each class 0, 1, ... (one row a class)."""
    found = {int(r[label]): float(r["weight"]) for r in encode.class_weights(df.filter(F.col(label).isNotNull()), label).collect()}
    return [found.get(c, 1.0) for c in range(max(found, default=-1) + 1)]


#: Iterations of the linear SVM (``maxIter`` in params overrides it).
SVM_MAX_ITER = 100


def degree_two_weights(p: int, gamma: float) -> list[float]:
    """Factors that turn Spark's degree-2 expansion (for each i: x_i, then
    x_0 x_i ... x_i x_i) into the feature map of the kernel (gamma x.y)^2:
    squares by gamma, cross terms by sqrt(2) gamma, linear terms dropped."""
    out = []
    for i in range(p):
        out += [0.0, *[math.sqrt(2.0) * gamma] * i, gamma]
    return out


def build(model: str, features: list[str], multiclass: bool, params: dict | None = None, n_rows: int | None = None,
          class_weights: list[float] | None = None) -> Pipeline:
    """Unfitted pipeline; ``n_rows`` sets the SVM's 1 / (C n) where it is not
    the rows of the fit, ``class_weights`` weigh the forest's rows."""
    params = dict(params or {})
    stages = [_assembler(features)]
    if model == "RandomForest":
        p = {**RF_DEFAULTS, **params}
        stages.append(forest.RandomForest(featureNames=features, classWeights=class_weights, **p))
    elif model == "GradientBoosting":
        p = {**GBT_DEFAULTS, **params}
        stages.append(boosting.MultinomialBoosting(featureNames=features, mostClasses=0 if multiclass else 2, **p))
    elif model == "SVM":
        p = {**SVM_DEFAULTS, **params}
        stages.append(svm.QuadraticSVM(numFeatures=len(features), gamma=float(p["gamma"]), C=float(p["C"]), tol=p["tol"],
                                       maxIter=p.get("maxIter", SVM_MAX_ITER), multiclass=multiclass,
                                       **({} if n_rows is None else {"regParam": 1.0 / (p["C"] * max(1, n_rows))})))
    else:
        raise ValueError(f"unknown model {model!r}")
    return Pipeline(stages=stages)


def fit(matrix: DataFrame, features: list[str], model: str = "RandomForest",
        multiclass: bool = False, params: dict | None = None) -> PipelineModel:
    if model == "SVM":
        return _fit_svm(matrix, features, multiclass, params)
    if model != "RandomForest":
        return build(model, features, multiclass, params).fit(matrix)   # boosting caches its own input
    # read several times: by the weights, the cuts and the binning
    data = matrix.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return build(model, features, multiclass, params, class_weights=_class_weights(data)).fit(data)
    finally:
        data.unpersist()


def _fit_svm(matrix: DataFrame, features: list[str], multiclass: bool, params: dict | None, folds: int = 3) -> PipelineModel:
    """Linear SVM on the degree-2 map; in binary mode a logistic unit fitted on
    out-of-fold margins turns margins into probabilities.  The folds' fits and
    that of all rows share each pass over the rows."""
    pipeline = build("SVM", features, multiclass, params)
    if multiclass:
        return pipeline.fit(matrix)
    assembler, estimator = pipeline.getStages()
    draw = split.uniform(F.lit("platt"), *[F.col(c) for c in matrix.columns if c not in features and c != "label"])
    folded = assembler.transform(matrix).select("label", "features", F.floor(draw * folds).cast("int").alias("_fold"))
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        *parts, whole = estimator.fitted(folded, F.col("_fold"), folds)
        margins = None
        for f, part in enumerate(parts):
            if part is None:
                continue
            m = part.transform(folded.filter(F.col("_fold") == f)).select("label", "rawPrediction")
            margins = m if margins is None else margins.unionByName(m)
        if margins is None:
            return PipelineModel(stages=[assembler, whole])
        platt = LogisticRegression(labelCol="label", featuresCol="rawPrediction", predictionCol="platt_prediction",
                                   rawPredictionCol="platt_margin", probabilityCol="probability").fit(margins)
        return PipelineModel(stages=[assembler, whole, platt])
    finally:
        folded.unpersist()


def predict(model: PipelineModel, df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, label, prediction, score, scores[]): score is the positive-class
    probability (binary) or the predicted class probability."""
    out = model.transform(df)
    if "probability" in out.columns:
        probs = vector_to_array("probability")
    else:
        # margins only (SVM, one-vs-rest): logistic link for two classes,
        # softmax-normalised scores otherwise
        raw = vector_to_array("rawPrediction")
        two = F.array(F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.exp(-raw[1])),
                      F.lit(1.0) / (F.lit(1.0) + F.exp(-raw[1])))
        ex = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))  # the largest margin becomes 1: no overflow
        soft = F.transform(ex, lambda x: x / F.aggregate(ex, F.lit(0.0), lambda a, b: a + b))
        probs = F.when(F.size(raw) == 2, two).otherwise(soft)
    out = out.select(key, *(["label"] if "label" in df.columns else []),
                     F.col("prediction").cast("int").alias("prediction"), probs.alias("scores"))
    score = F.when(F.size("scores") == 2, F.col("scores")[1]).otherwise(F.array_max("scores"))
    return out.withColumn("score", score)


def feature_importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """(feature, importance, rank) from a tree model."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    clf = model.stages[-1]
    imp = clf.featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


#: Features a report lists.
REPORTED = 10


def report(metrics: DataFrame, importances: DataFrame, k: int = REPORTED) -> DataFrame:
    """(section, rank, name, value): a model's metrics, then its k most
    important features in order."""
    lines = metrics.select(F.lit("metric").alias("section"), F.lit(None).cast("int").alias("rank"),
                           F.col("metric").alias("name"), F.col("value").cast("double").alias("value"))
    top = importances.filter(F.col("rank") <= k).select(
        F.lit("feature").alias("section"), F.col("rank").cast("int").alias("rank"), F.col("feature").alias("name"),
        F.col("importance").alias("value"))
    return lines.unionByName(top)


def balanced(matrix: DataFrame, features: list[str], mode: str = "binario", key: str = "row_id", seed: int = 42) -> DataFrame:
    """The matrix (key, features..., label) after the balancing policy, with
    is_synthetic; missing and infinite features are 0 beforehand."""
    filled = recode.fill_and_finite(matrix, features, key)
    vector = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    rows = balance.balance(filled.select(F.col(key).alias("row_id"), "label", vector.alias("vector")), mode, seed=seed)
    return rows.select(F.col("row_id").alias(key), *[F.col("vector")[i].alias(c) for i, c in enumerate(features)],
                       "label", "is_synthetic")


def holdout(matrix: DataFrame, key: str = "row_id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the stratified 80/20 split, which is made once; rows without a label are in neither."""
    sp = materialize(split.stratified_split(matrix.filter(F.col("label").isNotNull()), "label", key, 0.2, seed))
    return tuple(sp.filter(F.col("split") == s).drop("split") for s in ("train", "test"))


def train_test(matrix: DataFrame, features: list[str], mode: str = "binario", key: str = "row_id", seed: int = 42,
               balance_scope: str = "train") -> tuple[DataFrame, DataFrame]:
    """(train, test) of the stratified 80/20 split, missing and infinite features 0.

    ``balance_scope``: "train" (synthetic rows never reach the test part),
    "all" (balance before the split) or "none"."""
    if balance_scope not in ("train", "all", "none"):
        raise ValueError(f"unknown balance_scope {balance_scope!r}")
    matrix = recode.fill_and_finite(matrix, features, key)
    if balance_scope == "all":
        matrix = materialize(balanced(matrix, features, mode, key, seed).drop("is_synthetic"))
    train, test = holdout(matrix, key, seed)
    if balance_scope == "train":
        train = materialize(balanced(train, features, mode, key, seed).drop("is_synthetic"))
    return train, test


def fit_evaluate(train: DataFrame, test: DataFrame, features: list[str], model: str = "RandomForest",
                 mode: str = "binario", key: str = "row_id"):
    """Fit one part, score the other; returns (model, test predictions, tall metrics)."""
    m = fit(train, features, model, mode == "multiclase")
    pred = materialize(predict(m, test, key))   # read once by every metric
    return m, pred, metrics_table(pred, mode)


def train_evaluate(matrix: DataFrame, features: list[str], model: str = "RandomForest",
                   mode: str = "binario", key: str = "row_id", seed: int = 42, balance_scope: str = "train"):
    """Stratified 80/20 split, balance and fit the train part, score the test
    part; returns (model, test predictions, tall metrics).  ``balance_scope`` as
    in ``train_test``."""
    train, test = train_test(matrix, features, mode, key, seed, balance_scope)
    return fit_evaluate(train, test, features, model, mode, key)


def compare(matrix: DataFrame, features: list[str], names: list[str], mode: str = "binario", key: str = "row_id",
            seed: int = 42, balance_scope: str = "train") -> DataFrame:
    """(model, metric, value) of several models; all are fitted on the same
    balanced train part, which is made once."""
    train, test = train_test(matrix, features, mode, key, seed, balance_scope)
    out = None
    for name in names:
        _, _, metrics = fit_evaluate(train, test, features, name, mode, key)
        t = metrics.select(F.lit(name).alias("model"), "metric", "value")
        out = t if out is None else out.unionByName(t)
    return out


def metrics_table(pred: DataFrame, mode: str = "binario") -> DataFrame:
    """Tall (metric, value) table of headline metrics for predictions."""
    if mode == "binario":
        bm = evaluate.binary_metrics(pred)
        head = bm.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                             for m in ("accuracy", "precision", "recall", "f1")])).alias("t")).select("t.*")
        auc = evaluate.roc_auc(pred).select(F.lit("roc_auc").alias("metric"), F.col("auc").alias("value"))
        ap = evaluate.average_precision(pred).select(F.lit("pr_auc").alias("metric"),
                                                     F.col("average_precision").alias("value"))
        return head.unionByName(auc).unionByName(ap)
    mm = evaluate.macro_metrics(pred)
    head = mm.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                         for m in ("accuracy", "precision_macro", "recall_macro", "f1_macro")]))
                     .alias("t")).select("t.*")
    per = pred.select("label", F.posexplode("scores").alias("class", "s")).select(
        "class", (F.col("label") == F.col("class")).cast("int").alias("y"), "s")
    ovr = evaluate.roc_auc(per, "s", "y", by=["class"]).agg(F.avg("auc").alias("value"))
    return head.unionByName(ovr.select(F.lit("roc_auc_ovr_macro").alias("metric"), "value"))


def training_rows(folded: DataFrame, fold: int, features: list[str], mode: str, key: str, seed: int,
                  balance_scope: str = "train") -> DataFrame:
    """The rows outside a fold, balanced among themselves unless told "none"."""
    if balance_scope not in ("train", "none"):
        raise ValueError(f"unknown balance_scope {balance_scope!r}")
    rows = folded.filter(F.col("fold") != fold).drop("fold")
    return rows if balance_scope == "none" else materialize(balanced(rows, features, mode, key, seed).drop("is_synthetic"))


def cv_scores(matrix: DataFrame, features: list[str], model: str = "RandomForest",
              mode: str = "binario", key: str = "row_id", k: int = 5, seed: int = 42,
              balance_scope: str = "train") -> DataFrame:
    """Per-fold score (ROC-AUC binary, accuracy multi-class) on stratified
    folds.  Each fold's training rows are balanced on their own ("train"), so no
    synthetic row derives from a row it is scored on; "none" leaves them."""
    folded = materialize(split.stratified_folds(recode.fill_and_finite(matrix, features, key), "label", key, k, seed))
    out = None
    for f in range(k):
        m = fit(training_rows(folded, f, features, mode, key, seed, balance_scope), features, model, mode == "multiclase")
        pred = predict(m, folded.filter(F.col("fold") == f).drop("fold"), key)
        if mode == "binario":
            s = evaluate.roc_auc(pred).select(F.lit(f).alias("fold"), F.col("auc").alias("score"))
        else:
            s = pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score")).select(
                F.lit(f).alias("fold"), "score")
        out = s if out is None else out.unionByName(s)
    return out


def sample_params(space: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """Seeded random draws from a search space."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_iter):
        p = {}
        for name, (kind, *values) in space.items():
            p[name] = (rng.choice(values[0]) if kind == "choice" else rng.randrange(*values) if kind == "int"
                       else values[0] + rng.random() * values[1])
        out.append(p)
    return out


def _search_score(pred: DataFrame, mode: str, score: str) -> float:
    if mode != "binario":
        return float(evaluate.macro_metrics(pred).first()["recall_macro"])
    if score == "roc_auc":
        return float(evaluate.roc_auc(pred).first()["auc"])
    return float(evaluate.binary_metrics(pred).first()[score])


def random_search(matrix: DataFrame, features: list[str], model: str = "GradientBoosting",
                  space: dict | None = None, n_iter: int = 50, k: int = 5, mode: str = "binario",
                  key: str = "row_id", seed: int = 42, score: str | None = None, parallelism: int = 4,
                  balance_scope: str = "train") -> DataFrame:
    """Trials table (trial, params, mean_score, std_score, mean_train_score)
    over k folds.  Fits run side by side; the scores are the reference's
    (boosting: ROC-AUC, else recall; macro recall with four classes), and the
    4-class SVM is searched on standardised features."""
    space = space or {"GradientBoosting": GBT_SPACE, "SVM": SVM_SPACE, "RandomForest": RF_SPACE}[model]
    score = score or SEARCH_SCORE[model]
    matrix = recode.fill_and_finite(matrix, features, key)
    if model == "SVM" and mode == "multiclase":
        matrix = encode.fit_standard(matrix, features).apply(matrix)
    folded = materialize(split.stratified_folds(matrix, "label", key, k, seed))
    trials = sample_params(space, n_iter, seed)
    fitted_on = [training_rows(folded, f, features, mode, key, seed, balance_scope) for f in range(k)]

    def one(job: tuple[int, int]) -> tuple[float, float]:
        t, f = job
        train, test = fitted_on[f], folded.filter(F.col("fold") == f).drop("fold")
        m = fit(train, features, model, mode == "multiclase", trials[t])
        return (_search_score(predict(m, test, key), mode, score), _search_score(predict(m, train, key), mode, score))

    with ThreadPoolExecutor(parallelism) as pool:
        got = list(pool.map(one, [(t, f) for t in range(n_iter) for f in range(k)]))
    rows = []
    for t, p in enumerate(trials):
        test, train = zip(*got[t * k:(t + 1) * k])
        mean = sum(test) / k
        rows.append((t, json.dumps(p), mean, (sum((x - mean) ** 2 for x in test) / k) ** 0.5, sum(train) / k))
    return matrix.sparkSession.createDataFrame(
        rows, "trial int, params string, mean_score double, std_score double, mean_train_score double")


def search_report(matrix: DataFrame, features: list[str], trials: DataFrame, model: str, mode: str = "binario",
                  key: str = "row_id", seed: int = 42) -> DataFrame:
    """Metrics on the test split of the best trial's parameters, refitted:
    (params, metric, value)."""
    best = top_trials(trials, 1).first()["params"]
    train, test = holdout(recode.fill_and_finite(matrix, features, key), key, seed)
    train = materialize(balanced(train, features, mode, key, seed).drop("is_synthetic"))
    m = fit(train, features, model, mode == "multiclase", json.loads(best))
    return metrics_table(predict(m, test, key), mode).select(F.lit(best).alias("params"), "metric", "value")


def top_trials(trials: DataFrame, n: int = 5) -> DataFrame:
    """The n best trials with their rank; scores that agree to nine places tie,
    and the earlier trial comes first.  A search has one row a trial, so one
    task numbers them."""
    order = Window.orderBy(F.desc(F.round("mean_score", 9)), "trial")
    return trials.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).orderBy("rank")


def save(model: PipelineModel, path: str, params=None, metrics: DataFrame | None = None) -> str:
    """Write a fitted pipeline with all that scoring needs beside it: the
    matrix parameters (JSON) and the metrics table.  An empty pipeline is
    refused, and so is a path that exists."""
    if model is None or not getattr(model, "stages", None):
        raise ValueError("an empty model is not saved")
    model.write().save(f"{path}/pipeline")
    spark = metrics.sparkSession if metrics is not None else SparkSession.active()
    if params is not None:
        spark.createDataFrame([(params.to_json(),)], "value string").coalesce(1).write.text(f"{path}/params")
    if metrics is not None:
        metrics.write.parquet(f"{path}/metrics")
    return path


def load(path: str) -> PipelineModel:
    """The pipeline that ``save`` wrote."""
    return PipelineModel.load(f"{path}/pipeline")


def load_params(path: str):
    """The matrix parameters that ``save`` wrote."""
    from ..plans.matrix import MatrixParams
    return MatrixParams.from_json(SparkSession.active().read.text(f"{path}/params").first()["value"])


def load_named(root: str, names: list[str]) -> dict[str, PipelineModel]:
    """Saved models by name under one folder."""
    return {name: load(f"{root}/{name}") for name in names}
