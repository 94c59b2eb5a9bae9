"""Evaluation as DataFrame aggregations over ``(row_id, label, score,
prediction)`` (binary) or ``(row_id, label, scores[], prediction)``.

Curves need running sums over scores in descending order.  A window without
a partition key would move every row to one task, so ``running_counts``
first collapses rows to distinct scores, then numbers them inside score
buckets of about equally many rows and adds the running total of earlier buckets (a table of
buckets x groups rows).  AUC and average precision are written with running
sums only (no ``lag``), so they never need a global order either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import even_buckets, sent


def running_counts(df: DataFrame, score: str = "score", label: str = "label",
                   by: list[str] | None = None) -> DataFrame:
    """Per (group, distinct score): pos, neg, and cumulative tp / fp over
    scores >= this one, plus group totals P and N.  Rows without a score or a
    label have no place on a curve and are left out."""
    by = by or []
    scored = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    d = scored.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("pos"),
                                       F.count_if(F.col(label) != 1).alias("neg"))
    d = d.withColumn("_b", -even_buckets(scored, score))  # ascending bucket == descending score
    inner = (Window.partitionBy(*by, "_b").orderBy(F.desc(score))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.select("*", F.sum("pos").over(inner).alias("_tp"), F.sum("neg").over(inner).alias("_fp"))
    tot = d.groupBy(*by, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # buckets x groups rows: bounded by the buckets of a group
    tot = tot.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_b"])],
                     F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_op"),
                     F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_on"),
                     F.sum("_bp").over(group).alias("P"), F.sum("_bn").over(group).alias("N"))
    same = F.lit(True)
    for i, c in enumerate([*by, "_b"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = d.join(tot, same)
    return out.select(*by, score, "pos", "neg",
                      (F.col("_tp") + F.col("_op")).alias("tp"),
                      (F.col("_fp") + F.col("_on")).alias("fp"), "P", "N")


def _with_end_point(rc: DataFrame, by: list[str], score: str, names: tuple[str, str],
                    point: tuple, end: tuple[float, float]) -> DataFrame:
    """(by..., threshold, two values) per row of ``rc``; the row of the highest
    score of a group also yields the group's end point (threshold NULL)."""
    def row(threshold, a, b):
        return F.struct(threshold.cast("double").alias("threshold"), a.alias(names[0]), b.alias(names[1]))
    own = row(F.col(score), *point)
    extra = row(F.lit(None), F.lit(end[0]), F.lit(end[1]))
    highest = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    return rc.select(*by, F.explode(F.when(highest, F.array(own, extra)).otherwise(F.array(own))).alias("_p")).select(
        *by, "_p.*")


def roc_curve(df: DataFrame, score="score", label="label", by=None) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, plus the (NULL, 0, 0) start."""
    by = by or []
    return _with_end_point(running_counts(df, score, label, by), by, score, ("fpr", "tpr"),
                           (F.try_divide(F.col("fp"), F.col("N")), F.try_divide(F.col("tp"), F.col("P"))), (0.0, 0.0))


def roc_auc(df: DataFrame, score="score", label="label", by=None) -> DataFrame:
    """Trapezoid AUC == P(score_pos > score_neg) + 0.5 P(tie), from running sums."""
    by = by or []
    rc = running_counts(df, score, label, by)
    contrib = F.col("pos") * (F.col("N") - F.col("fp") + F.lit(0.5) * F.col("neg"))
    g = rc.groupBy(*by) if by else rc.groupBy()
    return g.agg(F.try_divide(F.sum(contrib), F.first("P") * F.first("N")).alias("auc"))


def pr_curve(df: DataFrame, score="score", label="label", by=None) -> DataFrame:
    """(threshold, precision, recall) per distinct score plus the closing (1, 0)."""
    by = by or []
    return _with_end_point(running_counts(df, score, label, by), by, score, ("precision", "recall"),
                           (F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")),
                            F.try_divide(F.col("tp"), F.col("P"))), (1.0, 0.0))


def average_precision(df: DataFrame, score="score", label="label", by=None) -> DataFrame:
    """sum over distinct scores (descending) of (R_n - R_n-1) * P_n."""
    by = by or []
    rc = running_counts(df, score, label, by)
    term = F.try_divide(F.col("pos"), F.col("P")) * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    g = rc.groupBy(*by) if by else rc.groupBy()
    return g.agg(F.sum(term).alias("average_precision"))


def _judged(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """The rows with a label and a prediction; a missing one is no class."""
    return df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())


def binary_metrics(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """accuracy and class-1 precision / recall / F1 (0 when undefined), over
    the n rows with a label and a prediction."""
    df = _judged(df, label, prediction)
    y, p = F.col(label), F.col(prediction)
    tp, fp, fn = (F.count_if((y == 1) & (p == 1)), F.count_if((y != 1) & (p == 1)),
                  F.count_if((y == 1) & (p != 1)))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return df.agg(F.avg((y == p).cast("double")).alias("accuracy"),
                  ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                  ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """(class, tp, n_true, n_pred, precision, recall, f1) over the union of
    true and predicted classes.  Rows without a label or a prediction are left out."""
    df = _judged(df, label, prediction)
    true = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n_true"),
                                                       F.count_if(F.col(label) == F.col(prediction)).alias("tp"))
    pred = df.groupBy(F.col(prediction).alias("class")).agg(F.count(F.lit(1)).alias("n_pred"))
    j = true.join(pred, "class", "full_outer").fillna(0, ["n_true", "tp", "n_pred"])
    return j.select("class", "tp", "n_true", "n_pred",
                    F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0).alias("precision"),
                    F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0).alias("recall"),
                    F.when(F.col("n_true") + F.col("n_pred") > 0,
                           2 * F.col("tp") / (F.col("n_true") + F.col("n_pred"))).otherwise(0.0).alias("f1"))


def macro_metrics(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    pc = per_class(df, label, prediction)
    return pc.agg((F.sum("tp") / F.sum("n_true")).alias("accuracy"),
                  F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
                  F.avg("f1").alias("f1_macro"))


def classification_report(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """Per class rows, then accuracy, macro avg and weighted avg."""
    pc = per_class(df, label, prediction)  # one row a class
    rows = pc.select(F.col("class").cast("string").alias("row"), "precision", "recall", "f1",
                     F.col("n_true").alias("support"))
    total = F.sum("n_true")
    acc = pc.agg(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), (F.sum("tp") / total).alias("f1"),
                 total.alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("row"),
                      *[(F.sum(F.col(m) * F.col("n_true")) / total).alias(m) for m in ("precision", "recall", "f1")],
                      total.alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def confusion_matrix(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """(label, prediction, n) over classes x classes, zero cells kept.

    One grouped count gives the filled cells; the classes found in it span the
    grid of cells, which is the size of the result.  A missing label or
    prediction is no class and its rows are left out."""
    cells = (_judged(df, label, prediction)
             .groupBy(F.col(label).cast("long").alias("label"), F.col(prediction).cast("long").alias("prediction"))
             .agg(F.count(F.lit(1)).alias("n")))
    classes = cells.select(F.explode(F.array("label", "prediction")).alias("c")).agg(F.collect_set("c").alias("cs"))
    grid = (classes.select(F.explode("cs").alias("label"), "cs")
            .select("label", F.explode("cs").alias("prediction")))
    return grid.join(cells, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_matrix_normalized(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    cm = confusion_matrix(df, label, prediction)
    row = Window.partitionBy("label")
    return cm.select("label", "prediction", "n",
                     (F.col("n") / F.sum("n").over(row)).alias("rate"))


def top_confusions(df: DataFrame, label="label", prediction="prediction", k: int = 2) -> DataFrame:
    """Per true class: correct / total and its top-k wrong predictions."""
    cm = confusion_matrix(df, label, prediction)
    row = Window.partitionBy("label")
    cm = cm.select("*", F.sum("n").over(row).alias("total"),
                   F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).over(row).alias("correct"))
    w = Window.partitionBy("label").orderBy(F.desc("n"), F.asc("prediction"))
    off = cm.filter((F.col("label") != F.col("prediction")) & (F.col("n") > 0))
    return off.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "label", "rank", "prediction", "n", "correct", "total")


def cv_summary(scores: DataFrame, value: str = "auc") -> DataFrame:
    """Mean, min, max and quartiles of per-fold scores."""
    return scores.agg(F.count(F.lit(1)).alias("n_folds"), F.avg(value).alias("mean"),
                      F.min(value).alias("min"), F.max(value).alias("max"),
                      F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.5).alias("median"),
                      F.percentile(value, 0.75).alias("q3"))


def score_histogram(df: DataFrame, score: str = "score", by: list[str] | None = None,
                    bins: int = 30) -> DataFrame:
    """Density histogram of scores per group, each group over its own range.
    Rows without a score are left out; a missing group is a group.  The range
    table has one row per group; without groups it is a single row."""
    by = by or []
    rows = df.filter(F.col(score).isNotNull())
    st = rows.groupBy(*by).agg(F.min(score).alias("_mn"), F.max(score).alias("_mx"))
    st = st.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_mn",
                   F.when(F.col("_mx") > F.col("_mn"), F.col("_mx") - F.col("_mn")).otherwise(F.lit(1.0)).alias("_span"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    j = rows.join(sent(st), same)
    b = F.least(F.floor((F.col(score) - F.col("_mn")) / F.col("_span") * bins).cast("int"), F.lit(bins - 1))
    c = j.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("_mn").alias("_mn"),
                                            F.first("_span").alias("_span"))
    width = F.col("_span") / F.lit(bins)
    grp = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return c.select(*by, "bin", (F.col("_mn") + F.col("bin") * width).alias("lower"),
                    (F.col("_mn") + (F.col("bin") + 1) * width).alias("upper"), "n",
                    (F.col("n") / (F.sum("n").over(grp) * width)).alias("density"))
