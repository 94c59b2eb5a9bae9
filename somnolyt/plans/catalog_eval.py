"""Evaluation queries over a deterministic score (labels joined to documents),
so metric logic is checked against SQL without a learned model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import split
from ..sources import cohort as src
from .registry import query

# Deterministic score rule (ours) for metric checks.
SCORED_SQL = """scored AS (
SELECT l.doc_id AS row_id, l.quality AS label,
  CAST((d.n_chars * 7919) % 1000 AS DOUBLE) / 1000 AS score,
  CAST(CAST((d.n_chars * 7919) % 1000 AS DOUBLE) / 1000 >= 0.5 AS INTEGER) AS prediction
FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

MULTI_SQL = """mw AS (
SELECT l.doc_id AS row_id, CAST(l.quality * 2 + l.toxic AS INTEGER) AS label,
  (d.n_chars * 3 * 7919) % 97 + 1 AS w0, (d.n_chars * 4 * 7919) % 97 + 1 AS w1,
  (d.n_chars * 5 * 7919) % 97 + 1 AS w2, (d.n_chars * 6 * 7919) % 97 + 1 AS w3
FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
multi AS (
SELECT row_id, label,
  CAST(w0 AS DOUBLE) / (w0 + w1 + w2 + w3) AS p0, CAST(w1 AS DOUBLE) / (w0 + w1 + w2 + w3) AS p1,
  CAST(w2 AS DOUBLE) / (w0 + w1 + w2 + w3) AS p2, CAST(w3 AS DOUBLE) / (w0 + w1 + w2 + w3) AS p3,
  CASE WHEN w0 >= w1 AND w0 >= w2 AND w0 >= w3 THEN 0 WHEN w1 >= w2 AND w1 >= w3 THEN 1
       WHEN w2 >= w3 THEN 2 ELSE 3 END AS prediction
FROM mw)"""


def _joined(spark, sf_dir):
    labels = src.table(spark, sf_dir, "labels")
    docs = src.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id")


def scored_binary(spark, sf_dir):
    j = _joined(spark, sf_dir)
    score = ((F.col("n_chars") * 7919) % 1000).cast("double") / 1000
    return j.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"),
                    score.alias("score"), (score >= 0.5).cast("int").alias("prediction"))


def scored_multi(spark, sf_dir):
    j = _joined(spark, sf_dir)
    w = [((F.col("n_chars") * (c + 3) * 7919) % 97 + 1) for c in range(4)]
    tot = w[0] + w[1] + w[2] + w[3]
    pred = (F.when((w[0] >= w[1]) & (w[0] >= w[2]) & (w[0] >= w[3]), 0)
            .when((w[1] >= w[2]) & (w[1] >= w[3]), 1).when(w[2] >= w[3], 2).otherwise(3))
    return j.select(F.col("doc_id").alias("row_id"),
                    (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("label"),
                    *[(w[c].cast("double") / tot).alias(f"p{c}") for c in range(4)],
                    pred.alias("prediction"))


def _w(*ctes):
    return "WITH " + ",\n".join(ctes) + "\n"


_DIST = """dist AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
  FROM scored GROUP BY score),
cum AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N
  FROM dist WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
roc AS (SELECT score AS threshold, fp / N AS fpr, tp / P AS tpr FROM cum)"""


_BINARY_SQL = """SELECT round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, CAST(count(*) AS BIGINT) AS n
FROM (SELECT *, CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) OVER () AS DOUBLE) AS tp,
  CAST(count(*) FILTER (WHERE label <> 1 AND prediction = 1) OVER () AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE label = 1 AND prediction <> 1) OVER () AS DOUBLE) AS fn FROM scored)
GROUP BY tp, fp, fn"""


@query("binary_metrics", _w(SCORED_SQL) + _BINARY_SQL)
def q_binary_metrics(spark, sf_dir):
    """L1-L2: accuracy, precision, recall, F1 of class 1."""
    return ev.binary_metrics(scored_binary(spark, sf_dir))


_PER_CLASS = """cls AS (SELECT label AS c FROM multi UNION SELECT prediction FROM multi),
pc AS (SELECT c, count(*) FILTER (WHERE m.label = c AND m.prediction = c) AS tp,
  count(*) FILTER (WHERE m.label = c) AS n_true, count(*) FILTER (WHERE m.prediction = c) AS n_pred
  FROM cls CROSS JOIN multi m GROUP BY c),
pcm AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS precision,
  CASE WHEN n_true > 0 THEN tp / n_true ELSE 0 END AS recall,
  CASE WHEN n_true + n_pred > 0 THEN 2 * tp / (n_true + n_pred) ELSE 0 END AS f1 FROM pc)"""


@query("macro_metrics", _w(MULTI_SQL, _PER_CLASS) + """SELECT round(sum(tp) / sum(n_true), 6) AS accuracy,
  round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro FROM pcm""")
def q_macro(spark, sf_dir):
    """L3: macro precision / recall / F1 (4 classes)."""
    return ev.macro_metrics(scored_multi(spark, sf_dir))


_REPORT_SQL = """SELECT CAST(c AS VARCHAR) AS "row", round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(n_true AS BIGINT) AS support FROM pcm
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(n_true), 6), CAST(sum(n_true) AS BIGINT) FROM pcm
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(n_true) AS BIGINT) FROM pcm
UNION ALL SELECT 'weighted avg', round(sum(precision * n_true) / sum(n_true), 6), round(sum(recall * n_true) / sum(n_true), 6),
  round(sum(f1 * n_true) / sum(n_true), 6), CAST(sum(n_true) AS BIGINT) FROM pcm"""


@query("classification_report", _w(MULTI_SQL, _PER_CLASS) + _REPORT_SQL)
def q_report(spark, sf_dir):
    """Per-class report with accuracy, macro and weighted averages."""
    return ev.classification_report(scored_multi(spark, sf_dir))


_CM = """cm AS (SELECT a.c AS label, b.c AS prediction,
  (SELECT count(*) FROM multi m WHERE m.label = a.c AND m.prediction = b.c) AS n
  FROM cls a CROSS JOIN cls b)"""


_CM_SQL = "SELECT CAST(label AS BIGINT) AS label, CAST(prediction AS BIGINT) AS prediction, CAST(n AS BIGINT) AS n FROM cm"


@query("confusion_matrix", _w(MULTI_SQL, _PER_CLASS, _CM) + _CM_SQL)
def q_cm(spark, sf_dir):
    """L4: confusion matrix with zero cells."""
    cm = ev.confusion_matrix(scored_multi(spark, sf_dir))
    return cm.select(F.col("label").cast("long"), F.col("prediction").cast("long"), F.col("n").cast("long"))


@query("confusion_matrix_normalized", _w(MULTI_SQL, _PER_CLASS, _CM) +
       """SELECT CAST(label AS BIGINT) AS label, CAST(prediction AS BIGINT) AS prediction, CAST(n AS BIGINT) AS n,
  round(n / sum(n) OVER (PARTITION BY label), 6) AS rate FROM cm""")
def q_cmn(spark, sf_dir):
    """Row-normalised confusion matrix."""
    cm = ev.confusion_matrix_normalized(scored_multi(spark, sf_dir))
    return cm.select(F.col("label").cast("long"), F.col("prediction").cast("long"),
                     F.col("n").cast("long"), "rate")


@query("top_confusions", _w(MULTI_SQL, _PER_CLASS, _CM) + """SELECT CAST(label AS BIGINT) AS label, CAST(rank AS INTEGER) AS rank,
  CAST(prediction AS BIGINT) AS prediction, CAST(n AS BIGINT) AS n, CAST(correct AS BIGINT) AS correct, CAST(total AS BIGINT) AS total
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, prediction) AS rank FROM (
  SELECT *, sum(n) OVER (PARTITION BY label) AS total,
    sum(CASE WHEN label = prediction THEN n ELSE 0 END) OVER (PARTITION BY label) AS correct FROM cm)
  WHERE label <> prediction AND n > 0) WHERE rank <= 2""")
def q_top_conf(spark, sf_dir):
    """Per class correct/total and its two most frequent confusions."""
    t = ev.top_confusions(scored_multi(spark, sf_dir))
    return t.select(F.col("label").cast("long"), "rank", F.col("prediction").cast("long"),
                    F.col("n").cast("long"), F.col("correct").cast("long"), F.col("total").cast("long"))


_ROC_SQL = """SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc
UNION ALL SELECT NULL, 0.0, 0.0"""


@query("roc_curve", _w(SCORED_SQL, _DIST) + _ROC_SQL)
def q_roc(spark, sf_dir):
    """ROC points per distinct score."""
    return ev.roc_curve(scored_binary(spark, sf_dir))


_AUC_SQL = """SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 6) AS auc FROM (
  SELECT fpr, tpr, lag(fpr, 1, 0) OVER (ORDER BY threshold DESC) AS pf, lag(tpr, 1, 0) OVER (ORDER BY threshold DESC) AS pt FROM roc)"""


@query("roc_auc", _w(SCORED_SQL, _DIST) + _AUC_SQL)
def q_auc(spark, sf_dir):
    """ROC AUC (checked against the trapezoid rule)."""
    return ev.roc_auc(scored_binary(spark, sf_dir))


@query("pr_curve", _w(SCORED_SQL, _DIST) + """SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision,
  round(tp / P, 6) AS recall FROM cum UNION ALL SELECT NULL, 1.0, 0.0""")
def q_pr(spark, sf_dir):
    """Precision-recall points with the closing (1, 0) point."""
    return ev.pr_curve(scored_binary(spark, sf_dir))


_AP_SQL = """SELECT round(sum((r - lag_r) * p), 6) AS average_precision FROM (
  SELECT tp / P AS r, tp / (tp + fp) AS p, lag(tp / P, 1, 0) OVER (ORDER BY score DESC) AS lag_r FROM cum)"""


@query("average_precision", _w(SCORED_SQL, _DIST) + _AP_SQL)
def q_ap(spark, sf_dir):
    """Average precision."""
    return ev.average_precision(scored_binary(spark, sf_dir))


def _ovr_sql():
    parts = []
    for c in range(4):
        parts.append(f"""SELECT '{c}' AS class, round(auc, 6) AS auc FROM (
  SELECT CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum((fpr - pf) * (tpr + pt) / 2) END AS auc FROM (
    SELECT fp / N AS fpr, tp / P AS tpr, P, N, lag(fp / N, 1, 0) OVER (ORDER BY s DESC) AS pf,
           lag(tp / P, 1, 0) OVER (ORDER BY s DESC) AS pt FROM (
      SELECT s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM (
        SELECT p{c} AS s, count(*) FILTER (WHERE label = {c}) AS pos, count(*) FILTER (WHERE label <> {c}) AS neg
        FROM multi GROUP BY p{c})
      WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))))""")
    per = "\nUNION ALL\n".join(parts)
    return _w(MULTI_SQL, f"per AS ({per})") + "SELECT * FROM per UNION ALL SELECT 'macro', round(CASE WHEN count(auc) = 4 THEN avg(auc) END, 6) FROM per"


@query("roc_auc_ovr", _ovr_sql())
def q_ovr(spark, sf_dir):
    """One-vs-rest AUC per class and the macro average (NULL if a class is absent)."""
    m = scored_multi(spark, sf_dir)
    long = m.select("row_id", F.explode(F.array(*[
        F.struct(F.lit(str(c)).alias("class"), (F.col("label") == c).cast("int").alias("y"),
                 F.col(f"p{c}").alias("s")) for c in range(4)])).alias("t")).select("t.*")
    per = ev.roc_auc(long, "s", "y", by=["class"])
    macro = per.agg(F.lit("macro").alias("class"),
                    F.when(F.count("auc") == 4, F.avg("auc")).alias("auc"))
    return per.unionByName(macro)


_HIST_SQL = """SELECT label, bin, round(mn + bin * (span / 30), 6) AS lower,
  round(mn + (bin + 1) * (span / 30), 6) AS upper, CAST(n AS BIGINT) AS n,
  round(n / (sum(n) OVER (PARTITION BY label) * (span / 30)), 6) AS density FROM (
  SELECT label, least(CAST(floor((score - mn) / span * 30) AS INTEGER), 29) AS bin, any_value(mn) AS mn,
         any_value(span) AS span, count(*) AS n
  FROM scored JOIN (SELECT label AS l2, min(score) AS mn,
       CASE WHEN max(score) > min(score) THEN max(score) - min(score) ELSE 1.0 END AS span FROM scored GROUP BY label)
    ON label = l2 WHERE score IS NOT NULL GROUP BY label, bin)"""


@query("score_histogram", _w(SCORED_SQL) + _HIST_SQL)
def q_score_hist(spark, sf_dir):
    """30-bin density histogram of scores per true class."""
    return ev.score_histogram(scored_binary(spark, sf_dir), by=["label"])


_FOLD_SQL = """fo AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY u, row_id) - 1) % 5 AS INTEGER) AS fold
  FROM (SELECT *, CAST(('0x' || substr(md5(concat_ws('|', '42', CAST(row_id AS VARCHAR), 'fold')), 1, 8)) AS UBIGINT)
        / CAST(4294967296 AS DOUBLE) AS u FROM scored)),
fd AS (SELECT fold, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM fo GROUP BY fold, score),
fc AS (SELECT fold, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS P,
  sum(neg) OVER (PARTITION BY fold) AS N FROM fd
  WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fa AS (SELECT fold, sum((fpr - pf) * (tpr + pt) / 2) AS auc FROM (
  SELECT fold, fp / N AS fpr, tp / P AS tpr, lag(fp / N, 1, 0) OVER (PARTITION BY fold ORDER BY score DESC) AS pf,
         lag(tp / P, 1, 0) OVER (PARTITION BY fold ORDER BY score DESC) AS pt FROM fc) GROUP BY fold)"""


def _fold_aucs(spark, sf_dir):
    s = split.stratified_folds(scored_binary(spark, sf_dir), "label", "row_id")
    return ev.roc_auc(s, by=["fold"])


@query("cv_summary", _w(SCORED_SQL, _FOLD_SQL) + """SELECT CAST(count(*) AS BIGINT) AS n_folds, round(avg(auc), 6) AS mean,
  round(min(auc), 6) AS min, round(max(auc), 6) AS max, round(quantile_cont(auc, 0.25), 6) AS q1,
  round(quantile_cont(auc, 0.5), 6) AS median, round(quantile_cont(auc, 0.75), 6) AS q3 FROM fa""")
def q_cv_summary(spark, sf_dir):
    """Per-fold AUC summary (mean, min, max, quartiles)."""
    return ev.cv_summary(_fold_aucs(spark, sf_dir))


def _class_rows(c: int) -> str:
    tp = f"count(*) FILTER (WHERE label = {c} AND prediction = {c})"
    true, said = f"count(*) FILTER (WHERE label = {c})", f"count(*) FILTER (WHERE prediction = {c})"
    return f"""UNION ALL SELECT 'class', '{c}_precision', round(CASE WHEN {said} > 0 THEN {tp} / {said} ELSE 0 END, 6) FROM scored
UNION ALL SELECT 'class', '{c}_recall', round(CASE WHEN {true} > 0 THEN {tp} / {true} ELSE 0 END, 6) FROM scored
UNION ALL SELECT 'class', '{c}_f1', round(CAST(2 * {tp} AS DOUBLE) / ({true} + {said}), 6) FROM scored
UNION ALL SELECT 'class', '{c}_support', CAST({true} AS DOUBLE) FROM scored"""


_CLASS_SQL = "\n".join(_class_rows(c) for c in (0, 1))


@query("evaluation_report", _w(SCORED_SQL, _DIST, _FOLD_SQL) + """SELECT 'headline' AS section, name, round(value, 6) AS value FROM (
  SELECT 'accuracy' AS name, avg(CAST(label = prediction AS DOUBLE)) AS value FROM scored
  UNION ALL SELECT 'precision', CASE WHEN count(*) FILTER (WHERE prediction = 1) > 0 THEN
     count(*) FILTER (WHERE label = 1 AND prediction = 1) / count(*) FILTER (WHERE prediction = 1) ELSE 0 END FROM scored
  UNION ALL SELECT 'recall', CASE WHEN count(*) FILTER (WHERE label = 1) > 0 THEN
     count(*) FILTER (WHERE label = 1 AND prediction = 1) / count(*) FILTER (WHERE label = 1) ELSE 0 END FROM scored
  UNION ALL SELECT 'f1', CAST(2 * count(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) /
     (count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE prediction = 1)) FROM scored
  UNION ALL SELECT 'roc_auc', sum((fpr - pf) * (tpr + pt) / 2) FROM (
     SELECT fpr, tpr, lag(fpr, 1, 0) OVER (ORDER BY threshold DESC) AS pf, lag(tpr, 1, 0) OVER (ORDER BY threshold DESC) AS pt FROM roc)
  UNION ALL SELECT 'pr_auc', sum((r - lr) * p) FROM (
     SELECT tp / P AS r, tp / (tp + fp) AS p, lag(tp / P, 1, 0) OVER (ORDER BY score DESC) AS lr FROM cum))
UNION ALL SELECT 'cv', 'mean', round(avg(auc), 6) FROM fa
UNION ALL SELECT 'cv', 'min', round(min(auc), 6) FROM fa
UNION ALL SELECT 'cv', 'max', round(max(auc), 6) FROM fa
""" + _CLASS_SQL)
def q_eval_report(spark, sf_dir):
    """Headline metrics, CV stability and per-class metrics as one
    (section, name, value) table."""
    s = scored_binary(spark, sf_dir)
    bm = ev.binary_metrics(s)
    head = bm.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("name"), F.col(m).alias("value")) for m in ("accuracy", "precision", "recall", "f1")
    ])).alias("t")).select(F.lit("headline").alias("section"), "t.*")
    auc = ev.roc_auc(s).select(F.lit("headline").alias("section"), F.lit("roc_auc").alias("name"), F.col("auc").alias("value"))
    ap = ev.average_precision(s).select(F.lit("headline").alias("section"), F.lit("pr_auc").alias("name"),
                                        F.col("average_precision").alias("value"))
    cv = ev.cv_summary(_fold_aucs(spark, sf_dir))
    cvl = cv.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("name"), F.col(m).alias("value")) for m in ("mean", "min", "max")
    ])).alias("t")).select(F.lit("cv").alias("section"), "t.*")
    per = ev.per_class(s.filter(F.col("label").isNotNull() & F.col("prediction").isNotNull()))
    cls = per.select(F.explode(F.array(*[
        F.struct(F.concat(F.col("class").cast("string"), F.lit(f"_{name}")).alias("name"),
                 F.col(col).cast("double").alias("value"))
        for name, col in (("precision", "precision"), ("recall", "recall"), ("f1", "f1"), ("support", "n_true"))
    ])).alias("t")).select(F.lit("class").alias("section"), "t.*")
    return head.unionByName(auc).unionByName(ap).unionByName(cvl).unionByName(cls)


# ---------------------------------------------------------------- labels and scores that are missing

# Rule (ours): which rows lack a label, which a score and so a prediction.
NO_LABEL, NO_SCORE = 11, 13


def _with_gaps(scored):
    """The scored rows, some without a label, a score or both."""
    def gapped(spark, sf_dir):
        n = F.col("n_chars")
        docs = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
        rows = scored(spark, sf_dir).join(docs, "row_id")
        lost = {"label": NO_LABEL, "score": NO_SCORE, "prediction": NO_SCORE}
        return rows.select("row_id", *[F.when(n % lost[c] != 0, F.col(c)).alias(c) for c in rows.columns if c in lost])
    return gapped


def _gaps_sql(whole: str, name: str, where: str) -> str:
    """The same rows in SQL: ``name`` becomes the rows that ``where`` leaves."""
    columns = f"CASE WHEN n_chars % {NO_LABEL} <> 0 THEN label END AS label, CASE WHEN n_chars % {NO_SCORE} <> 0 THEN prediction END AS prediction"
    if name == "scored":
        columns += f", CASE WHEN n_chars % {NO_SCORE} <> 0 THEN score END AS score"
    return (whole.replace(f"{name} AS (", f"{name}_all AS (")
            + f""",
{name}_gaps AS (SELECT row_id, {columns} FROM {name}_all JOIN (SELECT doc_id AS row_id, n_chars FROM documents) USING (row_id)),
{name} AS (SELECT * FROM {name}_gaps WHERE {where})""")


_ON_CURVE = _gaps_sql(SCORED_SQL, "scored", "label IS NOT NULL AND score IS NOT NULL")
_JUDGED = _gaps_sql(MULTI_SQL, "multi", "label IS NOT NULL AND prediction IS NOT NULL")
_DRAWN = _gaps_sql(SCORED_SQL, "scored", "score IS NOT NULL")
_gappy, _gappy_multi = _with_gaps(scored_binary), _with_gaps(scored_multi)


@query("binary_metrics_gaps", _w(_ON_CURVE) + _BINARY_SQL)
def q_binary_gaps(spark, sf_dir):
    """L1-L2 where labels and predictions are missing."""
    return ev.binary_metrics(_gappy(spark, sf_dir))


@query("classification_report_gaps", _w(_JUDGED, _PER_CLASS) + _REPORT_SQL)
def q_report_gaps(spark, sf_dir):
    """L6 where labels and predictions are missing."""
    return ev.classification_report(_gappy_multi(spark, sf_dir))


@query("confusion_matrix_gaps", _w(_JUDGED, _PER_CLASS, _CM) + _CM_SQL)
def q_cm_gaps(spark, sf_dir):
    """L4 where labels and predictions are missing."""
    return ev.confusion_matrix(_gappy_multi(spark, sf_dir))


@query("roc_curve_gaps", _w(_ON_CURVE, _DIST) + _ROC_SQL)
def q_roc_gaps(spark, sf_dir):
    """L7 where labels and scores are missing."""
    return ev.roc_curve(_gappy(spark, sf_dir))


@query("roc_auc_gaps", _w(_ON_CURVE, _DIST) + _AUC_SQL)
def q_auc_gaps(spark, sf_dir):
    """L8 where labels and scores are missing."""
    return ev.roc_auc(_gappy(spark, sf_dir))


@query("average_precision_gaps", _w(_ON_CURVE, _DIST) + _AP_SQL)
def q_ap_gaps(spark, sf_dir):
    """L11 where labels and scores are missing."""
    return ev.average_precision(_gappy(spark, sf_dir))


@query("score_histogram_gaps", _w(_DRAWN) + _HIST_SQL.replace("ON label = l2", "ON label IS NOT DISTINCT FROM l2"))
def q_hist_gaps(spark, sf_dir):
    """L12 where labels and scores are missing; rows without a label are a group."""
    return ev.score_histogram(_gappy(spark, sf_dir), by=["label"])
