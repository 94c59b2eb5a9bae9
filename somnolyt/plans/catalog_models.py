"""Training, cross-validation, persistence and scoring queries (rows-only
checks: learned models are compared by quality, not by value)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import models
from ..session import scratch_path
from ..sources import cohort as src
from . import oracle_sql as O
from .catalog import _preprocessed
from .catalog_matrix import BMI_DUMMIES, PRE_FEATURES, _matrix_sql
from .matrix import apply_model_matrix, fit_model_matrix, to_tall
from .registry import query

KEY = "patient_id"


def _matrix(spark, sf_dir, mode="binario"):
    m, params = fit_model_matrix(_preprocessed(spark, sf_dir), mode)
    return m, params


def _train(spark, sf_dir, model, mode):
    m, params = _matrix(spark, sf_dir, mode)
    return models.train_evaluate(m, params.features, model, mode, key=KEY)


for _name, _model, _mode in [("train_rf_binary", "RandomForest", "binario"),
                             ("train_gbt_binary", "GradientBoosting", "binario"),
                             ("train_svm_binary", "SVM", "binario"),
                             ("train_rf_multiclass", "RandomForest", "multiclase"),
                             ("train_gbt_multiclass", "GradientBoosting", "multiclase"),
                             ("train_svm_multiclass", "SVM", "multiclase")]:
    def _mk(model, mode):
        def fn(spark, sf_dir):
            _, _, metrics = _train(spark, sf_dir, model, mode)
            return metrics
        fn.__doc__ = f"K1-K6: {model} ({mode}) trained on the stratified 80% split, test metrics."
        return fn
    query(_name)(_mk(_model, _mode))


@query("feature_importance")
def q_importance(spark, sf_dir):
    """K9/F8: forest feature importances paired with feature names, ranked."""
    m, params = _matrix(spark, sf_dir)
    model = models.fit(m, params.features, "RandomForest")
    return models.feature_importance(model, params.features)


@query("model_report")
def q_model_report(spark, sf_dir):
    """A10: metrics and the ten most important features of the trained forest
    as one (section, rank, name, value) table."""
    m, params = _matrix(spark, sf_dir)
    model, _, metrics = models.train_evaluate(m, params.features, "RandomForest", "binario", key=KEY)
    return models.report(metrics, models.feature_importance(model, params.features))


@query("cv_scores")
def q_cv(spark, sf_dir):
    """Per-fold ROC-AUC of the forest over stratified 5 folds."""
    m, params = _matrix(spark, sf_dir)
    return models.cv_scores(m, params.features, "RandomForest", key=KEY)


@query("model_comparison")
def q_compare(spark, sf_dir):
    """Configured models (forest, boosting) in binary mode, metrics by model."""
    m, params = _matrix(spark, sf_dir)
    return models.compare(m, params.features, ["RandomForest", "GradientBoosting"], "binario", key=KEY)


@query("model_roundtrip")
def q_roundtrip(spark, sf_dir):
    """Save the fitted pipeline, load it back and score the test split."""
    m, params = _matrix(spark, sf_dir)
    model, _, metrics = models.train_evaluate(m, params.features, "RandomForest", "binario", key=KEY)
    root = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    models.save(model, f"{root}/binario_RandomForest", params, metrics)
    loaded = models.load_named(root, ["binario_RandomForest"])["binario_RandomForest"]
    _, test = models.holdout(m, KEY)
    return models.predict(loaded, test, KEY).select(KEY, "label", "prediction", "score")


@query("batch_score")
def q_batch_score(spark, sf_dir):
    """A saved model, loaded by path, scores every cohort row."""
    m, params = _matrix(spark, sf_dir)
    path = scratch_path(spark, f"models-{uuid.uuid4().hex}/RandomForest")
    models.save(models.fit(m, params.features, "RandomForest"), path, params)
    return models.predict(models.load(path), m, KEY).select(KEY, "prediction", "score")


def _new_patient_sql() -> str:
    """The literal patient by the cohort's levels, medians and ranges: text is
    recoded, flags and bands are derived, what it lacks is 0."""
    ch = _matrix_sql()
    ch.add("lit", """SELECT CAST(-1 AS BIGINT) AS patient_id, CAST(30 AS DOUBLE) AS nsrr_age, CAST(0 AS DOUBLE) AS nsrr_sex,
  CAST(38.8829556 AS DOUBLE) AS nsrr_bmi, CAST(97 AS DOUBLE) AS nsrr_bp_systolic, CAST(66 AS DOUBLE) AS nsrr_bp_diastolic,
  CAST(0 AS DOUBLE) AS nsrr_current_smoker, CAST(0 AS DOUBLE) AS nsrr_ever_smoker, CAST(NULL AS DOUBLE) AS nsrr_ahi_hp3r_aasm15""")
    last = O.add_features(ch, "lit", "g")
    lacks = {"nsrr_race", "nsrr_ethnicity", "apnea_central", "apnea_obstructiva"}
    parts = [f"SELECT patient_id, '{c}' AS feature, CAST({'NULL' if c in lacks else c} AS DOUBLE) AS raw FROM {last}" for c in PRE_FEATURES]
    parts += [f"SELECT patient_id, 'bmi_categoria_{v}', CAST(bmi_categoria = '{v}' AS DOUBLE) FROM {last}" for v in BMI_DUMMIES]
    parts.append(f"SELECT patient_id, 'categoria_pa_' || value, CAST(categoria_pa = value AS DOUBLE) FROM {last} CROSS JOIN lvpa WHERE rn > 1")
    ch.add("new", "\nUNION ALL\n".join(parts))
    return ch.sql("""SELECT patient_id, feature,
  round(coalesce((raw - med) / CASE WHEN q3 - q1 = 0 THEN 1 ELSE q3 - q1 END, CAST(0 AS DOUBLE)), 6) AS value FROM new JOIN sc USING (feature)""")


@query("score_new_patients", _new_patient_sql())
def q_new_patients(spark, sf_dir):
    """A new patient encoded and scaled with the cohort-fitted parameters."""
    _, params = _matrix(spark, sf_dir)
    new = src.literal_patients(spark)
    X = apply_model_matrix(new, params, KEY)
    return to_tall(X, params.features)


@query("inline_patient")
def q_inline(spark, sf_dir):
    """A3 + N1 + K8: literal patient scored by a forest trained on the cohort."""
    m, params = _matrix(spark, sf_dir)
    model = models.fit(m, params.features, "RandomForest")
    X = apply_model_matrix(src.literal_patients(spark), params, KEY)
    return models.predict(model, X, KEY).select(KEY, "prediction", "score")
