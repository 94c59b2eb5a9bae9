"""Query catalog: ``(spark, sf_dir) -> DataFrame`` per operator, with the
matching DuckDB oracle SQL where the operator is SQL-expressible.

Every query reads the driver tables (or frames Spark derives from them), so
its work grows with the data.  Floating outputs are rounded to 6 places.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clinical as C
from ..operators import features, impute, outliers, recode
from ..sources import cohort as src
from . import oracle_sql as O
from .preprocess import preprocess_cohort
from .registry import query


# ---------------------------------------------------------------- cohort / preprocessing

def _recoded(spark, sf_dir):
    return recode.recode_categories(src.cohort(spark, sf_dir))


def _preprocessed(spark, sf_dir, strategy="median"):
    return preprocess_cohort(src.cohort(spark, sf_dir), strategy=strategy)


_COHORT_COLS = [n for n, _ in src.COHORT_COLUMNS]
_COHORT_DOUBLES = {"nsrr_age", "nsrr_bmi", "nsrr_bp_systolic", "nsrr_bp_diastolic",
                   "nsrr_ahi_hp3r_aasm15"}


@query("load_cohort", O.cohort_chain().sql(O.rounded_select(_COHORT_COLS, _COHORT_DOUBLES, "cohort")))
def q_load_cohort(spark, sf_dir):
    """A1: cohort rows with missing values normalised and configured columns dropped."""
    return src.drop_columns(src.normalize_missing(src.cohort(spark, sf_dir)))


@query("load_drop_columns", O.cohort_chain().sql(O.rounded_select(_COHORT_COLS, _COHORT_DOUBLES, "cohort")))
def q_load_drop_columns(spark, sf_dir):
    """A2: target copies present in the file are dropped at load."""
    df = src.cohort(spark, sf_dir)
    df = df.select("*", C.flag(F.col("nsrr_ahi_hp3r_aasm15") >= 5).alias("apnea_binary"),
                   C.severity(F.col("nsrr_ahi_hp3r_aasm15")).alias("apnea_category"))
    return src.drop_columns(df)


_RECODED_DOUBLES = set(O.NUMERIC) - {"apnea_central", "apnea_obstructiva"}
_RECODED_COLS = ["patient_id"] + O.NUMERIC


@query("recode_categories",
       O.cohort_chain().add("recoded", O.RECODED).sql(O.rounded_select(_RECODED_COLS, _RECODED_DOUBLES, "recoded")))
def q_recode(spark, sf_dir):
    """Lower-case, code maps, race filter."""
    return _recoded(spark, sf_dir)


@query("filter_undefined_race", O.cohort_chain().sql(
    "SELECT patient_id, nsrr_race FROM cohort WHERE NOT coalesce(lower(nsrr_race) IN ('unknown','other'), false)"))
def q_filter_race(spark, sf_dir):
    """Rows with race unknown/other removed, missing race kept."""
    return recode.filter_undefined_race(src.cohort(spark, sf_dir)).select("patient_id", "nsrr_race")


@query("drop_sparse_rows", O.cohort_chain().add("recoded", O.RECODED).add("dense", O.dense_sql())
       .sql(O.rounded_select(_RECODED_COLS, _RECODED_DOUBLES, "dense")))
def q_drop_sparse(spark, sf_dir):
    """Rows with more than half of their cells missing are dropped."""
    return recode.drop_sparse_rows(_recoded(spark, sf_dir))


@query("filter_age_range", O.cohort_chain().sql(
    "SELECT patient_id, nsrr_age FROM cohort WHERE nsrr_age BETWEEN 28 AND 75"))
def q_age(spark, sf_dir):
    """Inclusive 28..75 age window."""
    return recode.filter_age_range(src.cohort(spark, sf_dir)).select("patient_id", "nsrr_age")


def _impute_sql(strategy):
    ch = O.cohort_chain().add("recoded", O.RECODED).add("dense", O.dense_sql())
    stats, imp = O.imputed_simple_sql(strategy)
    ch.add("stats", stats).add("imputed", imp)
    return ch.sql(O.rounded_select(_RECODED_COLS, set(O.NUMERIC), "imputed"))


for _strategy, _key in [("mean", "impute_mean"), ("median", "impute_median"),
                        ("most_frequent", "impute_mode")]:
    def _mk(strategy):
        def fn(spark, sf_dir):
            df = recode.drop_sparse_rows(_recoded(spark, sf_dir))
            return impute.impute(df, strategy)
        fn.__doc__ = f"C2-C4: {strategy} imputation of all numeric columns."
        return fn
    query(_key, _impute_sql(_strategy))(_mk(_strategy))


def _outlier_sql(final_cols=True):
    ch = O.cohort_chain().add("recoded", O.RECODED).add("dense", O.dense_sql())
    stats, imp = O.imputed_simple_sql("median")
    ch.add("stats", stats).add("imputed", imp)
    return ch


def _outlier_filter_sql(simultaneous=False):
    ch = _outlier_sql()
    last = O.add_outlier_chain(ch, "imputed", simultaneous=simultaneous)
    return ch.sql(O.rounded_select(_RECODED_COLS, set(O.NUMERIC), last))


def _outlier_audit_sql(simultaneous=False):
    ch = _outlier_sql()
    O.add_outlier_chain(ch, "imputed", simultaneous=simultaneous)
    parts = []
    for i, c in enumerate(O.OUTLIER_COLS):
        parts.append(
            f"SELECT CAST({i} AS INTEGER) AS step, '{c}' AS \"column\", round(q1, 6) AS q1, round(q3, 6) AS q3, "
            f"round(lo, 6) AS lower, round(hi, 6) AS upper, CAST(n_out AS BIGINT) AS n_outliers, "
            f"CAST(n AS BIGINT) AS n_rows, CASE WHEN n_out = 0 THEN 'none' "
            f"WHEN n_out < n * CAST(0.05 AS DOUBLE) THEN 'removed' ELSE 'kept' END AS action "
            f"FROM ob{i} CROSS JOIN on{i}")
    return ch.sql("\nUNION ALL\n".join(parts))


def _median_imputed(spark, sf_dir):
    df = recode.drop_sparse_rows(_recoded(spark, sf_dir))
    return impute.impute(df, "median")


@query("outlier_filter_sequential", _outlier_filter_sql())
def q_outlier_seq(spark, sf_dir):
    """Sequential 3*IQR removal with the 5% guard."""
    df, _ = outliers.outlier_filter_sequential(_median_imputed(spark, sf_dir))
    return df


@query("outlier_audit", _outlier_audit_sql())
def q_outlier_audit(spark, sf_dir):
    """D3: per column step quartiles, bounds, outlier count and action."""
    _, audit = outliers.outlier_filter_sequential(_median_imputed(spark, sf_dir))
    return audit


@query("outlier_filter_simultaneous", _outlier_filter_sql(True))
def q_outlier_all(spark, sf_dir):
    """D1-D2 with every column's bounds from the whole input."""
    df, _ = outliers.outlier_filter_sequential(_median_imputed(spark, sf_dir), simultaneous=True)
    return df


@query("outlier_audit_simultaneous", _outlier_audit_sql(True))
def q_outlier_audit_all(spark, sf_dir):
    """D3 with every column's bounds from the whole input."""
    _, audit = outliers.outlier_filter_sequential(_median_imputed(spark, sf_dir), simultaneous=True)
    return audit


# ---------------------------------------------------------------- derived features

def _rec_sql(final: str) -> str:
    return O.cohort_chain().add("recoded", O.RECODED).sql(final)


@query("bmi_category", _rec_sql("""SELECT patient_id, nsrr_bmi,
  CASE WHEN nsrr_bmi > 0 AND nsrr_bmi <= 18.5 THEN 'Bajo peso' WHEN nsrr_bmi > 18.5 AND nsrr_bmi <= 25 THEN 'Normal'
       WHEN nsrr_bmi > 25 AND nsrr_bmi <= 30 THEN 'Sobrepeso' WHEN nsrr_bmi > 30 AND nsrr_bmi <= 35 THEN 'Obesidad I'
       WHEN nsrr_bmi > 35 AND nsrr_bmi <= 40 THEN 'Obesidad II' WHEN nsrr_bmi > 40 THEN 'Obesidad III' END AS bmi_categoria
FROM recoded"""))
def q_bmi_category(spark, sf_dir):
    """Right-closed BMI bins."""
    return _recoded(spark, sf_dir).select("patient_id", "nsrr_bmi",
                                          C.bmi_category(F.col("nsrr_bmi")).alias("bmi_categoria"))


@query("obesity_flags", _rec_sql("""SELECT patient_id,
  CASE WHEN nsrr_bmi >= 30 THEN 1 ELSE 0 END AS obesidad,
  CASE WHEN nsrr_bmi >= 35 THEN 1 ELSE 0 END AS obesidad_severa FROM recoded"""))
def q_obesity(spark, sf_dir):
    """Obesity flags, missing BMI -> 0."""
    df = features.add_bmi_features(_recoded(spark, sf_dir))
    return df.select("patient_id", "obesidad", "obesidad_severa")


_BP_SQL = """CASE WHEN nsrr_bp_systolic < 120 AND nsrr_bp_diastolic < 80 THEN 'Normal'
       WHEN nsrr_bp_systolic >= 120 AND nsrr_bp_systolic <= 129 AND nsrr_bp_diastolic < 80 THEN 'Elevada'
       WHEN (nsrr_bp_systolic >= 130 AND nsrr_bp_systolic <= 139) OR (nsrr_bp_diastolic >= 80 AND nsrr_bp_diastolic <= 89) THEN 'Hipertension_1'
       WHEN (nsrr_bp_systolic >= 140 AND nsrr_bp_systolic <= 180) OR (nsrr_bp_diastolic >= 90 AND nsrr_bp_diastolic <= 120) THEN 'Hipertension_2'
       ELSE 'Hipertension_Crisis' END"""


@query("bp_category", _rec_sql(f"SELECT patient_id, nsrr_bp_systolic, nsrr_bp_diastolic, {_BP_SQL} AS categoria_pa FROM recoded"))
def q_bp(spark, sf_dir):
    """Ordered blood-pressure rules; missing values fall through."""
    df = _recoded(spark, sf_dir)
    return df.select("patient_id", "nsrr_bp_systolic", "nsrr_bp_diastolic",
                     C.bp_category(F.col("nsrr_bp_systolic"), F.col("nsrr_bp_diastolic")).alias("categoria_pa"))


@query("hypertension_flags", _rec_sql(f"""SELECT patient_id,
  CASE WHEN {_BP_SQL} IN ('Hipertension_1','Hipertension_2','Hipertension_Crisis') THEN 1 ELSE 0 END AS hipertension,
  CASE WHEN {_BP_SQL} IN ('Hipertension_2','Hipertension_Crisis') THEN 1 ELSE 0 END AS hipertension_severa
FROM recoded"""))
def q_hypertension(spark, sf_dir):
    """E5-E6."""
    return features.add_bp_features(_recoded(spark, sf_dir)).select(
        "patient_id", "hipertension", "hipertension_severa")


@query("risk_flags", _rec_sql("""SELECT patient_id,
  CASE WHEN nsrr_age > 50 AND nsrr_bmi >= 30 THEN 1 ELSE 0 END AS edad_obesidad_risk,
  CASE WHEN nsrr_sex = 1 AND nsrr_age >= 40 AND nsrr_age <= 65 THEN 1 ELSE 0 END AS hombre_edad_media
FROM recoded"""))
def q_risk(spark, sf_dir):
    """E7-E8."""
    return features.add_risk_flags(_recoded(spark, sf_dir)).select(
        "patient_id", "edad_obesidad_risk", "hombre_edad_media")


@query("clinical_risk_score", _rec_sql(f"""SELECT patient_id,
  round(CAST(CASE WHEN nsrr_bmi >= 30 THEN 1 ELSE 0 END AS DOUBLE)
  + CAST(CASE WHEN {_BP_SQL} IN ('Hipertension_1','Hipertension_2','Hipertension_Crisis') THEN 1 ELSE 0 END AS DOUBLE)
  + coalesce(nsrr_current_smoker, 0.0), 6) AS clinical_risk_score FROM recoded"""))
def q_risk_score(spark, sf_dir):
    """Sum of present risk factors, missing terms as 0."""
    df = _recoded(spark, sf_dir).transform(features.add_bmi_features).transform(
        features.add_bp_features).transform(features.add_clinical_risk_score)
    return df.select("patient_id", "clinical_risk_score")


@query("severity_targets", _rec_sql("""SELECT patient_id, round(nsrr_ahi_hp3r_aasm15, 6) AS nsrr_ahi_hp3r_aasm15,
  CASE WHEN nsrr_ahi_hp3r_aasm15 <= 5 THEN 'Normal' WHEN nsrr_ahi_hp3r_aasm15 <= 15 THEN 'Leve'
       WHEN nsrr_ahi_hp3r_aasm15 <= 30 THEN 'Moderada' WHEN nsrr_ahi_hp3r_aasm15 > 30 THEN 'Severa' END AS apnea_severity,
  CASE WHEN nsrr_ahi_hp3r_aasm15 >= 5 THEN 1 ELSE 0 END AS apnea,
  CASE WHEN nsrr_ahi_hp3r_aasm15 <= 5 THEN 0 WHEN nsrr_ahi_hp3r_aasm15 <= 15 THEN 1
       WHEN nsrr_ahi_hp3r_aasm15 <= 30 THEN 2 WHEN nsrr_ahi_hp3r_aasm15 > 30 THEN 3 END AS apnea_severity_ordinal
FROM recoded"""))
def q_severity(spark, sf_dir):
    """Right-closed severity, binary flag (>= 5), ordinal code."""
    return features.add_severity_targets(_recoded(spark, sf_dir)).select(
        "patient_id", "nsrr_ahi_hp3r_aasm15", "apnea_severity", "apnea", "apnea_severity_ordinal")


def _pre_sql(final_fn, strategy="median"):
    ch, last = O.preprocessed_chain(strategy)
    return ch.sql(final_fn(last))


_PRE_DOUBLES = set(O.NUMERIC) | {"clinical_risk_score"}


@query("preprocess_cohort", _pre_sql(lambda t: O.rounded_select(O.PREPROCESSED_COLUMNS, _PRE_DOUBLES, t)))
def q_preprocess(spark, sf_dir):
    """Full preprocessing chain (median imputation)."""
    return _preprocessed(spark, sf_dir, "median").select(*O.PREPROCESSED_COLUMNS)


@query("severity_distribution", _pre_sql(lambda t: f"""SELECT apnea_severity_ordinal, apnea_severity,
  CAST(count(*) AS BIGINT) AS n FROM {t} GROUP BY apnea_severity_ordinal, apnea_severity"""))
def q_severity_distribution(spark, sf_dir):
    """Class distribution of the preprocessed cohort, by class."""
    df = _preprocessed(spark, sf_dir, "median")
    return (df.groupBy("apnea_severity_ordinal", "apnea_severity")
              .agg(F.count(F.lit(1)).alias("n")).orderBy("apnea_severity_ordinal"))


@query("binary_distribution", _pre_sql(lambda t: f"""SELECT
  CAST(count(*) FILTER (WHERE apnea = 1) AS BIGINT) AS positives,
  CAST(count(*) FILTER (WHERE apnea = 0) AS BIGINT) AS negatives,
  CAST(count(*) AS BIGINT) AS n FROM {t}"""))
def q_binary_distribution(spark, sf_dir):
    """positive / negative counts."""
    df = _preprocessed(spark, sf_dir, "median")
    return df.agg(F.count_if(F.col("apnea") == 1).alias("positives"),
                  F.count_if(F.col("apnea") == 0).alias("negatives"),
                  F.count(F.lit(1)).alias("n"))
