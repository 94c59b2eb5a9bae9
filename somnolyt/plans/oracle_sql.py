"""DuckDB oracle SQL: an independent, plain-SQL statement of each operator.

The driver runs these against the same Parquet tables (pre-registered views)
and compares with the Spark result.  Doubles are rounded to 6 places on both
sides; counts are BIGINT.
"""

from __future__ import annotations

from ..sources.cohort import cohort_sql

NUMERIC = ["nsrr_age", "nsrr_sex", "nsrr_race", "nsrr_ethnicity", "nsrr_current_smoker",
           "nsrr_ever_smoker", "nsrr_bmi", "nsrr_bp_systolic", "nsrr_bp_diastolic",
           "nsrr_ahi_hp3r_aasm15", "apnea_central", "apnea_obstructiva"]
CRITICAL = ["nsrr_ahi_hp3r_aasm15", "nsrr_bmi", "nsrr_age"]
OUTLIER_COLS = [c for c in NUMERIC if c not in CRITICAL]


class Chain:
    """A WITH-chain of named CTEs."""

    def __init__(self):
        self.ctes: list[tuple[str, str]] = []
        self.stored: set[str] = set()

    def add(self, name: str, sql: str, stored: bool = False) -> "Chain":
        """``stored``: worked out once, however often it is read."""
        self.ctes.append((name, sql))
        if stored:
            self.stored.add(name)
        return self

    def sql(self, final: str) -> str:
        body = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in self.stored else ''}(\n{s}\n)" for n, s in self.ctes)
        return f"WITH {body}\n{final}"


def cohort_chain() -> Chain:
    return Chain().add("cohort", cohort_sql())


RECODED = """SELECT patient_id, nsrr_age,
  CASE lower(nsrr_sex) WHEN 'male' THEN 1.0 WHEN 'female' THEN 0.0 END AS nsrr_sex,
  CASE lower(nsrr_race) WHEN 'white' THEN 0.0 WHEN 'black or african american' THEN 1.0
       WHEN 'american indian or alaska native' THEN 2.0 WHEN 'multiple' THEN 3.0
       WHEN 'native hawaiian or other pacific islander' THEN 4.0 WHEN 'asian' THEN 5.0 END AS nsrr_race,
  CASE lower(nsrr_ethnicity) WHEN 'not hispanic or latino' THEN 0.0
       WHEN 'hispanic or latino' THEN 1.0 END AS nsrr_ethnicity,
  CASE lower(nsrr_current_smoker) WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 END AS nsrr_current_smoker,
  CASE lower(nsrr_ever_smoker) WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 END AS nsrr_ever_smoker,
  nsrr_bmi, nsrr_bp_systolic, nsrr_bp_diastolic, nsrr_ahi_hp3r_aasm15,
  apnea_central, apnea_obstructiva
FROM cohort
WHERE NOT coalesce(lower(nsrr_race) IN ('unknown', 'other'), false)"""


def dense_sql(src: str = "recoded") -> str:
    nulls = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in NUMERIC)
    return f"SELECT * FROM {src} WHERE ({nulls}) / CAST(12 AS DOUBLE) <= 0.5"


def imputed_simple_sql(strategy: str, src: str = "dense") -> tuple[str, str]:
    """(stats CTE, imputed CTE) for mean / median / most_frequent."""
    if strategy == "mean":
        stats = ", ".join(f"avg({c}) AS {c}" for c in NUMERIC)
        stats_sql = f"SELECT {stats} FROM {src}"
    elif strategy == "median":
        stats = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUMERIC)
        stats_sql = f"SELECT {stats} FROM {src}"
    elif strategy == "most_frequent":
        parts = []
        for c in NUMERIC:
            parts.append(f"(SELECT CAST({c} AS DOUBLE) FROM {src} WHERE {c} IS NOT NULL "
                         f"GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1) AS {c}")
        stats_sql = "SELECT " + ",\n  ".join(parts)
    else:
        raise ValueError(strategy)
    cols = ", ".join(f"CAST(coalesce(CAST(d.{c} AS DOUBLE), s.{c}) AS DOUBLE) AS {c}" for c in NUMERIC)
    imputed = f"SELECT d.patient_id, {cols} FROM {src} d CROSS JOIN stats s"
    return stats_sql, imputed


def add_outlier_chain(ch: Chain, src: str, factor: float = 3.0, share: float = 0.05,
                      cols: list[str] = OUTLIER_COLS, simultaneous: bool = False) -> str:
    """3*IQR rule: one quartile / count / filter CTE per column, over what the
    columns before it left or, ``simultaneous``, over all rows.
    Returns the name of the last CTE."""
    prev = src
    for i, c in enumerate(cols):
        seen = src if simultaneous else prev
        ch.add(f"oq{i}", f"SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {seen}")
        ch.add(f"ob{i}", f"SELECT q1, q3, q1 - {factor} * (q3 - q1) AS lo, q3 + {factor} * (q3 - q1) AS hi FROM oq{i}")
        ch.add(f"on{i}", f"SELECT count(*) AS n, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS n_out "
                         f"FROM {seen} CROSS JOIN ob{i}")
        ch.add(f"o{i}", f"SELECT p.* FROM {prev} p CROSS JOIN ob{i} CROSS JOIN on{i} "
                        f"WHERE NOT (n_out > 0 AND n_out < n * CAST({share} AS DOUBLE) "
                        f"AND coalesce(p.{c} < lo OR p.{c} > hi, false))")
        prev = f"o{i}"
    return prev


FEATURES = """SELECT *,
  CASE WHEN nsrr_bmi > 0 AND nsrr_bmi <= 18.5 THEN 'Bajo peso'
       WHEN nsrr_bmi > 18.5 AND nsrr_bmi <= 25 THEN 'Normal'
       WHEN nsrr_bmi > 25 AND nsrr_bmi <= 30 THEN 'Sobrepeso'
       WHEN nsrr_bmi > 30 AND nsrr_bmi <= 35 THEN 'Obesidad I'
       WHEN nsrr_bmi > 35 AND nsrr_bmi <= 40 THEN 'Obesidad II'
       WHEN nsrr_bmi > 40 THEN 'Obesidad III' END AS bmi_categoria,
  CASE WHEN nsrr_bmi >= 30 THEN 1 ELSE 0 END AS obesidad,
  CASE WHEN nsrr_bmi >= 35 THEN 1 ELSE 0 END AS obesidad_severa,
  CASE WHEN nsrr_bp_systolic < 120 AND nsrr_bp_diastolic < 80 THEN 'Normal'
       WHEN nsrr_bp_systolic >= 120 AND nsrr_bp_systolic <= 129 AND nsrr_bp_diastolic < 80 THEN 'Elevada'
       WHEN (nsrr_bp_systolic >= 130 AND nsrr_bp_systolic <= 139)
         OR (nsrr_bp_diastolic >= 80 AND nsrr_bp_diastolic <= 89) THEN 'Hipertension_1'
       WHEN (nsrr_bp_systolic >= 140 AND nsrr_bp_systolic <= 180)
         OR (nsrr_bp_diastolic >= 90 AND nsrr_bp_diastolic <= 120) THEN 'Hipertension_2'
       ELSE 'Hipertension_Crisis' END AS categoria_pa
FROM {src}"""

FEATURES2 = """SELECT *,
  CASE WHEN categoria_pa IN ('Hipertension_1', 'Hipertension_2', 'Hipertension_Crisis') THEN 1 ELSE 0 END AS hipertension,
  CASE WHEN categoria_pa IN ('Hipertension_2', 'Hipertension_Crisis') THEN 1 ELSE 0 END AS hipertension_severa,
  CASE WHEN nsrr_age > 50 AND nsrr_bmi >= 30 THEN 1 ELSE 0 END AS edad_obesidad_risk,
  CASE WHEN nsrr_sex = 1 AND nsrr_age >= 40 AND nsrr_age <= 65 THEN 1 ELSE 0 END AS hombre_edad_media
FROM {src}"""

FEATURES3 = """SELECT *,
  CAST(obesidad AS DOUBLE) + CAST(hipertension AS DOUBLE) + coalesce(CAST(nsrr_current_smoker AS DOUBLE), 0.0) AS clinical_risk_score,
  CASE WHEN nsrr_ahi_hp3r_aasm15 <= 5 THEN 'Normal'
       WHEN nsrr_ahi_hp3r_aasm15 <= 15 THEN 'Leve'
       WHEN nsrr_ahi_hp3r_aasm15 <= 30 THEN 'Moderada'
       WHEN nsrr_ahi_hp3r_aasm15 > 30 THEN 'Severa' END AS apnea_severity,
  CASE WHEN nsrr_ahi_hp3r_aasm15 >= 5 THEN 1 ELSE 0 END AS apnea
FROM {src}"""

FEATURES4 = """SELECT *,
  CASE apnea_severity WHEN 'Normal' THEN 0 WHEN 'Leve' THEN 1 WHEN 'Moderada' THEN 2
       WHEN 'Severa' THEN 3 END AS apnea_severity_ordinal
FROM {src}"""


def add_features(ch: Chain, src: str, prefix: str = "f") -> str:
    ch.add(f"{prefix}1", FEATURES.format(src=src))
    ch.add(f"{prefix}2", FEATURES2.format(src=f"{prefix}1"))
    ch.add(f"{prefix}3", FEATURES3.format(src=f"{prefix}2"))
    ch.add(f"{prefix}4", FEATURES4.format(src=f"{prefix}3"))
    return f"{prefix}4"


def preprocessed_chain(strategy: str = "median") -> tuple[Chain, str]:
    """CTE chain for the full preprocessing; returns (chain, final CTE name)."""
    ch = cohort_chain().add("recoded", RECODED).add("dense", dense_sql())
    if strategy == "knn":
        from .oracle_knn import add_knn_impute
        imputed = add_knn_impute(ch, "dense")
    else:
        stats, imp = imputed_simple_sql(strategy)
        ch.add("stats", stats).add("imputed", imp)
        imputed = "imputed"
    last = add_outlier_chain(ch, imputed)
    ch.add("aged", f"SELECT * FROM {last} WHERE nsrr_age BETWEEN 28 AND 75")
    final = add_features(ch, "aged")
    return ch, final


PREPROCESSED_COLUMNS = ["patient_id"] + NUMERIC + [
    "bmi_categoria", "obesidad", "obesidad_severa", "categoria_pa", "hipertension",
    "hipertension_severa", "edad_obesidad_risk", "hombre_edad_media",
    "clinical_risk_score", "apnea_severity", "apnea", "apnea_severity_ordinal"]


def rounded_select(cols: list[str], doubles: set[str], src: str) -> str:
    parts = [f"round({c}, 6) AS {c}" if c in doubles else c for c in cols]
    return f"SELECT {', '.join(parts)} FROM {src}"
