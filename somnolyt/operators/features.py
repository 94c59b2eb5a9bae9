"""Derived clinical features and targets (projection only, one stage)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clinical as C


def add_bmi_features(df: DataFrame) -> DataFrame:
    if "nsrr_bmi" not in df.columns:
        return df
    bmi = F.col("nsrr_bmi")
    return df.select("*",
                     C.bmi_category(bmi).alias("bmi_categoria"),
                     C.flag(bmi >= 30).alias("obesidad"),
                     C.flag(bmi >= 35).alias("obesidad_severa"))


def add_bp_features(df: DataFrame) -> DataFrame:
    if not {"nsrr_bp_systolic", "nsrr_bp_diastolic"} <= set(df.columns):
        return df
    band = C.bp_category(F.col("nsrr_bp_systolic"), F.col("nsrr_bp_diastolic"))
    df = df.select("*", band.alias("categoria_pa"))
    pa = F.col("categoria_pa")
    return df.select("*",
                     pa.isin(*C.HYPERTENSION).cast("int").alias("hipertension"),
                     pa.isin(*C.SEVERE_HYPERTENSION).cast("int").alias("hipertension_severa"))


def add_risk_flags(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    extra = []
    age = F.col("nsrr_age")
    if {"nsrr_bmi", "nsrr_age"} <= cols:
        extra.append(C.flag((age > 50) & (F.col("nsrr_bmi") >= 30)).alias("edad_obesidad_risk"))
    if {"nsrr_sex", "nsrr_age"} <= cols:
        extra.append(C.flag((F.col("nsrr_sex") == 1) & (age >= 40) & (age <= 65))
                     .alias("hombre_edad_media"))
    return df.select("*", *extra) if extra else df


def add_clinical_risk_score(df: DataFrame) -> DataFrame:
    """Sum of the risk factors that exist; missing terms count as 0."""
    factors = [c for c in ("obesidad", "hipertension", "nsrr_current_smoker") if c in df.columns]
    if not factors:
        return df
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in factors), F.lit(0.0))
    return df.select("*", score.alias("clinical_risk_score"))


def add_severity_targets(df: DataFrame) -> DataFrame:
    if "nsrr_ahi_hp3r_aasm15" not in df.columns:
        return df
    ahi = F.col("nsrr_ahi_hp3r_aasm15")
    df = df.select("*", C.severity(ahi).alias("apnea_severity"),
                   C.flag(ahi >= 5).alias("apnea"))
    return df.select("*", C.severity_ordinal(F.col("apnea_severity")).alias("apnea_severity_ordinal"))


def add_derived_features(df: DataFrame) -> DataFrame:
    """E1..E12 in the reference order."""
    return (df.transform(add_bmi_features)
              .transform(add_bp_features)
              .transform(add_risk_flags)
              .transform(add_clinical_risk_score)
              .transform(add_severity_targets))


def differential_groups(df: DataFrame) -> DataFrame:
    """Rows with central or obstructive apnea, labelled by type (both -> Central)."""
    return (df.filter((F.col("apnea_central") == 1) | (F.col("apnea_obstructiva") == 1))
              .select("*", F.when(F.col("apnea_central") == 1, "Central")
                      .when(F.col("apnea_central") == 0, "Obstructiva").alias("tipo_apnea")))


def gender_labels(df: DataFrame) -> DataFrame:
    """Gender code and label; text matching is case-sensitive here."""
    sex = F.col("nsrr_sex")
    is_text = dict(df.dtypes)["nsrr_sex"] == "string"
    code = (F.when(sex == "male", 1).when(sex == "female", 0) if is_text else sex.cast("int"))
    df = df.select("*", code.alias("gender_numeric"))
    g = F.col("gender_numeric")
    return df.select("*", F.when(g == 1, "Male").when(g == 0, "Female").alias("gender_label"))
