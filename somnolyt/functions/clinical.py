"""Clinical rules as Column expressions (JVM-side, codegen'd; no UDFs).

Missing-value semantics follow pandas: a comparison against a missing value
is False, so every flag goes through ``coalesce(cond, false)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category code maps (keys are lower-cased text).
SEX_CODES = {"male": 1, "female": 0}
SMOKER_CODES = {"yes": 1, "no": 0}          # 'not reported' -> missing
RACE_CODES = {
    "white": 0,
    "black or african american": 1,
    "american indian or alaska native": 2,
    "multiple": 3,
    "native hawaiian or other pacific islander": 4,
    "asian": 5,
}
ETHNICITY_CODES = {"not hispanic or latino": 0, "hispanic or latino": 1}
RACE_DROPPED = ["unknown", "other"]

CODE_MAPS = {
    "nsrr_sex": SEX_CODES,
    "nsrr_current_smoker": SMOKER_CODES,
    "nsrr_ever_smoker": SMOKER_CODES,
    "nsrr_race": RACE_CODES,
    "nsrr_ethnicity": ETHNICITY_CODES,
}

# Right-closed BMI bins (0,18.5] (18.5,25] (25,30] (30,35] (35,40] (40,inf)
BMI_BINS = [(18.5, "Bajo peso"), (25.0, "Normal"), (30.0, "Sobrepeso"),
            (35.0, "Obesidad I"), (40.0, "Obesidad II"), (float("inf"), "Obesidad III")]
BMI_LABELS = [label for _, label in BMI_BINS]

# Right-closed AHI bins (-inf,5] (5,15] (15,30] (30,inf)
SEVERITY_BINS = [(5.0, "Normal"), (15.0, "Leve"), (30.0, "Moderada"), (float("inf"), "Severa")]
SEVERITY_LABELS = [label for _, label in SEVERITY_BINS]

# Blood-pressure band labels in rule order.
BP_LABELS = ["Normal", "Elevada", "Hipertension_1", "Hipertension_2", "Hipertension_Crisis"]
HYPERTENSION = ["Hipertension_1", "Hipertension_2", "Hipertension_Crisis"]
SEVERE_HYPERTENSION = ["Hipertension_2", "Hipertension_Crisis"]

AGE_MIN, AGE_MAX = 28, 75


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int, missing -> 0 (pandas ``(x >= t).astype(int)``)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def code(col: Column, mapping: dict) -> Column:
    """Lower-cased text -> numeric code (double); unmapped / missing -> NULL."""
    expr = None
    low = F.lower(col)
    for text, value in mapping.items():
        expr = (F.when(low == text, F.lit(float(value))) if expr is None
                else expr.when(low == text, F.lit(float(value))))
    return expr


def right_closed_bins(x: Column, low: float, bins: list) -> Column:
    """``pd.cut`` with right-closed bins starting above ``low``; outside -> NULL."""
    expr = None
    for upper, label in bins:
        cond = x <= F.lit(upper) if upper != float("inf") else x.isNotNull()
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if low == float("-inf"):
        return expr
    return F.when(x > F.lit(low), expr)


def bmi_category(bmi: Column) -> Column:
    return right_closed_bins(bmi, 0.0, BMI_BINS)


def severity(ahi: Column) -> Column:
    return right_closed_bins(ahi, float("-inf"), SEVERITY_BINS)


def severity_ordinal(sev: Column) -> Column:
    expr = None
    for i, label in enumerate(SEVERITY_LABELS):
        expr = F.when(sev == label, F.lit(i)) if expr is None else expr.when(sev == label, F.lit(i))
    return expr


def bp_category(sys: Column, dia: Column) -> Column:
    """Ordered rules; a missing value makes a rule false and falls through."""
    return (F.when((sys < 120) & (dia < 80), "Normal")
            .when((sys >= 120) & (sys <= 129) & (dia < 80), "Elevada")
            .when(((sys >= 130) & (sys <= 139)) | ((dia >= 80) & (dia <= 89)), "Hipertension_1")
            .when(((sys >= 140) & (sys <= 180)) | ((dia >= 90) & (dia <= 120)), "Hipertension_2")
            .otherwise("Hipertension_Crisis"))
