"""Boundary cases of the clinical rules (FIXTURES.md section 4)."""

from pyspark.sql import functions as F

from somnolyt.functions import clinical as C
from somnolyt.operators import features


def _one(spark, schema, rows, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_severity_edges(spark):
    rows = [(4.999,), (5.0,), (15.0,), (15.001,), (30.0,), (30.001,), (None,)]
    df = features.add_severity_targets(spark.createDataFrame(rows, "nsrr_ahi_hp3r_aasm15 double"))
    got = [(r.apnea_severity, r.apnea, r.apnea_severity_ordinal) for r in df.collect()]
    assert got == [("Normal", 0, 0), ("Normal", 1, 0), ("Leve", 1, 1), ("Moderada", 1, 2),
                   ("Moderada", 1, 2), ("Severa", 1, 3), (None, 0, None)]


def test_bmi_edges(spark):
    rows = [(0.0,), (18.5,), (25.0,), (30.0,), (35.0,), (40.0,), (40.1,), (None,)]
    df = features.add_bmi_features(spark.createDataFrame(rows, "nsrr_bmi double"))
    got = [(r.bmi_categoria, r.obesidad, r.obesidad_severa) for r in df.collect()]
    assert got == [(None, 0, 0), ("Bajo peso", 0, 0), ("Normal", 0, 0), ("Sobrepeso", 1, 0),
                   ("Obesidad I", 1, 1), ("Obesidad II", 1, 1), ("Obesidad III", 1, 1), (None, 0, 0)]


def test_bp_edges(spark):
    rows = [(119.0, 79.0), (120.0, 79.0), (129.5, 70.0), (130.0, 70.0), (139.5, 70.0),
            (125.0, 89.5), (190.0, 85.0), (190.0, 70.0), (None, 70.0), (135.0, None)]
    got = _one(spark, "s double, d double", rows, C.bp_category(F.col("s"), F.col("d")))
    assert got == ["Normal", "Elevada", "Hipertension_Crisis", "Hipertension_1", "Hipertension_Crisis",
                   "Hipertension_Crisis", "Hipertension_1", "Hipertension_Crisis", "Hipertension_Crisis",
                   "Hipertension_1"]


def test_literal_patient_rules(spark):
    from somnolyt.operators import recode
    from somnolyt.sources.cohort import literal_patients
    df = features.add_derived_features(recode.recode_categories(literal_patients(spark)))
    r = df.first()
    assert (r.bmi_categoria, r.obesidad, r.obesidad_severa, r.categoria_pa, r.hipertension,
            r.edad_obesidad_risk, r.hombre_edad_media, r.clinical_risk_score) == \
        ("Obesidad II", 1, 1, "Normal", 0, 0, 0, 1.0)


def test_race_filter_keeps_missing(spark):
    from somnolyt.operators import recode
    df = spark.createDataFrame([(1, "Unknown"), (2, "OTHER"), (3, None), (4, "white")],
                               "patient_id long, nsrr_race string")
    assert [r.patient_id for r in recode.filter_undefined_race(df).collect()] == [3, 4]
