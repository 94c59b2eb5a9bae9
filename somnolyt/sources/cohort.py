"""Cohort sources: driver tables, the patient cohort view, CSV ingest, literal rows.

The cohort view is a pure function of ``customer.c_custkey`` (see FIXTURES.md
section 3).  The same expression list feeds both the Spark projection and the
DuckDB oracle, so the two can never drift apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "patient_id"

# The cohort fixture (FIXTURES.md section 3), column -> SQL expression.
COHORT_COLUMNS: list[tuple[str, str]] = [
    ("patient_id", "c_custkey"),
    ("nsrr_age", "CAST(24 + (c_custkey * 37) % 56 AS DOUBLE)"),
    ("nsrr_sex", "CASE WHEN (c_custkey * 7919) % 101 < 52 THEN 'Male' ELSE 'female' END"),
    ("nsrr_race", """CASE WHEN c_custkey % 101 = 0 THEN NULL
       WHEN (c_custkey * 31) % 100 < 55 THEN 'white'
       WHEN (c_custkey * 31) % 100 < 74 THEN 'Black or African American'
       WHEN (c_custkey * 31) % 100 < 79 THEN 'american indian or alaska native'
       WHEN (c_custkey * 31) % 100 < 84 THEN 'multiple'
       WHEN (c_custkey * 31) % 100 < 87 THEN 'native hawaiian or other pacific islander'
       WHEN (c_custkey * 31) % 100 < 94 THEN 'asian'
       WHEN (c_custkey * 31) % 100 < 97 THEN 'Unknown'
       WHEN (c_custkey * 31) % 100 < 99 THEN 'other' END"""),
    ("nsrr_ethnicity", """CASE WHEN c_custkey % 101 = 0 THEN NULL
       WHEN (c_custkey * 17) % 23 < 9 THEN 'hispanic or latino'
       WHEN (c_custkey * 17) % 23 < 22 THEN 'not hispanic or latino' END"""),
    ("nsrr_current_smoker", """CASE WHEN c_custkey % 101 = 0 THEN NULL
       WHEN (c_custkey * 11) % 29 < 6 THEN 'yes'
       WHEN (c_custkey * 11) % 29 < 28 THEN 'no' ELSE 'not reported' END"""),
    ("nsrr_ever_smoker", """CASE WHEN c_custkey % 101 = 0 THEN NULL
       WHEN (c_custkey * 23) % 31 < 14 THEN 'yes'
       WHEN (c_custkey * 23) % 31 < 30 THEN 'no' ELSE 'not reported' END"""),
    ("nsrr_bmi", """CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 101 <> 0
       THEN CAST(165 + (c_custkey * 53) % 270 AS DOUBLE) / 10 END"""),
    ("nsrr_bp_systolic", """CASE WHEN c_custkey % 17 = 0 OR c_custkey % 101 = 0 THEN NULL
       WHEN c_custkey % 251 = 0 THEN CAST(900 AS DOUBLE)
       ELSE CAST(92 + (c_custkey * 29) % 97 AS DOUBLE) END"""),
    ("nsrr_bp_diastolic", """CASE WHEN c_custkey % 19 <> 0 AND c_custkey % 101 <> 0
       THEN CAST(56 + (c_custkey * 41) % 67 AS DOUBLE) END"""),
    ("nsrr_ahi_hp3r_aasm15", """CASE WHEN c_custkey % 101 = 0 THEN NULL
       ELSE CAST(((c_custkey * 37) % 56) * 2 + (c_custkey * 53) % 270 + (c_custkey * 97) % 140 - 150
          + ABS(((c_custkey * 37) % 56) * 2 + (c_custkey * 53) % 270 + (c_custkey * 97) % 140 - 150)
          AS DOUBLE) / 20 END"""),
    ("apnea_central", "CASE WHEN (c_custkey * 59) % 100 < 12 THEN 1 ELSE 0 END"),
    ("apnea_obstructiva", "CASE WHEN (c_custkey * 61) % 100 < 45 THEN 1 ELSE 0 END"),
]

# Columns dropped at load.
EXCLUDED_AT_LOAD = ["apnea_binary", "apnea_category"]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cohort_sql() -> str:
    """The cohort view as SQL text over ``customer`` (used by the oracle)."""
    cols = ",\n  ".join(f"{expr} AS {name}" for name, expr in COHORT_COLUMNS)
    return f"SELECT\n  {cols}\nFROM customer"


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient cohort derived from ``customer``: one row per patient.  A table of
    few splits (its keys are small) is dealt to all cores."""
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    cores = spark.sparkContext.defaultParallelism
    if customer.rdd.getNumPartitions() < cores:
        customer = customer.repartition(cores)
    return customer.selectExpr(*[f"{expr} AS {name}" for name, expr in COHORT_COLUMNS])


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN -> NULL for floating columns; text 'nan'/'na'/'' -> NULL.

    pandas treats all of these as missing; Spark would otherwise keep NaN as
    a value that compares greater than every number.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.when(F.lower(F.trim(c)).isin("", "nan", "na", "n/a", "null"),
                              F.lit(None).cast("string")).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def drop_columns(df: DataFrame, cols=EXCLUDED_AT_LOAD, strict: bool = False) -> DataFrame:
    """Drop configured columns; with ``strict`` a missing name raises."""
    missing = [c for c in cols if c not in df.columns]
    if strict and missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*[c for c in cols if c in df.columns])


def load_cohort(spark: SparkSession, path: str, fmt: str = "csv",
                schema: T.StructType | None = None, key: str | None = KEY) -> DataFrame:
    """Read a cohort file (CSV with header, or Parquet), normalise missing
    values, drop the configured columns and make sure a row key exists."""
    if fmt == "csv":
        reader = spark.read.option("header", True).option("nanValue", "NaN")
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    df = drop_columns(normalize_missing(df))
    if key and key not in df.columns:
        # A key from the row's content and its number among equal rows, so
        # that it does not change when the files are split another way.
        content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        nth = F.row_number().over(Window.partitionBy(content).orderBy(content))
        df = df.withColumn(key, F.xxhash64(content, nth))
    return df


# The literal scoring patient.
LITERAL_PATIENT = {
    "nsrr_age": 30.0,
    "nsrr_sex": "female",
    "nsrr_bmi": 38.8829556,
    "nsrr_bp_systolic": 97.0,
    "nsrr_bp_diastolic": 66.0,
    "nsrr_current_smoker": "no",
    "nsrr_ever_smoker": "no",
}

LITERAL_SCHEMA = T.StructType([
    T.StructField(KEY, T.LongType(), False),
    T.StructField("nsrr_age", T.DoubleType()),
    T.StructField("nsrr_sex", T.StringType()),
    T.StructField("nsrr_bmi", T.DoubleType()),
    T.StructField("nsrr_bp_systolic", T.DoubleType()),
    T.StructField("nsrr_bp_diastolic", T.DoubleType()),
    T.StructField("nsrr_current_smoker", T.StringType()),
    T.StructField("nsrr_ever_smoker", T.StringType()),
])


def literal_patients(spark: SparkSession, rows: list[dict] | None = None,
                     first_id: int = -1) -> DataFrame:
    """In-memory rows (new patients to score) as a DataFrame."""
    rows = rows or [LITERAL_PATIENT]
    data = [tuple([first_id - i] + [r.get(f.name) for f in LITERAL_SCHEMA.fields[1:]])
            for i, r in enumerate(rows)]
    return spark.createDataFrame(data, LITERAL_SCHEMA)
