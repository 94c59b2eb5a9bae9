"""Category recoding and row filters (pure projections / filters).

Every function is ``DataFrame -> DataFrame`` and can be chained with
``df.transform``.  Column guards are analysis-time checks on ``df.columns``;
they never launch a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clinical as C
from ..sources.cohort import KEY


def recode_categories(df: DataFrame) -> DataFrame:
    """Lower-case text categories and map them to numeric codes (double).

    Numeric columns are left as they are; the race filter (rows whose race is
    'unknown' / 'other') runs on the lower-cased text before mapping and
    keeps rows with a missing race.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    text = [c for c in C.CODE_MAPS if c in types and isinstance(types[c], T.StringType)]
    if "nsrr_race" in text:
        df = df.filter(~F.coalesce(F.lower(F.col("nsrr_race")).isin(*C.RACE_DROPPED), F.lit(False)))
    out = [C.code(F.col(c), C.CODE_MAPS[c]).alias(c) if c in text else F.col(c) for c in df.columns]
    return df.select(*out)


def filter_undefined_race(df: DataFrame) -> DataFrame:
    """Drop rows whose race is 'unknown' or 'other' (any case); keep missing."""
    if "nsrr_race" not in df.columns:
        return df
    return df.filter(~F.coalesce(F.lower(F.col("nsrr_race")).isin(*C.RACE_DROPPED), F.lit(False)))


def missing_ratio(df: DataFrame, key: str = KEY) -> F.Column:
    cols = [c for c in df.columns if c != key]
    n_missing = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return n_missing / F.lit(float(len(cols)))


def drop_sparse_rows(df: DataFrame, threshold: float = 0.5, key: str = KEY) -> DataFrame:
    """Keep rows whose share of missing cells (over all non-key columns) is
    at most ``threshold``."""
    return df.filter(missing_ratio(df, key) <= F.lit(threshold))


def filter_age_range(df: DataFrame, lo: float = C.AGE_MIN, hi: float = C.AGE_MAX) -> DataFrame:
    """Inclusive age range; a missing age drops the row."""
    if "nsrr_age" not in df.columns:
        return df
    return df.filter(F.col("nsrr_age").between(lo, hi))


def numeric_columns(df: DataFrame, key: str | None = KEY) -> list[str]:
    """Columns of numeric type in schema order, excluding the row key."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name != key]


def text_columns(df: DataFrame, key: str | None = KEY) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name != key]


def coerce_numeric(df: DataFrame, cols: list[str] | None = None, key: str = KEY) -> DataFrame:
    """Text to number with bad text -> NULL (``try_cast`` keeps ANSI mode on)."""
    cols = cols if cols is not None else [c for c in df.columns if c != key]
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def fill_and_finite(df: DataFrame, cols: list[str] | None = None, key: str = KEY) -> DataFrame:
    """Leftover missing values -> 0 and +/-inf -> 0."""
    cols = cols if cols is not None else numeric_columns(df, key)
    inf = float("inf")
    out = []
    for c in df.columns:
        if c in cols:
            x = F.col(c).cast("double")
            out.append(F.when(x.isNull() | F.isnan(x) | x.isin(inf, -inf), F.lit(0.0))
                       .otherwise(x).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
