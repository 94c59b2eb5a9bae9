"""Imputation: mean / median / most-frequent / k-nearest-neighbour.

Simple strategies learn one value per column in a single aggregation (one
job, map-side partial aggregation) and apply it as ``coalesce(c, value)``.
The kNN strategy is a distributed block nested-loop kNN join (see knn.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cohort import KEY
from .quantiles import column_quantiles
from .recode import numeric_columns


def _as_double(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def fit_simple(df: DataFrame, cols: list[str], strategy: str = "mean") -> dict[str, float | None]:
    """Learn one fill value per column (driver receives one small row)."""
    if not cols:
        return {}
    if strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
        return row.asDict()
    if strategy == "median":
        found = column_quantiles(df, cols, [0.5])
        return {c: q[0] if q else None for c, q in found.items()}
    if strategy == "most_frequent":
        # one row per column: bounded by the column count
        return {r["column"]: r["value"] for r in most_frequent(df, cols).collect()}
    raise ValueError(f"unknown strategy {strategy!r}")


def most_frequent(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) of the most frequent value per column, smallest on ties.

    Columns are unpivoted so one shuffle on (column, value) counts all of them;
    the ranking window then works on distinct values only.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value").filter(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rk", F.row_number().over(w)).filter("rk = 1").drop("rk")


def apply_fill(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    out = []
    for c in df.columns:
        if c in values:
            v = values[c]
            x = F.col(c).cast("double")
            out.append((F.coalesce(x, F.lit(float(v))) if v is not None else x).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def impute_simple(df: DataFrame, strategy: str = "mean", cols: list[str] | None = None,
                  key: str = KEY) -> DataFrame:
    cols = cols if cols is not None else numeric_columns(df, key)
    return apply_fill(df, fit_simple(df, cols, strategy))


def impute_mean(df, cols=None, key=KEY):
    return impute_simple(df, "mean", cols, key)


def impute_median(df, cols=None, key=KEY):
    return impute_simple(df, "median", cols, key)


def impute_mode(df, cols=None, key=KEY):
    return impute_simple(df, "most_frequent", cols, key)


def impute(df: DataFrame, strategy: str = "knn", cols: list[str] | None = None,
           key: str = KEY, k: int = 7, exclude_cols: list[str] | None = None) -> DataFrame:
    cols = cols if cols is not None else numeric_columns(df, key)
    if exclude_cols:
        cols = [c for c in cols if c not in exclude_cols]
    if strategy == "knn":
        from .knn import knn_impute
        return knn_impute(df, cols, key=key, k=k)
    return _as_double(impute_simple(df, strategy, cols, key), cols)
