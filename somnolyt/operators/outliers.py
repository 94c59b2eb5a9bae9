"""Interquartile-range outlier rules.

``outlier_filter_sequential`` reproduces the order-dependent rule: each
column's quartiles are computed on the rows left by earlier columns.  Columns
are measured several at once over a materialised input (one exact quantile
computation, see ``quantiles``, and one count); what was measured ahead holds
until a column removes rows, and the columns after it are measured again.  So
the passes go with the columns that remove rows, not with all columns.  The
predicates are literals, so the plan grows by one filter per such column.  ``simultaneous=True`` takes every column's
bounds from the whole input instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import is_materialized, materialize
from ..sources.cohort import KEY
from .quantiles import column_quantiles
from .recode import numeric_columns

# Columns never filtered by the 3*IQR rule.
CRITICAL = ["nsrr_ahi_hp3r_aasm15", "nsrr_bmi", "nsrr_age"]

#: Columns measured at once at first; twice as many after each run of columns
#: without a removal, half as many after one with it.
FIRST_WIDTH = 8

AUDIT_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("q1", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
    T.StructField("lower", T.DoubleType()),
    T.StructField("upper", T.DoubleType()),
    T.StructField("n_outliers", T.LongType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("action", T.StringType()),
])


def outlier_filter_sequential(df: DataFrame, cols: list[str] | None = None,
                              skip: list[str] = CRITICAL, factor: float = 3.0,
                              max_share: float = 0.05,
                              key: str = KEY, skip_cols: list[str] | None = None,
                              simultaneous: bool = False):
    """Return ``(filtered_df, audit_df)``.

    For each numeric column (schema order, skipping ``skip``): bounds are
    ``q1 - factor*iqr`` / ``q3 + factor*iqr`` (strict); rows outside are
    removed only when they are fewer than ``max_share`` of the current rows.
    Rows whose value is missing are kept.

    ``simultaneous``: bounds and counts of all columns come from the rows given,
    not from those that earlier columns left, so any number of columns costs
    one quantile computation and one count.
    """
    cols = cols if cols is not None else numeric_columns(df, key)
    cols = [c for c in cols if c not in skip and c not in (skip_cols or [])]
    base = df if is_materialized(df) else materialize(df)
    spark = df.sparkSession
    if not cols:
        return base, spark.createDataFrame([], AUDIT_SCHEMA)

    keep, audit = F.lit(True), []
    width = len(cols) if simultaneous else FIRST_WIDTH
    while len(audit) < len(cols):
        ahead = cols[len(audit):len(audit) + width]
        removed = False
        for c, bounds, n_out, n in _measured(base.filter(keep), ahead, factor):
            removed = 0 < n_out < n * max_share
            audit.append(_audit_row(len(audit), c, bounds, factor, n_out, n, removed))
            if removed:
                keep = keep & ~_outside(c, bounds, factor)
                if not simultaneous:
                    break  # what was measured for later columns holds for other rows
        width = max(1, width // 2) if removed else 2 * width
    return base.filter(keep), spark.createDataFrame(audit, AUDIT_SCHEMA)


def _measured(rows: DataFrame, cols: list[str], factor: float) -> list[tuple]:
    """(column, quartiles, n_outliers, n_rows) of each column over the same rows."""
    quartiles = {c: tuple(q or (None, None)) for c, q in column_quantiles(rows, cols, [0.25, 0.75]).items()}
    n, *n_out = rows.agg(F.count(F.lit(1)), *[F.count_if(_outside(c, quartiles[c], factor)).alias(f"n{i}")
                                              for i, c in enumerate(cols)]).first()
    return [(c, quartiles[c], n_out[i], n) for i, c in enumerate(cols)]


def _outside(c: str, quartiles: tuple, factor: float) -> F.Column:
    """Beyond the bounds; a missing value is not."""
    return F.coalesce(_is_out(c, *quartiles, factor), F.lit(False))


def _is_out(c: str, q1, q3, factor: float) -> F.Column:
    if q1 is None or q3 is None:
        return F.lit(False)
    iqr = q3 - q1
    lo, hi = q1 - factor * iqr, q3 + factor * iqr
    x = F.col(c).cast("double")
    return (x < F.lit(lo)) | (x > F.lit(hi))


def _audit_row(i, c, q, factor, n_out, n, removed):
    q1, q3 = q
    lo = hi = None
    if q1 is not None:
        iqr = q3 - q1
        lo, hi = q1 - factor * iqr, q3 + factor * iqr
    action = "none" if n_out == 0 else ("removed" if removed else "kept")
    return (i, c, q1, q3, lo, hi, int(n_out), int(n), action)


def outlier_summary(df: DataFrame, cols: list[str], factor: float = 1.5) -> DataFrame:
    """1.5*IQR profile per column: count, percent of all rows, min, max of
    outliers.  One job for quartiles (one small row to the driver), then a
    single lazily-planned pass over the unpivoted columns with literal
    bounds (partial aggregation map-side, a tiny shuffle on the column name).
    """
    qs = column_quantiles(df, cols, [0.25, 0.75])
    structs = []
    for c in cols:
        q1, q3 = (qs[c][0], qs[c][1]) if qs[c] is not None else (None, None)
        out = _is_out(c, q1, q3, factor)
        structs.append(F.struct(F.lit(c).alias("column"),
                                F.col(c).cast("double").alias("value"),
                                F.coalesce(out, F.lit(False)).alias("is_out")))
    long = df.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    return (long.groupBy("column").agg(
        F.count_if("is_out").alias("n_outliers"),
        F.round(F.count_if("is_out") * 100.0 / F.count(F.lit(1)), 6).alias("pct_outliers"),
        F.min(F.when(F.col("is_out"), F.col("value"))).alias("min_outlier"),
        F.max(F.when(F.col("is_out"), F.col("value"))).alias("max_outlier")))
