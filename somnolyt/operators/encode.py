"""Model-matrix operators: rare-category grouping, one-hot by fitted levels,
robust and standard scaling, class weights.

Fitting returns small parameter tables (levels, medians, IQRs, means) so the
same transform can be applied at scoring time (train/serve parity).  The
apply step is a single projection with literal parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import column_quantiles

from . import profile

OTHER = "Otros"


def fit_rare_categories(df: DataFrame, cols: list[str], max_levels: int = 10,
                        keep: int = 8) -> dict[str, list[str] | None]:
    """Per column: the kept top values when there are more than
    ``max_levels`` distinct values, else None (column left as is)."""
    if not cols:
        return {}
    distinct = {r["column"]: r["n_distinct"] for r in profile.distinct_counts(df, cols).collect()}
    wide = [c for c in cols if distinct[c] > max_levels]
    kept: dict[str, list[str] | None] = {c: None for c in cols}
    if wide:
        # top-k rows per column only: bounded by keep * len(wide)
        for r in profile.top_values(df, wide, keep).collect():
            kept.setdefault(r["column"], None)
            kept[r["column"]] = (kept[r["column"]] or []) + [r["value"]]
    return kept


def apply_rare_categories(df: DataFrame, kept: dict[str, list[str] | None]) -> DataFrame:
    out = []
    for c in df.columns:
        levels = kept.get(c)
        if levels is not None:
            x = F.col(c).cast("string")
            out.append(F.when(x.isin(*levels), x).otherwise(F.lit(OTHER)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def fit_levels(df: DataFrame, cols: list[str],
               ordered: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Levels per column: a fixed ordered list (binned columns: every level,
    seen or not) or the sorted observed values."""
    ordered = ordered or {}
    levels = {c: list(ordered[c]) for c in cols if c in ordered}
    free = [c for c in cols if c not in ordered]
    if free:
        seen: dict[str, list[str]] = {c: [] for c in free}
        # distinct values per categorical column: small by construction
        for r in profile.value_counts(df, free).select("column", "value").collect():
            seen[r["column"]].append(r["value"])
        for c in free:
            levels[c] = sorted(seen[c])
    return levels


def one_hot(df: DataFrame, levels: dict[str, list[str]], drop_first: bool = True,
            prefix_sep: str = "_") -> DataFrame:
    """One 0/1 int column per level (first level dropped); missing -> all 0.
    Dummy columns go to the end in column order; the source column is dropped."""
    keep = [F.col(c) for c in df.columns if c not in levels]
    dummies = []
    for c, lv in levels.items():
        use = lv[1:] if drop_first else lv
        x = F.col(c).cast("string")
        dummies += [F.coalesce((x == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}{prefix_sep}{v}")
                    for v in use]
    return df.select(*keep, *dummies)


@dataclass
class Scaling:
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.center:
                x = F.col(c).cast("double")
                out.append(((x - F.lit(self.center[c])) / F.lit(self.scale[c])).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)

    def table(self, spark) -> DataFrame:
        rows = [(c, float(self.center[c]), float(self.scale[c])) for c in self.center]
        return spark.createDataFrame(rows, "feature string, center double, scale double")


def fit_robust(df: DataFrame, cols: list[str]) -> Scaling:
    """Median and interquartile range per column (missing ignored); a zero
    range scales by 1."""
    row = column_quantiles(df, cols, [0.25, 0.5, 0.75])
    s = Scaling()
    for c in cols:
        q1, med, q3 = row[c] if row[c] is not None else (0.0, 0.0, 1.0)
        iqr = q3 - q1
        s.center[c] = med
        s.scale[c] = iqr if iqr != 0 else 1.0
    return s


def fit_standard(df: DataFrame, cols: list[str]) -> Scaling:
    """Mean and population standard deviation; zero deviation scales by 1."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    s = Scaling()
    for c in cols:
        sd = row[f"s_{c}"]
        s.center[c] = row[f"m_{c}"]
        s.scale[c] = sd if sd else 1.0
    return s


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """'balanced' weights n / (k * n_class) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # one row per class: a window over the whole (tiny) count table
    allc = Window.partitionBy(F.lit(1))
    return counts.select(label, "n", (F.sum("n").over(allc) /
                                      (F.count(F.lit(1)).over(allc) * F.col("n"))).alias("weight"))


def numeric_feature_columns(df: DataFrame, exclude: list[str]) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
