"""Profiling operators: each returns a tall DataFrame (one row per column,
pair, bin or group) built from one or two aggregation passes.

Columns are unpivoted with ``explode(array(struct(...)))`` so a single
shuffle keyed on the column name (after map-side partial aggregation)
profiles every column at once.  Where a second pass needs per-column
statistics (quartiles, bounds) those come from a one-row aggregation and are
inlined as literals, so no join is planned.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .gram import pair_correlations
from .quantiles import column_quantiles, exact_quantiles, sent


def unpivot(df: DataFrame, cols: list[str], value_type: str = "double",
            keep: list[str] | None = None) -> DataFrame:
    """(keep..., column, value) with one row per input row and column."""
    keep = keep or []
    structs = [F.struct(F.lit(c).alias("column"), F.col(c).cast(value_type).alias("value"))
               for c in cols]
    return df.select(*keep, F.explode(F.array(*structs)).alias("_kv")).select(
        *keep, "_kv.column", "_kv.value")


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75%, max per numeric column."""
    long = unpivot(df, cols)
    agg = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q")
    return agg.join(q, "column", "left").select("column", "count", "mean", "std", "min",
                      F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
                      F.col("_q")[2].alias("p75"), "max")


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) for non-missing values of each column (as text)."""
    return (unpivot(df, cols, "string").filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def top_values(df: DataFrame, cols: list[str], k: int = 8) -> DataFrame:
    """Top-k values per column by frequency (ties: smallest value first).

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so each partition sends at most k rows per column.
    """
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (value_counts(df, cols).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def describe_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, unique, top, freq per text column (top: most frequent, smallest
    on ties).  Aggregates only: no window over a column's distinct values."""
    counts = value_counts(df, cols)
    per_col = counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), F.max("n").alias("freq"))
    top = (counts.join(F.broadcast(per_col.select("column", "freq")), "column")
           .filter(F.col("n") == F.col("freq")).groupBy("column").agg(F.min("value").alias("top")))
    return per_col.join(top, "column").select("column", "count", "unique", "top", "freq")


def missing_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing count and percent per column."""
    structs = [F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("miss")) for c in cols]
    long = df.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    return long.groupBy("column").agg(
        F.count_if("miss").alias("n_missing"),
        (F.count_if("miss") * 100.0 / F.count(F.lit(1))).alias("pct_missing"))


def missing_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row missingness pattern ('1' = missing, schema order) and its count."""
    pattern = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return (df.select(pattern.alias("pattern")).groupBy("pattern")
              .agg(F.count(F.lit(1)).alias("n"))
              .withColumn("n_missing", F.length(F.regexp_replace("pattern", "0", "")).cast("int")))


def missing_correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation of missingness flags between columns that are sometimes
    (not always) missing; each pair once, empty if fewer than two qualify."""
    n_miss = df.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    n = n_miss["_n"]
    use = [c for c in cols if 0 < n_miss[c] < n]
    return pair_correlations(df.select(*[F.col(f"`{c}`").isNull().cast("double").alias(c) for c in use]), use)


def correlation_pairs(df: DataFrame, cols: list[str], symmetric: bool = False) -> DataFrame:
    """Pearson r for every pair (var1 = later column, var2 = earlier), using
    pairwise-complete rows: one pass of matrix products (``gram``).
    ``symmetric`` adds mirrored pairs and the unit diagonal."""
    half = pair_correlations(df, cols)
    if not symmetric:
        return half
    mirror = F.explode(F.array(
        F.struct(F.col("var1").alias("var1"), F.col("var2").alias("var2"), F.col("corr").alias("corr")),
        F.struct(F.col("var2").alias("var1"), F.col("var1").alias("var2"), F.col("corr").alias("corr"))))
    both = half.select(mirror.alias("s")).select("s.*")
    diag = df.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("var1"), F.lit(c).alias("var2"), F.lit(1.0).alias("corr")) for c in cols
    ])).alias("s")).select("s.*")
    return both.unionByName(diag)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Full symmetric matrix in long form (var1, var2, corr), diagonal 1."""
    return correlation_pairs(df, cols, symmetric=True)


def top_correlations(df: DataFrame, cols: list[str], threshold: float = 0.5, k: int = 10) -> DataFrame:
    """Strong pairs (|r| > threshold), strongest first, top k (the report)."""
    pairs = correlation_pairs(df, cols).filter(F.abs("corr") > threshold)
    w = Window.orderBy(F.desc(F.round(F.abs("corr"), 6)), "var1", "var2")
    # at most p(p-1)/2 rows, produced from a single-row aggregate: one task is the natural size
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def distinct_counts(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Number of distinct non-missing values per column."""
    agg = F.count_distinct if exact else (lambda c: F.approx_count_distinct(c, 0.01))
    one = df.agg(*[agg(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"d{i}").cast("long").alias("n_distinct"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")


def continuous_columns(df: DataFrame, prefix: str = "nsrr_", min_distinct: int = 5) -> list[str]:
    """Numeric columns with the prefix and more than ``min_distinct`` values."""
    cand = [f.name for f in df.schema.fields
            if f.name.startswith(prefix) and isinstance(f.dataType, T.NumericType)]
    if not cand:
        return []
    counts = {r["column"]: r["n_distinct"] for r in distinct_counts(df, cand).collect()}
    return [c for c in cand if counts[c] > min_distinct]


# ---------------------------------------------------------------- histograms

def auto_bins(n: int, vmin: float, vmax: float, q1: float, q3: float) -> int:
    """numpy 'auto' rule: the smaller of the Sturges and Freedman-Diaconis widths."""
    ptp = vmax - vmin
    if n == 0 or ptp == 0:
        return 1
    sturges = ptp / (math.log2(n) + 1.0)
    fd = 2.0 * (q3 - q1) * math.pow(n, -1.0 / 3.0)
    width = min(fd, sturges) if fd > 0 else sturges
    return max(1, int(math.ceil(ptp / width)))


def histogram(df: DataFrame, col: str, bins: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed), with density.

    One stats job (min, max, n) and, unless ``bins`` is given, one for the
    quartiles of the bin rule; then one grouped count with literal edges.  With ``by`` each group's density is
    normalised by its own count.
    """
    by = by or []
    x = F.col(col).cast("double")
    st = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.count(x).alias("n")).first()
    if st["n"] == 0:
        return df.sparkSession.createDataFrame(
            [], "bin int, lower double, upper double, n long, density double")
    nb = bins or auto_bins(st["n"], st["mn"], st["mx"], *column_quantiles(df, [col], [0.25, 0.75])[col])
    mn, mx = st["mn"], st["mx"]
    span = (mx - mn) if mx > mn else 1.0
    width = span / nb
    b = F.least(F.floor((x - F.lit(mn)) / F.lit(span) * F.lit(nb)).cast("int"), F.lit(nb - 1))
    counts = df.filter(x.isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    tot = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    # groups x bins rows: bounded by the bin count per group
    return counts.select(*by, "bin",
                         (F.lit(mn) + F.col("bin") * F.lit(width)).alias("lower"),
                         (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
                         "n",
                         (F.col("n") / (F.sum("n").over(tot) * F.lit(width))).alias("density"))


def binned_pairs(df: DataFrame, cols: list[str], bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """2-D binned counts for every pair of columns (and group): the bounded
    table behind a pair plot."""
    by = by or []
    st = df.agg(*[F.min(c).alias(f"mn_{c}") for c in cols], *[F.max(c).alias(f"mx_{c}") for c in cols]).first()

    def bin_of(c):
        mn, mx = st[f"mn_{c}"], st[f"mx_{c}"]
        span = (mx - mn) if (mx is not None and mx > mn) else 1.0
        place = F.floor((F.col(c) - F.lit(mn)) / F.lit(span) * bins).cast("int")
        return F.when(F.col(c).isNotNull(), F.least(place, F.lit(bins - 1)))  # least() alone skips NULL

    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    structs = [F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"),
                        bin_of(a).alias("bin_x"), bin_of(b).alias("bin_y")) for a, b in pairs]
    long = df.select(*by, F.explode(F.array(*structs)).alias("s")).select(*by, "s.*")
    return (long.filter(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
            .groupBy(*by, "var_x", "var_y", "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- box plots

def boxplot_stats(df: DataFrame, cols: list[str], by: list[str] | None = None,
                  whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (last value inside 1.5*IQR) and flier count per
    column (and group).  Pass 1: quartiles per (group, column); pass 2 joins
    the quartile table (groups x columns rows) back."""
    by = by or []
    keys = by + ["column"]
    long = unpivot(df, cols, keep=by).filter(F.col("value").isNotNull())
    q = exact_quantiles(long, keys, "value", [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q")
    q = q.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                 F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    q = q.select("*", (F.col("q1") - whisker * (F.col("q3") - F.col("q1"))).alias("_lo"),
                 (F.col("q3") + whisker * (F.col("q3") - F.col("q1"))).alias("_hi"))
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    j = long.join(sent(q), cond)
    inside = (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_fliers"))
