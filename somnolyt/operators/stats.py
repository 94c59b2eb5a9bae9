"""Statistics: Gaussian KDE, Welch t-test, group comparison table, ANOVA F,
mutual information.  All reduce data with Spark aggregations; Python only
adds per-task partial sums over a fixed 200-point grid for the KDE.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import exact_quantiles, sent

GRID = 200
CUT = 3.0
#: Groups whose grids a task holds at a time.
GROUPS_HELD = 1000


def kde(df: DataFrame, col: str, by: list[str] | None = None, grid: int = GRID,
        cut: float = CUT) -> DataFrame:
    """Gaussian KDE on a ``grid``-point line from min - cut*h to max + cut*h,
    Scott bandwidth ``h = std * n^(-1/5)``; per group when ``by`` is given.

    One aggregation gives each group's constants, which are joined to its rows;
    each task adds its rows' kernels to the grids of the groups it meets (at
    most GROUPS_HELD at a time) and a grouped sum finishes the density.  Groups
    of fewer than two values or without spread have no density.
    """
    by = by or []
    rows = df.select(*by, F.col(col).cast("double").alias(col)).filter(F.col(col).isNotNull())
    x, n, sd = F.col(col), F.count(col), F.stddev_samp(col)
    h = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    lo, hi = F.col("mn") - cut * F.col("_h"), F.col("mx") + cut * F.col("_h")
    st = (rows.groupBy(*by).agg(n.alias("n"), sd.alias("sd"), F.min(x).alias("mn"), F.max(x).alias("mx"))
          .filter((F.col("n") >= 2) & (F.col("sd") > 0)).withColumn("_h", h)
          .select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], "_h", lo.alias("_lo"),
                  ((hi - lo) / (grid - 1)).alias("_step"), F.col("n").alias("_n")))
    st, same = sent(st), F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))

    def with_constants(frame: DataFrame) -> DataFrame:
        return frame.join(st, same)
    schema = T.StructType([f for f in df.schema.fields if f.name in by] + [
        T.StructField("point", T.IntegerType()), T.StructField("part", T.DoubleType())])
    points = np.arange(grid)

    def held(acc):
        for g, s in acc.items():
            out = pd.DataFrame({"point": points.astype("int32"), "part": s})
            for i, b in enumerate(by):
                out.insert(i, b, [None if pd.isna(g[i]) else g[i]] * grid)
            yield out

    def partial(batches):
        acc = {}
        for pdf in batches:
            for g, sub in pdf.groupby([*by, "_h", "_lo", "_step"], dropna=False, sort=False):
                *names, width, start, step = g
                z = ((start + points * step)[None, :] - sub[col].to_numpy(dtype=float)[:, None]) / width
                key = tuple(names)
                acc[key] = acc.get(key, 0.0) + np.exp(-0.5 * z * z).sum(axis=0)
            if len(acc) > GROUPS_HELD:
                yield from held(acc)
                acc = {}
        yield from held(acc)

    parts = with_constants(rows).select(*by, col, "_h", "_lo", "_step").mapInPandas(partial, schema)
    summed = parts.groupBy(*by, "point").agg(F.sum("part").alias("_s"))
    norm = F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi)
    return with_constants(summed).select(*by, "point", (F.col("_lo") + F.col("point") * F.col("_step")).alias("x"),
                                         (F.col("_s") / norm).alias("density"))


def welch_ttest(df: DataFrame, group: str, values: list[str], a, b) -> DataFrame:
    """Per variable: n, mean, sample variance per group, Welch t and df.
    Each group needs more than one value (else t and df are NULL)."""
    tall = df.select(F.col(group).alias("_g"), F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in values])).alias("s"))
    ga, gb, x = F.col("_g") == F.lit(a), F.col("_g") == F.lit(b), F.col("s.x")
    rows = tall.groupBy(F.col("s.variable").alias("variable")).agg(
        F.count(F.when(ga, x)).alias("n1"), F.count(F.when(gb, x)).alias("n2"),
        F.avg(F.when(ga, x)).alias("mean1"), F.avg(F.when(gb, x)).alias("mean2"),
        F.var_samp(F.when(ga, x)).alias("var1"), F.var_samp(F.when(gb, x)).alias("var2"))
    se1 = F.col("var1") / F.col("n1")
    se2 = F.col("var2") / F.col("n2")
    ok = (F.col("n1") > 1) & (F.col("n2") > 1)
    t = F.when(ok, (F.col("mean1") - F.col("mean2")) / F.sqrt(se1 + se2))
    dof = F.when(ok, (se1 + se2) * (se1 + se2) /
                 (se1 * se1 / (F.col("n1") - 1) + se2 * se2 / (F.col("n2") - 1)))
    return rows.select("*", t.alias("t"), dof.alias("df"))


def _betacf(a, b, x, iters=300, eps=3e-16):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) (continued fraction)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    bt = math.exp(lbt)
    if x < (a + 1) / (a + b + 2):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1 - x) / b


def t_two_sided_p(t: float | None, dof: float | None) -> float | None:
    if t is None or dof is None or not math.isfinite(t) or dof <= 0:
        return None
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided Student-t p-value per row (applied to test-result rows only)."""
    return pd.Series([t_two_sided_p(None if pd.isna(a) else float(a), None if pd.isna(b) else float(b))
                      for a, b in zip(t, dof)], dtype=float)


def anova_f(tall: DataFrame, feature: str = "feature", value: str = "value", label: str = "label") -> DataFrame:
    """One-way ANOVA F per feature over the label classes."""
    per = tall.groupBy(feature, label).agg(F.count(value).alias("n_c"), F.avg(value).alias("m_c"),
                                           F.var_samp(value).alias("v_c"))
    tot = tall.groupBy(feature).agg(F.count(value).alias("n_all"), F.avg(value).alias("m_all"))
    j = per.join(tot, feature)
    dev = F.col("m_c") - F.col("m_all")
    agg = j.groupBy(feature).agg(
        F.sum(F.col("n_c") * dev * dev).alias("ssb"),
        F.sum(F.coalesce((F.col("n_c") - 1) * F.col("v_c"), F.lit(0.0))).alias("ssw"),
        F.count(F.lit(1)).alias("k"), F.first("n_all").alias("n_all"))
    f = F.when((F.col("ssw") != 0) & (F.col("k") >= 2),
               (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n_all") - F.col("k"))))
    return agg.select(feature, f.alias("f_score"))


def mutual_information(tall: DataFrame, feature: str = "feature", value: str = "value",
                       label: str = "label") -> DataFrame:
    """MI between a decile-binned feature and the label (natural log).
    bin = number of the nine deciles strictly below the value."""
    q = exact_quantiles(tall, [feature], value, [i / 10 for i in range(1, 10)]).withColumnRenamed("q", "dec")
    j = tall.join(sent(q), feature)
    j = j.select(feature, label, F.size(F.filter("dec", lambda d: d < F.col(value))).alias("bin"))
    joint = j.groupBy(feature, "bin", label).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    wf = Window.partitionBy(feature)
    wb = Window.partitionBy(feature, "bin")
    wy = Window.partitionBy(feature, label)
    p = joint.select(feature, (F.col("n") / F.sum("n").over(wf)).alias("pxy"),
                     (F.sum("n").over(wb) / F.sum("n").over(wf)).alias("px"),
                     (F.sum("n").over(wy) / F.sum("n").over(wf)).alias("py"))
    return p.groupBy(feature).agg(F.sum(F.col("pxy") * F.log(F.col("pxy") / (F.col("px") * F.col("py"))))
                                  .alias("mutual_info"))


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, else a continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    b, c = x + 1 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1.0 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * h


def chi2_p(statistic: float | None, dof: float | None) -> float | None:
    """Upper tail of the chi-squared distribution."""
    if statistic is None or dof is None or not math.isfinite(statistic) or dof <= 0:
        return None
    return gammainc_upper(dof / 2.0, statistic / 2.0)


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Chi-squared p-value per row (applied to test-result rows only)."""
    return pd.Series([chi2_p(None if pd.isna(a) else float(a), None if pd.isna(b) else float(b))
                      for a, b in zip(statistic, dof)], dtype=float)


def chi2_independence(counts: DataFrame, feature: str, level: str, group: str, n: str) -> DataFrame:
    """(feature, chi2, dof, p) of each feature's levels by group, from counts
    (feature, level, group, n).  Missing levels take no part.  With two rows and
    two columns the statistic is corrected for continuity.  Fewer than two
    levels or groups give no statistic.  A feature's contingency table is
    small: rows of all its levels meet by feature."""
    from pyspark.sql import Window
    cells = counts.filter(F.col(level).isNotNull()).select(feature, level, group, F.col(n).cast("double").alias("_o"))
    by = lambda *c: Window.partitionBy(feature, *c)
    cells = cells.select("*", F.sum("_o").over(by(level)).alias("_r"), F.sum("_o").over(by(group)).alias("_c"),
                         F.sum("_o").over(by()).alias("_n"))
    # cells that do not occur add their expected count
    sizes = cells.groupBy(feature).agg(F.count_distinct(level).alias("_rows"), F.count_distinct(group).alias("_cols"))
    e = F.col("_r") * F.col("_c") / F.col("_n")
    small = (F.col("_rows") == 2) & (F.col("_cols") == 2)
    off = F.abs(F.col("_o") - e)
    off = F.when(small, off - F.least(F.lit(0.5), off)).otherwise(off)
    got = cells.join(sizes, feature).groupBy(feature, "_rows", "_cols").agg(
        F.sum(off * off / e).alias("_s"), F.sum(e).alias("_e"), F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    # empty cells of a two by two table have equal expected counts, of what the others leave
    rest, holes = F.col("_n") - F.col("_e"), F.col("_rows") * F.col("_cols") - F.col("_k")
    short = rest / holes - F.least(F.lit(0.5), rest / holes)
    empty = F.when((F.col("_rows") == 2) & (F.col("_cols") == 2), holes * short * short * holes / rest).otherwise(rest)
    dof = (F.col("_rows") - 1) * (F.col("_cols") - 1)
    chi2 = F.when(dof > 0, F.col("_s") + F.when(holes > 0, empty).otherwise(0.0))
    out = got.select(feature, chi2.alias("chi2"), F.when(dof > 0, dof.cast("double")).alias("dof"))
    return out.withColumn("p", chi2_pvalue("chi2", "dof"))


def comparison_table(df: DataFrame, group: F.Column, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Features by group: n, missing, mean, std, median for numeric columns;
    count and percent (of the group's rows) per level for categorical ones.
    Rows whose group is missing are left out, and so are columns the frame
    does not have.

    ``statistic``, ``dof`` and ``p`` repeat on a feature's rows: Welch's t of a
    numeric column where there are two groups (the first in order less the
    second), chi-squared independence of a categorical one."""
    numeric, categorical = ([c for c in wanted if c in df.columns] for wanted in (numeric, categorical))
    g = df.select("*", group.alias("grp")).filter(F.col("grp").isNotNull())
    tall = g.select("grp", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in numeric
    ])).alias("s")).select("grp", "s.*")
    num = tall.groupBy("grp", "feature").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    medians = exact_quantiles(tall, ["grp", "feature"], "value", [0.5])
    num = num.join(medians, ["grp", "feature"], "left").select(
        "feature", F.lit(None).cast("string").alias("level"), "grp", "n", "n_missing", "mean", "std",
        F.col("q")[0].alias("median"), F.lit(None).cast("double").alias("pct"))
    num = num.join(_welch_of(tall).withColumnRenamed("feature", "_f"), F.col("feature") == F.col("_f"), "left").drop("_f")
    long = g.select("grp", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in categorical
    ])).alias("s")).select("grp", "s.feature", "s.level")
    from pyspark.sql import Window
    cat = long.groupBy("feature", "level", "grp").agg(F.count(F.lit(1)).alias("n"))
    tests = chi2_independence(cat, "feature", "level", "grp", "n").select(
        F.col("feature").alias("_f"), F.col("chi2").alias("statistic"), "dof", "p")
    cat = cat.select("feature", "level", "grp", "n", F.lit(None).cast("long").alias("n_missing"),
                     F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"),
                     F.lit(None).cast("double").alias("median"),
                     (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("feature", "grp"))).alias("pct"))
    return num.unionByName(cat.join(tests, F.col("feature") == F.col("_f"), "left").drop("_f"))


def _welch_of(tall: DataFrame) -> DataFrame:
    """(feature, statistic, dof, p): Welch's t between the two groups of (grp,
    feature, value); features with other than two groups have no row."""
    per = tall.groupBy("feature", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    two = per.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("grp", "n", "m", "v"))).alias("g")).filter(F.size("g") == 2)
    a, b = F.col("g")[0], F.col("g")[1]
    sa, sb = a["v"] / a["n"], b["v"] / b["n"]
    ok = (a["n"] > 1) & (b["n"] > 1) & (sa + sb > 0)
    out = two.select("feature", F.when(ok, (a["m"] - b["m"]) / F.sqrt(sa + sb)).alias("statistic"),
                     F.when(ok, (sa + sb) * (sa + sb) / (sa * sa / (a["n"] - 1) + sb * sb / (b["n"] - 1))).alias("dof"))
    return out.withColumn("p", t_pvalue("statistic", "dof"))
