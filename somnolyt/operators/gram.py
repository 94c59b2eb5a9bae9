"""Pairwise-complete sums of all column pairs as matrix products.

A task adds up, batch by batch, the products of the value matrix (missing
entries 0) and the mask of what is present: rows, sums, squares and products of
every pair over the rows that hold both.  Each task sends one row a pair, which
a grouped sum merges; no row of the table is copied per pair.  Values are moved
by a constant near their mean first, so large offsets cost no digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of n * sum(x^2) below which a spread is rounding, not spread.
FLAT = 1e-13


def shifts(df: DataFrame, cols: list[str]) -> list[float]:
    """A finite value near each column's mean; exactly the value of a constant column."""
    aggs = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
        aggs.append(F.struct(F.avg(x).alias("mean"), F.min(x).alias("lo"), F.max(x).alias("hi")))
    row = df.agg(*aggs).first()
    return [0.0 if r["lo"] is None else r["lo"] if r["lo"] == r["hi"] else r["mean"] for r in row]


def pair_sums(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) for i > j: sums over the rows that hold
    both columns, x of column i and y of column j, each moved by its shift.
    NaN counts as missing."""
    move, p = np.array(shifts(df, cols)), len(cols)

    def task(batches):
        total = np.zeros((4, p, p))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - move
            there = ~np.isnan(x)
            x, mask = np.where(there, x, 0.0), there.astype(float)
            total += mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x
        i, j = np.tril_indices(p, -1)
        n, s, ss, xy = total
        columns = [i.astype(np.int32), j.astype(np.int32), n[i, j].astype(np.int64), s[i, j], s[j, i], ss[i, j], ss[j, i], xy[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])
    values = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x"))
    parts = values.mapInArrow(task, "i int, j int, n long, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def pair_correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(var1, var2, corr) of every pair, var1 the later column; NULL where fewer
    than two rows hold both or one of them does not vary there."""
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, corr double")
    n = F.col("n")
    spread = {s: n * F.col(f"s{s}{s}") - F.col(f"s{s}") * F.col(f"s{s}") for s in "xy"}
    varies = (n >= 2) & (spread["x"] > FLAT * n * F.col("sxx")) & (spread["y"] > FLAT * n * F.col("syy"))
    r = F.when(varies, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(spread["x"]) * F.sqrt(spread["y"])))
    name = F.array(*[F.lit(c) for c in cols])
    return pair_sums(df, cols).select(name[F.col("i")].alias("var1"), name[F.col("j")].alias("var2"), r.alias("corr"))
