"""Principal components from the Gram sums of one pass.

The covariance of p columns is read off the masked Gram sums (one row a pair),
and the p x p matrix is solved on the driver, so what is collected grows with
the columns only; ``MAX_COLUMNS`` bounds it.  The sign of a component is fixed:
its entry of largest size is positive (the first of equals, to nine places).

Missing and NaN values take no part in the covariance (pairwise complete) and
count as 0 in the projection.  Rows are projected as they are, not centred.
Columns without two values to compare have covariance 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gram

MAX_COLUMNS = 2000


@dataclass
class Components:
    columns: list[str]
    #: (k,) variances, descending, and (k, p) unit loadings.
    variances: np.ndarray
    loadings: np.ndarray
    #: Sum of the variances of all columns.
    total: float

    def table(self, spark) -> DataFrame:
        """(component, feature, loading, variance, share)."""
        rows = [(c, name, float(self.loadings[c, i]), float(v), float(v / self.total) if self.total > 0 else None)
                for c, v in enumerate(self.variances) for i, name in enumerate(self.columns)]
        return spark.createDataFrame(rows, "component int, feature string, loading double, variance double, share double")

    def project(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """(keep..., component, value): a projection of each row, no shuffle."""
        def term(c, weight):
            x = F.col(f"`{c}`").cast("double")
            return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)) * F.lit(float(weight))
        values = [sum((term(c, w) for c, w in zip(self.columns, weights)), F.lit(0.0)) for weights in self.loadings]
        return df.select(*keep, F.posexplode(F.array(*values)).alias("component", "value"))


def covariance(df: DataFrame, cols: list[str]) -> np.ndarray:
    """p x p sample covariance, pairwise complete."""
    if not 2 <= len(cols) <= MAX_COLUMNS:
        raise ValueError(f"between 2 and {MAX_COLUMNS} columns, not {len(cols)}")
    out = np.zeros((len(cols), len(cols)))
    for r in gram.pair_sums(df, cols).collect():  # p (p - 1) / 2 rows
        if r.n > 1:
            out[r.i, r.j] = out[r.j, r.i] = (r.sxy - r.sx * r.sy / r.n) / (r.n - 1)
    single = df.agg(*[F.var_samp(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))).alias(f"_{i}")
                      for i, c in enumerate(cols)]).first()
    np.fill_diagonal(out, [0.0 if v is None else v for v in single])
    return out


def fit(df: DataFrame, cols: list[str], k: int = 2) -> Components:
    """The k components of largest variance."""
    cov = covariance(df, cols)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values, kind="stable")[:k]
    loadings = vectors[:, top].T
    for row in loadings:
        if row[np.argmax(np.round(np.abs(row), 9))] < 0:
            row *= -1
    return Components(list(cols), values[top], loadings, float(np.trace(cov)))
