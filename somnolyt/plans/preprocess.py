"""End-to-end cohort preprocessing (recode -> sparse rows -> impute ->
sequential outliers -> age range -> derived features and targets)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import features, impute, outliers, recode
from ..session import materialize
from ..sources.cohort import KEY


def preprocess_cohort(df: DataFrame, strategy: str = "knn", key: str = KEY,
                      exclude_from_impute: list[str] | None = None,
                      return_audit: bool = False):
    """Returns the preprocessed cohort (and the outlier audit if asked).

    The imputed frame is materialised once (checkpoint when the session
    names a checkpoint folder), because the sequential outlier rule scans
    it once per column.
    """
    df = recode.recode_categories(df)
    num_cols = recode.numeric_columns(df, key)
    df = recode.drop_sparse_rows(df, 0.5, key)
    df = impute.impute(df, strategy, num_cols, key, exclude_cols=exclude_from_impute)
    df = materialize(df)
    df, audit = outliers.outlier_filter_sequential(df, num_cols, key=key)
    df = recode.filter_age_range(df)
    df = features.add_derived_features(df)
    return (df, audit) if return_audit else df
