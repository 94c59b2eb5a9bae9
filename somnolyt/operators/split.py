"""Deterministic draws, exact per-group row numbers at scale, stratified
train/test split and stratified folds.

Draws are ``md5``-based so they are stable under repartitioning and equal in
Spark and DuckDB: ``u = int(first 8 hex digits of md5(text)) / 2^32``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def uniform(*parts) -> Column:
    """u in [0, 1) from md5 of the '|'-joined parts (Columns or literals)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(TWO32)


def _bucketed(df: DataFrame, by: list[str], order: list[Column], bucket: Column) -> DataFrame:
    """Adds _rn (number within group and bucket), _off (rows of the group's
    earlier buckets) and _n (rows of the group).  Groups and buckets compare
    null-safe, so rows of a missing group are numbered like any other."""
    b = df.withColumn("_bkt", bucket)
    w = Window.partitionBy(*by, "_bkt").orderBy(*order)
    local = b.withColumn("_rn", F.row_number().over(w))
    counts = b.groupBy(*by, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    group = Window.partitionBy(*by)
    offs = counts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_bkt"])],
        F.coalesce(F.sum("_cnt").over(group.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_cnt").over(group).alias("_n"))
    same = F.lit(True)
    for i, c in enumerate([*by, "_bkt"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return local.join(offs, same).drop("_bkt", *[f"_k{i}" for i in range(len(by) + 1)])


def exact_row_number(df: DataFrame, by: list[str], order: list[Column], bucket: Column,
                     name: str = "rn") -> DataFrame:
    """``row_number() over (partition by by order by order)`` without
    sending a whole group to one task.

    ``bucket`` must be non-decreasing in the order (e.g. ``floor(u * nb)``
    for a uniform order key, or ``even_buckets``).  Rows are numbered inside
    (group, bucket) and shifted by the running count of earlier buckets; the
    bucket-count table has groups x buckets rows and is joined back.  The
    result equals the plain window, missing groups included.
    """
    return (_bucketed(df, by, order, bucket)
            .withColumn(name, (F.col("_off") + F.col("_rn")).cast("long")).drop("_rn", "_off", "_n"))


def n_buckets(n_rows: int, rows_per_bucket: int) -> int:
    return max(1, math.ceil(n_rows / rows_per_bucket))


#: Buckets of a class in the uniform draw: a task numbers about 1 / 1024 of it.
DRAW_BUCKETS = 1024


def _ranked(df: DataFrame, label: str, key: str, seed: int, tag: str, rows_per_bucket: int | None) -> DataFrame:
    """Adds _u, _rank and _n (class size) from one count table.  With
    ``rows_per_bucket`` the largest class is counted first to size the buckets."""
    df = df.withColumn("_u", uniform(F.lit(seed), F.col(key), F.lit(tag)))
    n = DRAW_BUCKETS
    if rows_per_bucket is not None:
        n = n_buckets(df.groupBy(label).count().agg(F.max("count")).first()[0] or 0, rows_per_bucket)
    return (_bucketed(df, [label], [F.col("_u"), F.col(key)], F.floor(F.col("_u") * n))
            .withColumn("_rank", (F.col("_off") + F.col("_rn")).cast("long")).drop("_rn", "_off"))


def stratified_split(df: DataFrame, label: str = "label", key: str = "row_id",
                     test_size: float = 0.2, seed: int = 42,
                     rows_per_bucket: int | None = None) -> DataFrame:
    """Adds ``split`` ('train' / 'test'): per class, the rows ranked first by
    md5(seed, key) form the test set, ``floor(test_size * n + 0.5)`` of them.
    Rows without a label are a class of their own."""
    r = _ranked(df, label, key, seed, "split", rows_per_bucket)
    n_test = F.floor(F.lit(test_size) * F.col("_n") + F.lit(0.5))
    return (r.withColumn("split", F.when(F.col("_rank") <= n_test, "test").otherwise("train"))
             .drop("_u", "_rank", "_n"))


def stratified_folds(df: DataFrame, label: str = "label", key: str = "row_id",
                     k: int = 5, seed: int = 42, rows_per_bucket: int | None = None) -> DataFrame:
    """Adds ``fold`` in 0..k-1: per class, ``(rank - 1) % k`` in md5 order.
    Rows without a label are a class of their own."""
    r = _ranked(df, label, key, seed, "fold", rows_per_bucket)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_u", "_rank", "_n")
