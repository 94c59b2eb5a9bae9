"""Nearest-neighbour mutual information between values and classes.

For a value v of a class with n rows, r is the distance to its k-th nearest
neighbour in the class (k at most n - 1), and m counts the rows of any class
nearer than r (v itself included; where r is 0, the rows equal to v).  Over the
rows of classes with at least two rows

    MI = psi(N) + mean psi(k) - mean psi(n) - mean psi(m), at least 0.

Everything is worked out on distinct values with their counts.  Neighbours are
found within blocks of consecutive ranks that overlap by k values, and m is the
difference of two running counts taken in buckets of about equally many values,
so no task holds a whole column, however hot one feature or class is.

Rows without a value or a label are left out; a feature without a class of two
rows gets 0.  Bounds v - r and v + r are compared in floating point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .quantiles import even_buckets
from .split import exact_row_number

#: Distinct values of a class that one neighbour window holds.
BLOCK = 65_536


def digamma(n: Column) -> Column:
    """psi of a whole number >= 1: the asymptotic series after six steps up."""
    x = n.cast("double")
    y = x + 6.0
    z = F.lit(1.0) / (y * y)
    series = F.ln(y) - F.lit(0.5) / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    for i in range(6):
        series = series - F.lit(1.0) / (x + i)
    return series


def _radii(values: DataFrame, k: int, block: int) -> DataFrame:
    """(feature, label, v, c, n, kk, r) from (feature, label, v, c, n): r by k
    distinct values on each side, which surely hold the k nearest rows."""
    ranked = exact_row_number(values, ["feature", "label"], [F.col("v")], even_buckets(values, "v"), "rank")
    place, home = F.col("rank") % block, F.floor(F.col("rank") / block)
    spread = ranked.select("*", F.explode(F.array_compact(F.array(
        F.struct(home.alias("block"), F.lit(True).alias("own")),
        F.when(place < k, F.struct((home - 1).alias("block"), F.lit(False).alias("own"))),
        F.when(place >= block - k, F.struct((home + 1).alias("block"), F.lit(False).alias("own")))))).alias("to"))
    order = Window.partitionBy("feature", "label", F.col("to.block")).orderBy("v")
    near = [F.struct(F.lit(0.0).alias("d"), (F.col("c") - 1).alias("c"))]
    for i in range(1, k + 1):
        for other in (F.lag(F.struct("v", "c"), i), F.lead(F.struct("v", "c"), i)):
            o = other.over(order)
            near.append(F.when(o.isNotNull(), F.struct(F.abs(o["v"] - F.col("v")).alias("d"), o["c"].alias("c"))))
    kk = F.least(F.lit(k).cast("long"), F.col("n") - 1)
    found = spread.select("*", F.array_sort(F.array_compact(F.array(*near))).alias("near"), kk.alias("kk")).filter("to.own")
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("r"))
    r = F.aggregate("near", start, lambda a, o: F.when(a["seen"] >= F.col("kk"), a).otherwise(
        F.struct((a["seen"] + o["c"]).alias("seen"), o["d"].alias("r"))))
    return found.select("feature", "label", "v", "c", "n", "kk", r["r"].alias("r"))


def _nearer(radii: DataFrame, points: DataFrame) -> DataFrame:
    """(feature, label, v, m): rows of the feature strictly within r of v."""
    tied = F.col("r") == 0
    mark = radii.select("feature", F.explode(F.array(
        F.struct((F.col("v") - F.col("r")).alias("x"), F.when(tied, 0).otherwise(2).alias("side"), F.lit(-1).alias("sign")),
        F.struct((F.col("v") + F.col("r")).alias("x"), F.when(tied, 2).otherwise(0).alias("side"), F.lit(1).alias("sign")),
    )).alias("e"), F.struct("label", "v").alias("of"))
    mark = mark.select("feature", "e.*", "of", F.lit(0).cast("long").alias("c"))
    own = points.select("feature", F.col("v").alias("x"), F.lit(1).alias("side"), F.lit(0).alias("sign"),
                        F.lit(None).cast(mark.schema["of"].dataType).alias("of"), "c")
    events = own.unionByName(mark)
    # bounds from the points: marks follow them closely, two a value
    events = events.withColumn("b", even_buckets(own, "x"))
    run = Window.partitionBy("feature", "b").orderBy("x", "side").rowsBetween(Window.unboundedPreceding, 0)
    local = events.withColumn("seen", F.sum("c").over(run)).filter("sign <> 0")
    totals = events.groupBy("feature", "b").agg(F.sum("c").alias("t"))
    earlier = Window.partitionBy("feature").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("feature", "b", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("before"))
    return (local.join(before, ["feature", "b"]).groupBy("feature", "of")
            .agg(F.sum(F.col("sign") * (F.col("seen") + F.col("before"))).alias("m"))
            .select("feature", "of.label", "of.v", "m"))


def mutual_information_knn(tall: DataFrame, feature: str = "feature", value: str = "value",
                           label: str = "label", k: int = 3, block: int = BLOCK) -> DataFrame:
    """(feature, mutual_info) in nats."""
    if not 1 <= k < block // 2:
        raise ValueError("k must be at least 1 and well below the block")
    x = F.col(value).cast("double") + 0.0  # -0.0 becomes 0.0
    rows = tall.select(F.col(feature).alias("feature"), F.col(label).alias("label"), x.alias("v")).filter(
        F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    counted = materialize(rows.groupBy("feature", "label", "v").agg(F.count(F.lit(1)).alias("c")))
    sizes = counted.groupBy("feature", "label").agg(F.sum("c").alias("n"))
    # one row a feature and class
    values = counted.join(sizes, ["feature", "label"]).filter("n > 1")
    radii = materialize(_radii(values, k, block))
    points = radii.groupBy("feature", "v").agg(F.sum("c").alias("c"))
    m = _nearer(radii, points)
    terms = radii.join(m, ["feature", "label", "v"]).groupBy("feature").agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") * (digamma(F.col("kk")) - digamma(F.col("n")) - digamma(F.col("m")))).alias("s"))
    mi = terms.select("feature", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("s") / F.col("n")).alias("mi"))
    every = sizes.groupBy("feature").agg(F.count(F.lit(1)).alias("_classes"))
    return every.join(mi, "feature", "left").select(
        F.col("feature").alias(feature), F.coalesce("mi", F.lit(0.0)).alias("mutual_info"))
