"""Class balancing: imbalance gate, SMOTE, ADASYN, Tomek links.

Inputs are ``(row_id, label, vector array<double>)``.  Random choices are
md5 draws keyed by (seed, class, draw, tag), so results do not depend on
partitioning and can be restated in SQL.  Draw rows are generated with
``spark.range`` per class (distributed), never exploded from one row, and
every lookup (base row, neighbour, neighbour vector) is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .knn import knn_join
from .quantiles import even_buckets
from .split import exact_row_number, uniform


def class_counts_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: largest / smallest class count, their ratio and the > 1.5 gate."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.max("n") / F.min("n").cast("double")
    return counts.agg(F.max("n").alias("n_max"), F.min("n").alias("n_min"),
                      ratio.alias("ratio"), (ratio > 1.5).alias("needs_balancing"))


class NoForeignNeighbours(ValueError):
    """A class to grow has no row with a neighbour of another class."""


def _class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class (the driver plans one draw range per class to grow);
    rows without a label are no class."""
    return {r[label]: r["count"] for r in df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}


def _interp(base: str, nbr: str, gap: str) -> F.Column:
    return F.zip_with(F.col(base), F.col(nbr), lambda a, b: a + F.col(gap) * (b - a))


def _draws(spark, per_class: dict, seed: int, tag_key: str = "draw") -> DataFrame:
    """(label, draw) rows: ``spark.range(G)`` per class, unioned."""
    out = None
    for c, g in sorted(per_class.items()):
        if g <= 0:
            continue
        r = spark.range(0, g).select(F.lit(c).alias("label"), F.col("id").alias("draw"))
        out = r if out is None else out.unionByName(r)
    return out


def smote(df: DataFrame, k: int = 5, seed: int = 42, key: str = "row_id", label: str = "label",
          vector: str = "vector") -> DataFrame:
    """Grow every class to the largest class size with SMOTE draws.

    Draw j of class c: base row number ``floor(u(base) * n_c)`` (rows of the
    class numbered by key), neighbour rank ``1 + floor(u(nbr) * k_c)`` among
    its ``k_c = min(k, n_c - 1)`` same-class nearest neighbours, new vector
    ``x + u(gap) * (nbr - x)``.  New keys continue after the largest key in
    (class, draw) order.  Returns rows with ``is_synthetic``.
    """
    spark = df.sparkSession
    base = df.select(F.col(key).cast("long").alias("row_id"), F.col(label).alias("label"),
                     F.col(vector).cast("array<double>").alias("vector"))
    counts = _class_counts(base, "label")
    n_max = max(counts.values())
    grow = {c: n_max - n for c, n in counts.items() if n < n_max}
    orig = base.withColumn("is_synthetic", F.lit(False))
    if not grow:
        return orig
    for c in grow:
        if counts[c] < 2:
            raise ValueError(f"class {c!r} has a single row; SMOTE needs at least two")
    max_id = base.agg(F.max("row_id")).first()[0]
    minority = base.filter(F.col("label").isin(list(grow)))
    kk = {c: min(k, counts[c] - 1) for c in grow}
    nn = knn_join(minority, minority, "vector", max(kk.values()), qkey="row_id",
                  by=["label"], exclude_self=True)
    numbered = exact_row_number(minority, ["label"], [F.col("row_id")], even_buckets(minority, "row_id"), "rn")
    nmap = F.create_map(*[x for c in grow for x in (F.lit(c), F.lit(counts[c]))])
    kmap = F.create_map(*[x for c in grow for x in (F.lit(c), F.lit(kk[c]))])
    draws = _draws(spark, grow, seed)
    u = lambda tag: uniform(F.lit(seed), F.col("label"), F.col("draw"), F.lit(tag))
    draws = draws.select("label", "draw",
                         (F.floor(u("base") * nmap[F.col("label")]) + 1).cast("long").alias("rn"),
                         (F.floor(u("nbr") * kmap[F.col("label")]) + 1).cast("int").alias("rank"),
                         u("gap").alias("gap"))
    # offsets of each class's draws in (class, draw) order: one entry per class
    offs, acc = {}, 0
    for c in sorted(grow):
        offs[c] = acc
        acc += grow[c]
    omap = F.create_map(*[x for c in grow for x in (F.lit(c), F.lit(offs[c]))])
    b = numbered.select("label", "rn", F.col("row_id").alias("base_id"), F.col("vector").alias("bvec"))
    j = draws.join(b, ["label", "rn"])
    j = j.join(nn.select("label", F.col("row_id").alias("base_id"), "rank", "nbr"), ["label", "base_id", "rank"])
    j = j.join(base.select(F.col("row_id").alias("nbr"), F.col("vector").alias("nvec")), "nbr")
    synth = j.select((F.lit(max_id) + 1 + omap[F.col("label")] + F.col("draw")).cast("long").alias("row_id"),
                     "label", _interp("bvec", "nvec", "gap").alias("vector"),
                     F.lit(True).alias("is_synthetic"))
    return orig.unionByName(synth)


def tomek_links(df: DataFrame, key: str = "row_id", label: str = "label",
                vector: str = "vector") -> DataFrame:
    """Pairs (a, b) that are each other's nearest neighbour with different labels."""
    base = df.select(F.col(key).cast("long").alias("row_id"), F.col(label).alias("label"),
                     F.col(vector).cast("array<double>").alias("vector"))
    nn = knn_join(base, base, "vector", 1, qkey="row_id", exclude_self=True).select(
        F.col("row_id").alias("a"), F.col("nbr").alias("b"))
    lab = base.select("row_id", "label")
    back = nn.select(F.col("a").alias("b"), F.col("b").alias("a"))
    mutual = nn.join(back, ["a", "b"])
    la = lab.select(F.col("row_id").alias("a"), F.col("label").alias("la"))
    lb = lab.select(F.col("row_id").alias("b"), F.col("label").alias("lb"))
    return mutual.join(la, "a").join(lb, "b").filter(F.col("la") != F.col("lb")).select("a", "b", "la", "lb")


def remove_tomek(df: DataFrame, key: str = "row_id", label: str = "label", vector: str = "vector") -> DataFrame:
    """Drop both members of every Tomek link (anti-join)."""
    links = tomek_links(df, key, label, vector).select(F.col("a").alias(key))
    return df.join(links, key, "left_anti")


def smote_tomek(df: DataFrame, k: int = 5, seed: int = 42, key: str = "row_id",
                label: str = "label", vector: str = "vector") -> DataFrame:
    grown = materialize(smote(df, k, seed, key, label, vector))  # read several times by the join
    return remove_tomek(grown, "row_id", "label", "vector")


def adasyn(df: DataFrame, k: int = 5, seed: int = 42, key: str = "row_id", label: str = "label",
           vector: str = "vector", chunk: int = 100_000) -> DataFrame:
    """ADASYN: per non-majority class, draws per row proportional to the share
    of other-class rows among its k nearest neighbours (all rows), rounded
    half-to-even; each draw interpolates towards a same-class neighbour.
    Raises NoForeignNeighbours when a class has no other-class neighbour at all (the
    caller falls back to SMOTE)."""
    spark = df.sparkSession
    base = df.select(F.col(key).cast("long").alias("row_id"), F.col(label).alias("label"),
                     F.col(vector).cast("array<double>").alias("vector"))
    counts = _class_counts(base, "label")
    n_max = max(counts.values())
    grow = {c: n_max - n for c, n in counts.items() if n < n_max}
    orig = base.withColumn("is_synthetic", F.lit(False))
    if not grow:
        return orig
    minority = base.filter(F.col("label").isin(list(grow)))
    lab = base.select(F.col("row_id").alias("nbr"), F.col("label").alias("nlabel"))
    nn_all = knn_join(minority, base, "vector", k, qkey="row_id", exclude_self=True)
    r = (nn_all.join(lab, "nbr").join(minority.select("row_id", "label"), "row_id")
         .groupBy("row_id", "label").agg((F.count_if(F.col("nlabel") != F.col("label")) / F.lit(float(k))).alias("r")))
    gmap = F.create_map(*[x for c in grow for x in (F.lit(c), F.lit(grow[c]))])
    r = materialize(r)
    sums = {x["label"]: x["rsum"] for x in r.groupBy("label").agg(F.sum("r").alias("rsum")).collect()}
    bad = [c for c, total in sorted(sums.items()) if total == 0]
    if bad:
        raise NoForeignNeighbours(f"no other-class neighbours for classes {bad}")
    smap = F.create_map(*[x for c, total in sums.items() for x in (F.lit(c), F.lit(total))])  # one entry a class
    r = r.withColumn("rsum", smap[F.col("label")])
    g = r.select("row_id", "label",
                 F.bround(F.col("r") / F.col("rsum") * gmap[F.col("label")], 0).cast("long").alias("g"))
    g = g.filter(F.col("g") > 0)
    # split big per-row counts into chunks before exploding, so no task expands a hot row alone
    chunks = g.select("row_id", "label", "g", F.explode(F.sequence(
        F.lit(0), ((F.col("g") - 1) / F.lit(chunk)).cast("long"))).alias("ck"))
    chunks = chunks.repartition("row_id", "ck")
    draws = chunks.select("row_id", "label", F.explode(F.sequence(
        F.col("ck") * chunk, F.least(F.col("g"), (F.col("ck") + 1) * chunk) - 1)).alias("draw"))
    kk = {c: min(k, counts[c] - 1) for c in grow}
    kmap = F.create_map(*[x for c in grow for x in (F.lit(c), F.lit(kk[c]))])
    same = knn_join(minority, minority, "vector", max(kk.values()), qkey="row_id", by=["label"],
                    exclude_self=True)
    u = lambda tag: uniform(F.lit(seed), F.col("label"), F.col("row_id"), F.col("draw"), F.lit(tag))
    draws = draws.select("row_id", "label", "draw",
                         (F.floor(u("nbr") * kmap[F.col("label")]) + 1).cast("int").alias("rank"),
                         u("gap").alias("gap"))
    j = draws.join(same.select("row_id", "rank", "nbr"), ["row_id", "rank"])
    j = j.join(base.select("row_id", F.col("vector").alias("bvec")), "row_id")
    j = j.join(base.select(F.col("row_id").alias("nbr"), F.col("vector").alias("nvec")), "nbr")
    # new keys in (class, base row, draw) order: offsets from per-row counts
    max_id = base.agg(F.max("row_id")).first()[0]
    offs = _prefix(g.select("label", "row_id", "g"))
    j = j.join(offs, ["label", "row_id"])
    synth = j.select((F.lit(max_id) + 1 + F.col("off") + F.col("draw")).cast("long").alias("row_id"),
                     "label", _interp("bvec", "nvec", "gap").alias("vector"), F.lit(True).alias("is_synthetic"))
    return orig.unionByName(synth)


def _prefix(g: DataFrame) -> DataFrame:
    """Exclusive running sum of ``g`` in (label, row_id) order, computed in
    bounded (label, row_id bucket) windows plus bucket offsets."""
    b = g.withColumn("_b", even_buckets(g, "row_id"))
    inner = Window.partitionBy("label", "_b").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    local = b.select("label", "row_id", "_b", F.coalesce(F.sum("g").over(inner), F.lit(0)).alias("_lo"))
    bt = b.groupBy("label", "_b").agg(F.sum("g").alias("_bg"))
    before = Window.orderBy("label", "_b").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (class, bucket): small
    bt = bt.select("label", "_b", F.coalesce(F.sum("_bg").over(before), F.lit(0)).alias("_bo"))
    return local.join(bt, ["label", "_b"]).select("label", "row_id", (F.col("_lo") + F.col("_bo")).alias("off"))


def balance(df: DataFrame, mode: str = "binario", k: int = 5, seed: int = 42, **kw) -> DataFrame:
    """Reference policy: ratio > 1.5 -> ADASYN (multi-class, SMOTE fallback)
    or SMOTE + Tomek (binary); else unchanged."""
    row = class_counts_ratio(df, kw.get("label", "label")).first()
    if not row["needs_balancing"]:
        return df.withColumn("is_synthetic", F.lit(False))
    if mode == "multiclase":
        try:
            return adasyn(df, k, seed, **kw)
        except NoForeignNeighbours:
            return smote(df, k, seed, **kw)
    return smote_tomek(df, k, seed, **kw)

