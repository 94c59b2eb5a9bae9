"""Exact quantiles without holding a column's values in one task.

``percentile`` keeps a map of all distinct values of a group in one
aggregation buffer.  Here a mergeable sketch first brackets each wanted rank
between two values; rows outside every bracket are then only counted, rows
inside are counted per value, and a running count over what is left finds the
exact order statistics.  Both passes aggregate before the shuffle, so a group
of any size reaches its task as the few values near the wanted ranks.

Groups of at most ``WHOLE * accuracy`` rows are not bracketed: their distinct
values are few enough to be counted as they are.

The sketch of up to ``MAX_SENT`` groups goes to the rows as a broadcast, so rows
are never shuffled by a group's key.  Where a group is so large that a bracket
may hold more than ``SPAN`` values, running counts are taken within ``BINS``
slices of a bracket, and the slices' totals are added.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Most rows that ``sent`` collects and broadcasts; values that one running count may hold; slices of a bracket.
MAX_SENT, SPAN, BINS = 10_000, 1_000_000, 256
#: Sketch size: a bracket holds about 4 / ACCURACY of a group's rows.
ACCURACY = 10_000
WHOLE = 20


def sent(few: DataFrame) -> DataFrame:
    """A frame of at most ``MAX_SENT`` rows as a broadcast, so that what it is
    joined to stays where it is; a larger one as it is."""
    rows = few.limit(MAX_SENT + 1).collect()
    return few if len(rows) > MAX_SENT else F.broadcast(few.sparkSession.createDataFrame(rows, few.schema))


def _slice(v: Column, probs: list[float]) -> Column:
    """A slice number that does not decrease with ``v``: which bracket, and
    where in it.  Values before the first bracket come first."""
    out = F.lit(-1)
    for place, i in reversed(list(enumerate(sorted(range(len(probs)), key=lambda i: probs[i])))):
        lo, hi = F.col("_m")[2 * i], F.col("_m")[2 * i + 1]
        within = F.when((hi > lo) & (hi - lo < float("inf")), F.floor((v - lo) / (hi - lo) * (BINS - 1))).otherwise(0)
        out = F.when(v.between(lo, hi), place * BINS + within.cast("int")).otherwise(out)
    return F.when(F.col("_m").isNull(), 0).otherwise(out)


def exact_quantiles(long: DataFrame, keys: list[str], value: str, probs: list[float],
                    accuracy: int = ACCURACY) -> DataFrame:
    """(keys..., q): q is the array of linearly interpolated quantiles of the
    non-missing values, as ``percentile`` gives them.  Groups without a value
    have no row."""
    x = long.select(*keys, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    reach = 2.2 / accuracy
    marks = [min(1.0, max(0.0, p + d)) for p in probs for d in (-reach, reach)]
    sketch = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", marks, accuracy).alias("_m"))
    few = F.col("_n") <= WHOLE * accuracy
    sketch = sketch.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n",
                           F.when(~few, F.col("_m")).alias("_m"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = sketch.limit(MAX_SENT + 1).collect()
    if len(rows) <= MAX_SENT:
        largest = max((r["_n"] for r in rows), default=0)
        sketch = F.broadcast(x.sparkSession.createDataFrame(rows, sketch.schema))
    else:
        sketch = materialize(sketch)
        largest = sketch.agg(F.max("_n")).first()[0]
    j = x.join(sketch, same)
    # inside a bracket: the value itself; between brackets: the end of the last bracket passed
    inside = F.col("_m").isNull()
    passed = F.lit(float("-inf"))
    for i in range(len(probs)):
        lo, hi = F.col("_m")[2 * i], F.col("_m")[2 * i + 1]
        inside = inside | F.col("_x").between(lo, hi)
        passed = F.greatest(passed, F.when(F.col("_x") > hi, hi).otherwise(F.lit(float("-inf"))))
    inside = F.coalesce(inside, F.lit(False))
    deep = largest * 2 * reach > SPAN
    counted = (j.select(*keys, "_n", F.when(inside, F.col("_x")).otherwise(passed).alias("_v"),
                        (~inside).cast("int").alias("_gap"), *(["_m"] if deep else []))
               .withColumn("_b", _slice(F.col("_v"), probs) if deep else F.lit(0))
               .groupBy(*keys, "_n", "_b", "_v", "_gap").agg(F.count(F.lit(1)).alias("_c")))
    run = Window.partitionBy(*keys, "_b").orderBy("_v", "_gap").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_end", F.sum("_c").over(run))
    if deep:  # a group has at most BINS slices a bracket
        earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        totals = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_t"))
        before = totals.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], F.col("_b").alias("_ob"),
                               F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
        meet = F.col("_b") == F.col("_ob")
        for i, k in enumerate(keys):
            meet = meet & F.col(k).eqNullSafe(F.col(f"_o{i}"))
        ranked = ranked.join(sent(before), meet).withColumn("_end", F.col("_end") + F.col("_before"))

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("_gap") == 0) & (index >= F.col("_end") - F.col("_c")) & (index < F.col("_end")), F.col("_v")))

    aggs, out = [], []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        aggs += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi))
    return ranked.groupBy(*keys, "_n").agg(*aggs).select(*keys, F.array(*out).alias("q"))


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     accuracy: int = ACCURACY) -> dict[str, list[float] | None]:
    """Quantiles of each column; None for a column without values.  The driver
    receives one row per column."""
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("kv"))
    rows = exact_quantiles(long.select("kv.*"), ["column"], "value", probs, accuracy).collect()
    found = {r["column"]: list(r["q"]) for r in rows}
    return {c: found.get(c) for c in cols}


#: Counted values that a task of ``dense_quantiles`` holds before it sends them.
HELD_VALUES = 1 << 19


def _brackets(marks: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) ends of the disjoint brackets of pairs of marks; NaN is the greatest value."""
    out: list[list[float]] = []
    for lo, hi in sorted(zip(marks[::2], marks[1::2]), key=lambda t: [(math.isnan(v), v) for v in t]):
        if out and (math.isnan(out[-1][1]) or lo <= out[-1][1]):
            out[-1][1] = hi if math.isnan(hi) else max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple(np.array([b[i] for b in out], float) for i in (0, 1))


def _segments(x: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """2 i + 1 inside bracket i, 2 i + 2 between it and the next, 0 before the first."""
    at = np.searchsorted(lower, x, side="right") - 1
    inside = (at >= 0) & ((x <= upper[at]) | np.isnan(upper[at]))
    return np.where(inside, 2 * at + 1, 2 * at + 2)


def dense_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    accuracy: int = ACCURACY) -> dict[str, list[float] | None]:
    """``column_quantiles`` for many probabilities, whose plan does not grow
    with them: tasks count the values inside the brackets and the rows between
    them, a group finds the order statistics of one column's bracket."""
    if not cols:
        return {}
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    reach = 2.2 / accuracy
    marks = [min(1.0, max(0.0, p + d)) for p in probs for d in (-reach, reach)]
    got = x.agg(*[F.count(c) for c in x.columns], *[F.percentile_approx(c, marks, accuracy) for c in x.columns]).first()
    n = got[:len(cols)]
    ends = [None if not n[i] else (np.array([-np.inf]), np.array([np.nan])) if n[i] <= WHOLE * accuracy
            else _brackets(got[len(cols) + i]) for i in range(len(cols))]
    counted = pa.schema([("c", pa.int32()), ("s", pa.int32()), ("v", pa.float64()), ("n", pa.int64())])

    def count(batches):
        between = [np.zeros(0 if e is None else 2 * len(e[0]) + 1, np.int64) for e in ends]
        held, n_held = [], 0

        def inside():
            for i in dict.fromkeys(i for i, _, _ in held):
                value, at = np.unique(np.concatenate([v for j, v, _ in held if j == i]), return_inverse=True)
                times = np.bincount(at, np.concatenate([t for j, _, t in held if j == i])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i, np.int32)),
                                                  pa.array(_segments(value, *ends[i]).astype(np.int32)),
                                                  pa.array(value), pa.array(times)], schema=counted)
        for batch in batches:
            for i, e in enumerate(ends):
                v = batch.column(i).drop_null().to_numpy(zero_copy_only=False) + 0.0    # -0.0 is 0.0
                if e is None or not len(v):
                    continue
                s = _segments(v, *e)
                between[i] += np.bincount(s, minlength=len(between[i])) * (np.arange(len(between[i])) % 2 == 0)
                value, times = np.unique(v[s % 2 == 1], return_counts=True)
                held.append((i, value, times))
                n_held += len(value)
            if n_held > HELD_VALUES:
                yield from inside()
                held, n_held = [], 0
        yield from inside()
        for i, b in enumerate(between):
            s = np.flatnonzero(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int32)), pa.array(s.astype(np.int32)),
                                              pa.nulls(len(s), pa.float64()), pa.array(b[s])], schema=counted)
    counts = materialize(x.mapInArrow(count, "c int, s int, v double, n long").groupBy("c", "s", "v").agg(F.sum("n").alias("n")))
    before, passed, places = {}, [0] * len(cols), {}
    for r in sorted(counts.groupBy("c", "s").agg(F.sum("n").alias("n")).collect()):    # two a probability and column
        before[r["c"], r["s"]] = passed[r["c"]]
        passed[r["c"]] += r["n"]
    for i in range(len(cols)):
        exact = [p * (n[i] - 1) for p in probs]
        places[i] = np.array(sorted({f(p) for p in exact for f in (math.floor, math.ceil)}), np.int64)

    def pick(table):
        i, s = table.column("c")[0].as_py(), table.column("s")[0].as_py()
        value, times = table.column("v").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(value, kind="stable")
        last = before[i, s] + np.cumsum(times[order])
        mine = places[i][(places[i] >= before[i, s]) & (places[i] < last[-1])]
        return pa.table([pa.array(np.full(len(mine), i, np.int32)), pa.array(mine),
                         pa.array(value[order][np.searchsorted(last, mine, side="right")])], names=["c", "place", "v"])
    found = {(r["c"], r["place"]): r["v"] for r in counts.filter("v IS NOT NULL").groupBy("c", "s")
             .applyInArrow(pick, "c int, place long, v double").collect()}
    out = {}
    for i, c in enumerate(cols):
        if not n[i]:
            out[c] = None
            continue
        out[c] = []
        for p in probs:
            place = p * (n[i] - 1)
            lo, hi = found[i, math.floor(place)], found[i, math.ceil(place)]
            out[c].append(lo if lo == hi else (math.ceil(place) - place) * lo + (place - math.floor(place)) * hi)
    return out


def _bounds(df: DataFrame, col: str, parts: int) -> list[float]:
    marks = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(F.col(col).cast("double"), marks, 100 * parts).alias("b")).first()["b"]
    return sorted(set(got or []))


def even_buckets(df: DataFrame, col: str, coarse: int = 32) -> Column:
    """A bucket number that does not decrease with ``col`` and holds about
    equally many rows of ``df`` (missing values: NULL).  About coarse^2 buckets
    from sampled bounds, found in two steps so a row costs 2 * coarse tests."""
    bounds = _bounds(df, col, coarse * coarse)
    x = F.col(col).cast("double")
    heads = bounds[coarse - 1::coarse]
    groups = [bounds[i:i + coarse] for i in range(0, max(1, len(bounds)), coarse)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < x))
    empty = F.array().cast("array<double>")
    head = below(F.array(*[F.lit(b) for b in heads]) if heads else empty)
    lists = F.array(*[F.array(*[F.lit(b) for b in g]) if g else empty for g in groups])
    inner = F.coalesce(below(F.get(lists, head)), F.lit(0))
    return F.when(x.isNotNull(), head * (coarse + 1) + inner)
