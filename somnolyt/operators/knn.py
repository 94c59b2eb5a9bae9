"""Exact k-nearest-neighbour join, pruned by pivot cells.

Complete vectors over more than one block of donors go through pivot cells
(``_pruned``): every donor belongs to the cell of its nearest pivot, cells (cut
by a key hash where they are large) are packed into tiles, a query first meets
its own cell's tile, whose k-th distance is an upper bound, and then goes only
to the tiles with a cell that the triangle inequality does not rule out.

Vectors with gaps have no triangle inequality, and one block of donors has
nothing to prune; they meet in a block nested loop.  Query rows are hashed into QB blocks and donor rows into DB blocks; each
query row is replicated to every donor block and each donor row to every
query block, and ``cogroup(...).applyInArrow`` meets one (query block,
donor block) pair per group.  A group therefore holds at most
``q_block_rows`` x ``d_block_rows`` candidates no matter how skewed the data
(a hot class is split into blocks like any other), and emits at most k rows
per query row: no pair table is ever materialised.  A final
``row_number`` over (query row) keeps the global top k, ties broken by the
donor key, which makes the result exact and deterministic.

kNN imputation (vectors with gaps) cuts donors into tiles by a tree; boxes of
tiles, and of leaves inside a tile (``Leaves``), bound the distance over whatever
coordinates two rows share, so a receiver meets only donors that can be near.

Distances follow the NaN-aware Euclidean rule: over coordinates present in
both rows, ``d2 = (p * sum((x - y)^2)) / n_present``; no shared coordinate
means no distance.  Inside a group they are first taken roughly by matrix
products with an error bound (``Sides.rough``); the pairs that can be among the
k nearest are then summed column by column in schema order (``Sides.exact``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize

#: Donors of a cell block, and the most pivots (they are collected and broadcast).
CELL_ROWS, MAX_PIVOTS = 4096, 1024
#: Numbers (rows x columns) that a side of a group holds at most: 32 MB.
SIDE_VALUES = 1 << 22
#: Queries and donors of one matrix product, and pairs that are summed exactly at a time.
CHUNK_Q, CHUNK_D, CHUNK_PAIRS = 512, 2048, 1 << 17
#: Donors of a leaf, queries that are looked up together, and donors that they meet first.
LEAF_ROWS, TOGETHER, FIRST_ROWS = 128, 128, 512
#: Relative slack of lower bounds, for rounding.
SLACK = 1e-9


def _vector(cols: list[str] | str) -> F.Column:
    if isinstance(cols, str):
        return F.col(cols).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in cols])


def pair_d2(Q: np.ndarray, D: np.ndarray) -> np.ndarray:
    """(nq, nd) squared NaN-Euclidean distances; NaN when nothing is shared."""
    nq, p = Q.shape
    nd = D.shape[0]
    acc = np.zeros((nq, nd))
    present = np.zeros((nq, nd))
    for j in range(p):
        diff = Q[:, j][:, None] - D[:, j][None, :]
        ok = ~np.isnan(diff)
        acc += np.where(ok, diff * diff, 0.0)
        present += ok
    with np.errstate(invalid="ignore", divide="ignore"):
        d2 = (acc * p) / present
    d2[present == 0] = np.nan
    return d2


class Sides:
    """Queries and donors of a group: rough distances by matrix products, exact ones by pairs."""

    def __init__(self, Q: np.ndarray, D: np.ndarray):
        self.Q, self.D, self.p = Q, D, Q.shape[1]
        present = ~np.isnan(D)
        self.whole = bool(present.all() and not np.isnan(Q).any())
        with np.errstate(invalid="ignore", over="ignore"):
            n = np.maximum(present.sum(axis=0), 1)
            centre = np.where(present, D, 0.0).sum(axis=0) / n
            q, d = Q - centre, D - centre
            self.finite = bool(self.whole and np.isfinite(q).all() and np.isfinite(d).all())
            unit = 8.0 * np.finfo(float).eps * (3 * self.p + 8)
            if self.whole:
                self.nq, self.nd = (q * q).sum(axis=1), (d * d).sum(axis=1)
                self.a = np.column_stack([-2.0 * q, self.nq, np.ones(len(q))])
                self.b = np.column_stack([d, np.ones(len(d)), self.nd])
                self.unit = unit
            else:
                self.mq, self.md = (~np.isnan(q)).astype(float), (~np.isnan(d)).astype(float)
                q, d = np.where(self.mq > 0, q, 0.0), np.where(self.md > 0, d, 0.0)
                self.nq, self.nd = (q * q).sum(axis=1), (d * d).sum(axis=1)
                self.a = np.column_stack([q * q, self.mq, -2.0 * q])
                self.b = np.column_stack([self.md, d * d, d])
                self.unit = unit * self.p   # the sum is stretched by at most p

    def rough(self, rows, cols) -> tuple[np.ndarray, np.ndarray]:
        """(distances of rows x cols, the bound of their error by row); no
        shared coordinate gives infinity, what overflows gives NaN."""
        with np.errstate(all="ignore"):
            g = self.a[rows] @ self.b[cols].T
            if not self.whole:
                present = self.mq[rows] @ self.md[cols].T
                g *= self.p
                g /= present
                g[present == 0] = np.inf
            return g, self.unit * (self.nq[rows] + self.nd[cols].max())

    def within(self, rows: np.ndarray, cols: slice, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """With gaps: pairs (number in ``rows``, number in ``cols``) that can lie
        within the row's limit, by sum - limit / p * present <= 0 in one product."""
        with np.errstate(all="ignore"):
            a = self.a[rows]
            a[:, :self.p] -= (limit / self.p)[:, None] * self.mq[rows]
            slack = self.unit / self.p * (self.nq[rows] + self.nd[cols].max() + limit)
            return np.nonzero(~(a @ self.b[cols].T > slack[:, None]))

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared distances of pairs, equal to ``pair_d2`` bit by bit."""
        out = np.empty(len(i))
        with np.errstate(all="ignore"):
            for at in range(0, len(i), CHUNK_PAIRS):
                part = slice(at, at + CHUNK_PAIRS)
                diff = self.Q[i[part]] - self.D[j[part]]
                if self.finite:
                    present = float(self.p)
                else:
                    ok = ~np.isnan(diff)
                    diff[~ok] = 0.0
                    present = ok.sum(axis=1).astype(float)
                acc = np.cumsum(diff * diff, axis=1)[:, -1]  # one column after the other
                out[part] = (acc * self.p) / present
        return out


class Nearest:
    """The k least (distance, key) of every slot so far, with the donor's place."""

    def __init__(self, slots: int, k: int, keys: np.ndarray):
        self.k, self.keys = k, keys
        self.d = np.full((slots, k), np.inf)
        self.at = np.full((slots, k), -1, np.int64)

    def offer(self, slot: np.ndarray, d: np.ndarray, at: np.ndarray) -> None:
        good = np.isfinite(d)
        slot, d, at = slot[good], d[good], at[good]
        if not len(slot):
            return
        old = np.unique(slot)
        was = self.at[old] >= 0
        slot = np.concatenate([slot, np.repeat(old, was.sum(axis=1))])
        d, at = np.concatenate([d, self.d[old][was]]), np.concatenate([at, self.at[old][was]])
        order = np.lexsort((self.keys[at], d, slot))
        slot, d, at = slot[order], d[order], at[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        top = rank < self.k
        self.d[slot[top], rank[top]], self.at[slot[top], rank[top]] = d[top], at[top]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, distance, donor's place) of all entries."""
        slot, rank = np.nonzero(self.at >= 0)
        return slot, self.d[slot, rank], self.at[slot, rank]


def _kth(g: np.ndarray, k: int) -> np.ndarray:
    """Per row the k-th smallest, infinity where there are fewer."""
    if g.shape[1] < k:
        return np.full(len(g), np.inf)
    kth = np.partition(g, k - 1, axis=1)[:, k - 1]
    return np.where(np.isnan(kth), np.inf, kth)


def scan(sides: Sides, best: Nearest, bound: np.ndarray, rows: np.ndarray, cols: slice | np.ndarray, qkeys: np.ndarray,
         exclude_self: bool) -> None:
    """Offers to the slots of ``rows`` every donor of ``cols`` that can be among
    their k nearest.  ``bound`` (by query) is a distance past which a donor
    cannot matter; it shrinks to the k-th distance found."""
    g, slack = sides.rough(rows, cols)
    if exclude_self:
        keys = best.keys[cols]
        order = np.argsort(keys, kind="stable")
        lo, hi = (np.searchsorted(keys[order], qkeys[rows], side) for side in ("left", "right"))
        for r in np.flatnonzero(hi > lo):
            g[r, order[lo[r]:hi[r]]] = np.inf
    limit = bound[rows]
    unbound = ~np.isfinite(limit)
    if unbound.any():
        limit[unbound] = _kth(g[unbound], best.k) + slack[unbound]
    i, j = np.nonzero(~(g > (limit + slack)[:, None]))  # NaN: no rough distance
    i, j = rows[i], j + cols.start if isinstance(cols, slice) else cols[j]
    if exclude_self:
        other = qkeys[i] != best.keys[j]
        i, j = i[other], j[other]
    best.offer(i, sides.exact(i, j), j)
    bound[rows] = np.minimum(bound[rows], best.d[rows, -1])


def _by_pattern(X: np.ndarray):
    """(coordinates present, row numbers) of rows that have the same ones."""
    present = ~np.isnan(X)
    if present.all():
        yield np.ones(X.shape[1], bool), np.arange(len(X))
        return
    codes = np.packbits(present, axis=1)
    order = np.lexsort(codes.T)
    ends = np.flatnonzero(np.r_[(codes[order][1:] != codes[order][:-1]).any(axis=1), True]) + 1
    for a, b in zip(np.r_[0, ends[:-1]], ends):
        yield present[order[a]], order[a:b]


def _halved(X: np.ndarray, rows: np.ndarray, most: int):
    """Row numbers cut in halves along the widest coordinate until ``most`` are left."""
    waiting = [rows]
    while waiting:
        r = waiting.pop()
        if len(r) <= most:
            yield r
            continue
        x = X[r]
        with np.errstate(all="ignore"):
            spread = np.nan_to_num(x.var(axis=0), nan=-1.0, posinf=-1.0)
        f = int(spread.argmax()) if len(spread) else 0
        if not len(spread) or spread[f] <= 0:
            order = np.arange(len(r))
        else:
            order = np.argpartition(x[:, f], len(r) // 2)
        waiting += [r[order[len(r) // 2:]], r[order[:len(r) // 2]]]


class Leaves:
    """Donors in leaves of rows that lie together and have the same coordinates;
    a leaf's box bounds the distance of what is in it, over any coordinates.
    Rows with rare sets of coordinates share leaves without a bound."""

    def __init__(self, D: np.ndarray):
        parts, masks, rare = [], [], []
        for present, rows in _by_pattern(D):
            if len(rows) < LEAF_ROWS // 4 and len(rows) < len(D):
                rare.append(rows)
                continue
            for part in _halved(D, rows, LEAF_ROWS):
                parts.append(part)
                masks.append(present)
        self.bounded = len(parts)
        if rare:
            rows = np.concatenate(rare)
            parts += [rows[at:at + LEAF_ROWS] for at in range(0, len(rows), LEAF_ROWS)]
            masks += [np.zeros(D.shape[1], bool)] * (len(parts) - self.bounded)
        self.sizes = np.array([len(x) for x in parts])
        self.first, self.rows, self.mask = np.r_[0, np.cumsum(self.sizes)], np.concatenate(parts), np.array(masks)
        x = D[self.rows]
        self.lo, self.hi = np.minimum.reduceat(x, self.first[:-1], axis=0), np.maximum.reduceat(x, self.first[:-1], axis=0)

    @classmethod
    def of_boxes(cls, lo: np.ndarray, hi: np.ndarray, mask: np.ndarray) -> "Leaves":
        """Boxes alone, for ``apart``."""
        out = cls.__new__(cls)
        out.lo, out.hi, out.mask, out.bounded = lo, hi, mask, len(lo)
        return out

    def donors(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([self.rows[self.first[i]:self.first[i + 1]] for i in leaves])

    def apart(self, lo: np.ndarray, hi: np.ndarray, present: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """(boxes, leaves): squared distances that rows of a box (lo, hi), with
        the coordinates ``present``, have at least from those of a leaf."""
        total, shared = np.zeros((len(lo), len(leaves))), np.zeros(len(leaves))
        with np.errstate(all="ignore"):
            for j in np.flatnonzero(present):
                here = self.mask[leaves, j]
                gap = np.maximum(self.lo[leaves, j] - hi[:, j, None], lo[:, j, None] - self.hi[leaves, j])
                total += np.where(here & (gap > 0), gap * gap, 0.0)
                shared += here
            total *= self.mask.shape[1] / shared * (1 - SLACK)
        total[:, shared == 0] = np.inf    # nothing shared: no distance
        total[:, leaves >= self.bounded] = 0.0
        return total

    def search(self, sides: Sides, best: Nearest, bound: np.ndarray, rows: np.ndarray, present: np.ndarray, qkeys: np.ndarray,
               exclude_self: bool, has: int | None = None) -> None:
        """``scan`` of the leaves that can hold one of the k nearest donors of
        queries with the same coordinates present, the nearest leaves first;
        with ``has`` only donors that have this coordinate."""
        leaves = np.arange(len(self.sizes))
        if has is not None:
            leaves = leaves[self.mask[:, has] | (leaves >= self.bounded)]
        if not len(leaves):
            return
        Q = sides.Q[rows]
        lo, hi = Q.min(axis=0, keepdims=True), Q.max(axis=0, keepdims=True)
        low = self.apart(lo, hi, present, leaves)[0]
        with np.errstate(all="ignore"):
            middle = (self.lo[leaves] + self.hi[leaves] - (lo + hi)) * (self.mask[leaves] & present)
            off = np.nan_to_num((middle * middle).sum(axis=1), nan=0.0)
        order = np.lexsort((off, low))
        leaves, low, size = leaves[order], low[order], FIRST_ROWS
        while len(leaves):
            keep = ~(low > bound[rows].max())
            leaves, low = leaves[keep], low[keep]
            if not len(leaves):
                return
            n = max(1, int(np.searchsorted(np.cumsum(self.sizes[leaves]), size, side="right")))
            now, leaves, low = leaves[:n], leaves[n:], low[n:]
            needs = ~(self.apart(Q, Q, present, now) > bound[rows][:, None])
            now = now[needs.any(axis=0)]
            asks = rows[needs.any(axis=1)]
            if len(now):
                cols = self.donors(now)
                if has is not None:
                    cols = cols[~np.isnan(sides.D[cols, has])]
                if len(cols):
                    scan(sides, best, bound, asks, cols, qkeys, exclude_self)
            size = CHUNK_D


def _plan_blocks(n_query: int, n_donor: int, q_block_rows: int, d_block_rows: int,
                 parallelism: int) -> tuple[int, int]:
    qb = max(1, math.ceil(n_query / q_block_rows))
    db = max(1, math.ceil(n_donor / d_block_rows))
    # enough groups to keep every core busy, but never tiny donor blocks
    want = max(1, -(-2 * parallelism // qb))
    db = max(db, min(want, max(1, n_donor // 512)))
    return qb, db


def _blocked(query: DataFrame, donors: DataFrame, qkey: str, dkey: str, by: list[str],
             q_block_rows: int, d_block_rows: int, n_query: int | None = None, n_donor: int | None = None):
    spark = query.sparkSession
    nq = query.count() if n_query is None else n_query
    nd = donors.count() if n_donor is None else n_donor
    par = spark.sparkContext.defaultParallelism
    qb, db = _plan_blocks(nq, nd, q_block_rows, d_block_rows, par)
    q = (query.withColumn("_qb", F.pmod(F.xxhash64(F.col(qkey)), F.lit(qb)).cast("int"))
              .withColumn("_db", F.explode(F.sequence(F.lit(0), F.lit(db - 1)))))
    d = (donors.withColumn("_db", F.pmod(F.xxhash64(F.col(dkey)), F.lit(db)).cast("int"))
               .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))))
    keys = by + ["_qb", "_db"]
    return q.groupBy(*keys).cogroup(d.groupBy(*keys))


def _vectors(table: pa.Table) -> np.ndarray:
    vectors = table.column("_v").combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(vectors), -1)


def _keys(table: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(table.column(name), np.iinfo(np.int64).min).to_numpy()


def _empty(schema: T.StructType) -> pa.Table:
    return to_arrow_schema(schema).empty_table()


def _meet(schema: T.StructType, by: list[str], k: int, exclude_self: bool, cells: tuple | None = None):
    """Top k of one (queries, donors) group; ``_u``, where given, is a squared
    distance past which a donor cannot matter.  With ``cells`` (pivots and
    radii) rows have a ``_cell``, and a query skips the cells that are too far."""
    def chunks(cell: np.ndarray):
        """Runs of one cell, cut to chunks: (cell, slice)."""
        ends = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True]) + 1
        for a, b in zip(np.r_[0, ends[:-1]], ends):
            for at in range(a, b, CHUNK_D):
                yield int(cell[a]), slice(at, min(at + CHUNK_D, b))

    def group(queries: pa.Table, donors: pa.Table) -> pa.Table:
        if not queries.num_rows or not donors.num_rows:
            return _empty(schema)
        if cells is not None:
            queries, donors = queries.sort_by("_cell"), donors.sort_by("_cell")
        Q, D, qk, dk = _vectors(queries), _vectors(donors), _keys(queries, "_q"), _keys(donors, "_d")
        sides, best = Sides(Q, D), Nearest(len(Q), k, dk)
        bound = (pc.fill_null(queries.column("_u"), np.inf).to_numpy().copy() if "_u" in queries.column_names
                 else np.full(len(Q), np.inf))
        if cells is None:
            for q in range(0, len(Q), CHUNK_Q):
                rows = np.arange(q, min(q + CHUNK_Q, len(Q)))
                for d in range(0, len(D), CHUNK_D):
                    scan(sides, best, bound, rows, slice(d, min(d + CHUNK_D, len(D))), qk, exclude_self)
        else:
            parts = list(chunks(donors.column("_cell").to_numpy()))
            own = queries.column("_cell").to_numpy()
            here, where = np.unique([c for c, _ in parts], return_inverse=True)
            for q in range(0, len(Q), CHUNK_Q):
                rows = np.arange(q, min(q + CHUNK_Q, len(Q)))
                low = lower_bounds(Q[rows], own[rows], cells, here)
                for part in np.argsort(low[:, where].min(axis=0), kind="stable"):  # the nearest cells first
                    near = rows[~(low[:, where[part]] > np.sqrt(bound[rows]) * (1 + SLACK))]
                    if len(near):
                        scan(sides, best, bound, near, parts[part][1], qk, exclude_self)
        slot, d2, at = best.found()
        columns = {"_q": qk[slot], "nbr": dk[at], "d2": d2}
        for b in by:
            columns[b] = pa.repeat(queries.column(b)[0], len(slot))
        return pa.table([columns[f.name] for f in schema.fields], schema=to_arrow_schema(schema))
    return group


def lower_bounds(Q: np.ndarray, own: np.ndarray, cells: tuple, here: np.ndarray) -> np.ndarray:
    """(queries, cells of ``here``): no donor of the cell is nearer than this.
    A donor lies within its cell's radius, and no other pivot is nearer to it."""
    pivots, radius = cells
    near, mine = Sides(Q, pivots[here]), Sides(Q, pivots)
    g, slack = near.rough(slice(None), slice(None))
    home = np.sqrt(mine.exact(np.arange(len(Q)), own))[:, None]
    away = np.sqrt(np.maximum(g - slack[:, None], 0.0))
    low = np.maximum(away * (1 - SLACK) - radius[here] * (1 + SLACK), (away * (1 - SLACK) - home * (1 + SLACK)) / 2)
    return np.where(own[:, None] == here, 0.0, np.maximum(low, 0.0))


def knn_join(query: DataFrame, donors: DataFrame, features: list[str] | str, k: int,
             qkey: str = "row_id", dkey: str | None = None, by: list[str] | None = None,
             exclude_self: bool = False, q_block_rows: int | None = None,
             d_block_rows: int = CELL_ROWS) -> DataFrame:
    """For each query row: its k nearest donors (same ``by`` group).

    Returns ``(by..., qkey, nbr, d2, rank)`` with rank 1..k by (d2, nbr).
    ``features`` is a list of numeric columns (NULL = missing) or one array
    column.  Keys must be integral and unique per side.  ``d_block_rows`` cuts
    cells, ``q_block_rows`` the queries of a group (by default ``SIDE_VALUES``
    numbers).
    """
    by = by or []
    dkey = dkey or qkey
    qv = query.select(*[F.col(b).alias(b) for b in by], F.col(qkey).cast("long").alias("_q"), _vector(features).alias("_v"))
    dv = donors.select(*[F.col(b).alias(b) for b in by], F.col(dkey).cast("long").alias("_d"), _vector(features).alias("_v"))
    by_types = {f.name: f.dataType for f in query.schema.fields if f.name in by}
    schema = T.StructType([T.StructField(b, by_types[b]) for b in by] + [
        T.StructField("_q", T.LongType()), T.StructField("nbr", T.LongType()),
        T.StructField("d2", T.DoubleType())])
    n_query, n_donor, whole, p = _shape(qv, dv)
    most = max(1024, SIDE_VALUES // max(1, p))
    if whole and n_query and n_donor > d_block_rows:
        cand = _pruned(qv, dv, by, k, n_donor, exclude_self, schema, q_block_rows or most, d_block_rows, most)
    else:
        # large donor blocks keep the replication of the rows low
        cand = (_blocked(qv, dv, "_q", "_d", by, q_block_rows or most, most, n_query, n_donor)
                .applyInArrow(_meet(schema, by, k, exclude_self), schema))
    w = Window.partitionBy(*by, "_q").orderBy("d2", "nbr")
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .withColumnRenamed("_q", qkey))


def _shape(qv: DataFrame, dv: DataFrame) -> tuple[int, int, bool, int]:
    """Rows of both sides, whether all vectors are complete and of one length, and the greatest length."""
    gap = F.col("_v").isNull() | F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q, d = (side.agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(gap, F.lit(False))).alias("gap"),
                     F.min(F.size("_v")).alias("lo"), F.max(F.size("_v")).alias("hi")).first() for side in (qv, dv))
    lengths = {q["lo"], q["hi"], d["lo"], d["hi"]} - {None}
    return q["n"], d["n"], not q["gap"] and not d["gap"] and len(lengths) == 1 and min(lengths) > 0, max(lengths, default=0)


def _rows(batch, column: str) -> np.ndarray:
    vectors = batch.column(column)
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _extended(df: DataFrame, fn, columns: list[tuple[str, T.DataType]]) -> DataFrame:
    """``df`` with columns that ``fn`` makes from the vectors of a batch:
    ``fn(batch)`` gives (row numbers to keep or None, new columns)."""
    schema = T.StructType(df.schema.fields + [T.StructField(name, kind) for name, kind in columns])

    def task(batches):
        for batch in batches:
            keep, new = fn(batch)
            kept = batch.columns if keep is None else batch.take(pa.array(keep)).columns
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, new)], names=[*batch.schema.names, *(n for n, _ in columns)])
    return df.mapInArrow(task, schema)


def _nearest_pivot(Q: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pivot, distance) of every row; the first of equally near pivots."""
    sides, best, bound = Sides(Q, pivots), Nearest(len(Q), 1, np.arange(len(pivots))), np.full(len(Q), np.inf)
    for at in range(0, len(Q), CHUNK_Q):
        scan(sides, best, bound, np.arange(at, min(at + CHUNK_Q, len(Q))), slice(0, len(pivots)), None, False)
    return np.maximum(best.at[:, 0], 0).astype(np.int32), np.sqrt(best.d[:, 0])


def _pruned(qv: DataFrame, dv: DataFrame, by: list[str], k: int, n_donor: int, exclude_self: bool,
            schema: T.StructType, q_block_rows: int, d_block_rows: int, most: int) -> DataFrame:
    """Candidates that hold every query's k nearest donors.

    Pivots are the donors of least key hash.  A cell knows its radius and its
    donors; more than ``d_block_rows`` of them are cut by a key hash.  Cell
    blocks, in the order of the pivots along their main axis, are packed into
    tiles of at most ``most`` donors (fewer where that would leave cores idle),
    and the queries that meet a tile are cut by a key hash, so a group holds
    about ``q_block_rows`` queries and ``most`` donors whatever the skew.  The
    shuffle carries a query once for every tile that can hold one of its
    neighbours."""
    spark = qv.sparkSession
    n_pivots = min(MAX_PIVOTS, -(-n_donor // d_block_rows) * 4)
    first = dv.orderBy(F.xxhash64("_d"), "_d").limit(n_pivots).select("_v").collect()
    pivots = np.unique(np.array([r["_v"] for r in first], float), axis=0)
    axis = np.linalg.svd(pivots - pivots.mean(axis=0), full_matrices=False)[2][0]
    pivots = pivots[np.argsort(pivots @ axis, kind="stable")]

    def nearest(batch):
        return None, list(_nearest_pivot(_rows(batch, "_v"), pivots))
    placed = [("_cell", T.IntegerType()), ("_away", T.DoubleType())]
    donors = materialize(_extended(dv, nearest, placed).withColumn("_h", F.xxhash64("_d")))
    stats = {r["_cell"]: r for r in donors.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_away").alias("r")).collect()}
    radius = np.array([stats[c]["r"] if c in stats else -np.inf for c in range(len(pivots))])
    tile_rows = max(d_block_rows, min(most, -(-n_donor // spark.sparkContext.defaultParallelism)))
    # blocks of a cell, the cell's first block, and every block's tile: about a number a pivot
    blocks = np.array([-(-stats[c]["n"] // d_block_rows) if c in stats else 1 for c in range(len(pivots))])
    start = np.r_[0, np.cumsum(blocks)[:-1]]
    held = np.repeat([stats[c]["n"] if c in stats else 0 for c in range(len(pivots))] / blocks, blocks)
    tile = np.zeros(len(held), np.int32)
    room, now = tile_rows, 0
    for i, n in enumerate(held):
        if n > room and room < tile_rows:
            room, now = tile_rows, now + 1
        tile[i], room = now, room - n
    n_tiles = now + 1

    def at_home(batch):
        cell, h = batch.column("_cell").to_numpy(), batch.column("_h").to_numpy()
        return None, [tile[start[cell] + h % blocks[cell]]]
    home = [("_tile", T.IntegerType())]
    donors = _extended(donors, at_home, home).select(*by, "_d", "_v", "_cell", "_tile")
    meet = _meet(schema, by, k, exclude_self, (pivots, radius))

    def met(asked: DataFrame) -> DataFrame:
        """Top k of each query in each tile that it asks."""
        load = {r["_tile"]: -(-r["count"] // q_block_rows) for r in asked.groupBy("_tile").count().collect()}
        loads = F.broadcast(spark.createDataFrame(sorted(load.items()), "_tile int, _nq int"))  # one row a tile
        q = asked.join(loads, "_tile").withColumn("_qb", F.pmod(F.xxhash64("_q"), F.col("_nq")).cast("int"))
        d = donors.join(loads, "_tile").withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
        keys = by + ["_tile", "_qb"]
        return (q.select(*keys, "_q", "_v", "_cell", "_u").groupBy(*keys)
                 .cogroup(d.select(*keys, "_d", "_v", "_cell").groupBy(*keys)).applyInArrow(meet, schema))

    homes = _extended(_extended(qv, nearest, placed).withColumn("_h", F.xxhash64("_q")), at_home, home)
    homes = materialize(homes.withColumn("_u", F.lit(None).cast("double")))
    near = materialize(met(homes))
    bound = near.groupBy("_q").agg(F.count(F.lit(1)).alias("_n"), F.max("d2").alias("_d2"))
    bound = bound.select("_q", F.when(F.col("_n") >= k, F.col("_d2")).alias("_u"))
    bounded = homes.select(*by, "_q", "_v", "_cell", F.col("_tile").alias("_home")).join(bound, "_q", "left")
    cells = np.flatnonzero(np.isfinite(radius))
    cell_of = np.repeat(np.arange(len(pivots)), blocks)

    def reachable(batch):
        reach = np.sqrt(batch.column("_u").to_numpy(zero_copy_only=False).astype(float)) * (1 + SLACK)
        own, home = batch.column("_cell").to_numpy(), batch.column("_home").to_numpy()
        low = np.full((len(own), len(pivots)), np.inf)
        low[:, cells] = lower_bounds(_rows(batch, "_v"), own, (pivots, radius), cells)
        asks = np.zeros((len(own), n_tiles), bool)
        within = ~(low > reach[:, None]) & np.isfinite(low)  # without a bound every cell
        for t in range(n_tiles):
            asks[:, t] = within[:, np.unique(cell_of[tile == t])].any(axis=1)
        asks[np.arange(len(own)), home] = False
        row, t = np.nonzero(asks)
        return row, [t.astype(np.int32)]
    asked = materialize(_extended(bounded, reachable, home))
    return near.unionByName(met(asked))


# ---------------------------------------------------------------- kNN imputation

#: Donors of a tile: smaller ones bound a k-th distance with fewer pairs, larger ones have fewer boxes.
TILE_ROWS = 1 << 14
#: Sampled donors a tile of the tree that cuts them, most of them, and most boxes of tiles that are collected.
SAMPLE, MAX_SAMPLE, MAX_BOXES = 64, 1 << 16, 1 << 15


def _tree(X: np.ndarray, tiles: int) -> list[tuple]:
    """A tree that cuts the rows into about ``tiles`` parts along their widest
    coordinates: (feature, threshold, left, right) or (-1, 0, part, 0) by node."""
    nodes, parts, waiting = [None], 0, [(0, X, tiles)]
    while waiting:
        at, x, n = waiting.pop()
        spread = x.var(axis=0) if n > 1 and len(x) > 1 else np.zeros(1)
        f = int(spread.argmax())
        cut = float(np.quantile(x[:, f], (n // 2) / n)) if spread[f] > 0 else 0.0
        low = x[:, f] <= cut
        if not spread[f] > 0 or low.all() or not low.any():
            nodes[at] = (-1, 0.0, parts, 0)
            parts += 1
            continue
        nodes[at] = (f, cut, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        waiting += [(len(nodes) - 1, x[~low], n - n // 2), (len(nodes) - 2, x[low], n // 2)]
    return nodes


def _placed(nodes: list[tuple], X: np.ndarray) -> np.ndarray:
    """The part of every row."""
    out, waiting = np.zeros(len(X), np.int32), [(0, np.arange(len(X)))]
    while waiting:
        at, rows = waiting.pop()
        f, cut, left, right = nodes[at]
        if f < 0:
            out[rows] = left
        elif len(rows):
            low = X[rows, f] <= cut
            waiting += [(left, rows[low]), (right, rows[~low])]
    return out


def _candidates(recv: DataFrame, donors: DataFrame, p: int, use_idx: list[int], k: int, q_block_rows: int,
                d_block_rows: int) -> DataFrame:
    """(_q, _c, nbr, d2, v): rows that hold the k nearest donors of every
    missing cell.

    Donors are cut into tiles by a tree over a sample (what a row lacks counts
    as the mean there), large tiles by a key hash.  A receiver meets the tile
    that it falls into, which bounds its k-th distances, and then goes to the
    tiles where the box of some set of present coordinates is not too far."""
    spark = recv.sparkSession
    dv = donors.withColumn("_h", F.xxhash64("_d"))
    n_donor = dv.count()
    tiles = max(1, math.ceil(n_donor / d_block_rows))
    first = dv.orderBy("_h", "_d").limit(min(MAX_SAMPLE, SAMPLE * tiles)).select("_v").collect()
    sample = np.array([r["_v"] for r in first], float).reshape(-1, p)
    with np.errstate(all="ignore"):
        finite = np.where(np.isfinite(sample), sample, np.nan)
        mean = np.nan_to_num(np.nansum(finite, axis=0) / np.isfinite(finite).sum(axis=0))
    nodes = _tree(np.where(np.isnan(finite), mean, finite), tiles)

    def place(batch):
        x = _gaps(batch)
        return None, [_placed(nodes, np.where(np.isnan(x), mean, x))]
    home = [("_tile", T.IntegerType())]
    present = F.concat(*[F.when(F.col("_v")[j].isNull() | F.isnan(F.col("_v")[j]), "0").otherwise("1") for j in range(p)])
    dv = materialize(_extended(dv, place, home).withColumn("_has", present))
    ends = [x for j in range(p) for x in (F.min(F.col("_v")[j]).alias(f"lo{j}"), F.max(F.col("_v")[j]).alias(f"hi{j}"))]
    held = {r["_tile"]: max(1, math.ceil(r["count"] / d_block_rows)) for r in dv.groupBy("_tile").count().collect()}
    found = dv.groupBy("_tile", "_has").agg(*ends).limit(MAX_BOXES + 1).collect()
    box_tile = np.array([r["_tile"] for r in found], int)
    boxes = None if len(found) > MAX_BOXES else Leaves.of_boxes(
        *(np.array([[r[f"{e}{j}"] for j in range(p)] for r in found], float).reshape(-1, p) for e in ("lo", "hi")),
        np.array([[x == "1" for x in r["_has"]] for r in found], bool).reshape(-1, p))
    schema = T.StructType([T.StructField("_q", T.LongType()), T.StructField("_c", T.IntegerType()),
                           T.StructField("nbr", T.LongType()), T.StructField("d2", T.DoubleType()),
                           T.StructField("v", T.DoubleType())])

    def group(receivers: pa.Table, givers: pa.Table) -> pa.Table:
        if not receivers.num_rows or not givers.num_rows or not use_idx:
            return _empty(schema)
        Q, D, qk, dk = _vectors(receivers), _vectors(givers), _keys(receivers, "_q"), _keys(givers, "_d")
        U = _limits(receivers.column("_u").combine_chunks(), len(Q), p)
        sides, leaves, found = Sides(Q, D), Leaves(D), []
        parts = [(has, part) for has, rows in _by_pattern(Q) for part in _halved(Q, rows, TOGETHER)]
        for j in use_idx:
            best, bound = Nearest(len(Q), k, dk), U[:, j].copy()
            for has, part in parts:
                if not has[j]:
                    leaves.search(sides, best, bound, part, has, qk, False, j)
            slot, d2, at = best.found()
            found.append((qk[slot], np.full(len(slot), j, np.int32), dk[at], d2, D[at, j]))
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=to_arrow_schema(schema))

    blocks = spark.createDataFrame(sorted(held.items()) or [(0, 1)], "_tile int, _nd int")

    def met(asked: DataFrame) -> DataFrame:
        """Candidates of each receiver in each tile that it asks."""
        load = {r["_tile"]: math.ceil(r["count"] / q_block_rows) for r in asked.groupBy("_tile").count().collect()}
        loads = blocks.join(spark.createDataFrame(sorted(load.items()), "_tile int, _nq int"), "_tile")    # one row a tile
        q = (asked.join(F.broadcast(loads), "_tile").withColumn("_qb", F.pmod(F.xxhash64("_q"), F.col("_nq")).cast("int"))
             .withColumn("_db", F.explode(F.sequence(F.lit(0), F.col("_nd") - 1))))
        d = (dv.join(F.broadcast(loads), "_tile").withColumn("_db", F.pmod(F.col("_h"), F.col("_nd")).cast("int"))
             .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))))
        keys = ["_tile", "_qb", "_db"]
        return (q.select(*keys, "_q", "_v", "_u").groupBy(*keys)
                .cogroup(d.select(*keys, "_d", "_v").groupBy(*keys)).applyInArrow(group, schema))
    homes = materialize(_extended(recv, place, home).withColumn("_u", F.lit(None).cast("array<double>")))
    near = materialize(met(homes))
    if len(held) < 2:
        return near
    kth = near.groupBy("_q", "_c").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("d2")).filter(F.col("n") >= k)
    kth = kth.groupBy("_q").agg(F.array(*[F.max(F.when(F.col("_c") == j, F.col("d2"))) for j in range(p)]).alias("_u"))
    bounded = homes.select("_q", "_v", F.col("_tile").alias("_home")).join(kth, "_q", "left")
    others = sorted(held)

    def reachable(batch):
        X, own = _gaps(batch), batch.column("_home").to_numpy()
        U = _limits(batch.column("_u"), len(X), p)
        asks = np.zeros((len(X), max(others) + 1), bool)
        if boxes is None:
            asks[:, others] = True
        else:
            for has, rows in _by_pattern(X):
                for at in range(0, len(rows), CHUNK_Q):
                    part = rows[at:at + CHUNK_Q]
                    low = boxes.apart(X[part], X[part], has, np.arange(len(box_tile)))
                    for j in [j for j in use_idx if not has[j]]:
                        which = np.flatnonzero(boxes.mask[:, j])
                        r, b = np.nonzero(~(low[:, which] > U[part, j][:, None]) & (low[:, which] != np.inf))
                        asks[part[r], box_tile[which[b]]] = True
        asks[np.arange(len(X)), own] = False
        row, t = np.nonzero(asks)
        return row, [t.astype(np.int32)]
    return near.unionByName(met(materialize(_extended(bounded, reachable, home))))


def _gaps(batch) -> np.ndarray:
    """The vectors of a batch, NaN where a number is missing."""
    column = batch.column("_v")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _limits(column, n: int, p: int) -> np.ndarray:
    """(rows, p) bounds from lists of numbers; infinity where there is none."""
    out = np.full((n, p), np.inf)
    whole = np.flatnonzero(np.asarray(column.is_valid()))
    if len(whole):
        out[whole] = pc.fill_null(column.flatten(), np.inf).to_numpy(zero_copy_only=False).reshape(-1, p)
    return out


def knn_impute(df: DataFrame, cols: list[str], key: str = "patient_id", k: int = 7,
               q_block_rows: int = 65536, d_block_rows: int = TILE_ROWS) -> DataFrame:
    """Distance-weighted kNN imputation over ``cols`` (all numeric columns).

    For every missing cell (row r, column c) the donors are rows with c
    present; the k nearest by (d2, key) are averaged with weights 1/d (only
    the zero-distance donors, equally, if any); no usable donor gives the
    column mean.  Distances use the original (unimputed) values.
    """
    base = df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])
    means = base.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    usable = [c for c in cols if means[c] is not None]          # all-missing columns are left as is
    any_missing = F.lit(False)
    for c in usable:
        any_missing = any_missing | F.col(c).isNull()
    recv = base.filter(any_missing).select(F.col(key).cast("long").alias("_q"), _vector(cols).alias("_v"))
    donors = base.select(F.col(key).cast("long").alias("_d"), _vector(cols).alias("_v"))
    col_index = {c: i for i, c in enumerate(cols)}
    cand = _candidates(recv, donors, len(cols), [col_index[c] for c in usable], k, q_block_rows, d_block_rows)
    w = Window.partitionBy("_q", "_c").orderBy("d2", "nbr")
    top = cand.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
    wt = F.try_divide(F.lit(1.0), F.sqrt(F.col("d2")))   # NULL at d2 = 0 (that case averages)
    zero = F.col("d2") == 0
    imp = top.groupBy("_q", "_c").agg(
        F.when(F.count_if(zero) > 0, F.avg(F.when(zero, F.col("v"))))
         .otherwise(F.sum(F.col("v") * wt) / F.sum(wt)).alias("_iv"))
    wide = imp.groupBy("_q").pivot("_c", [col_index[c] for c in usable]).agg(F.first("_iv"))
    wide = wide.select(F.col("_q"), *[F.col(str(col_index[c])).alias(f"_i_{c}") for c in usable])
    j = base.join(wide, base[key].cast("long") == wide["_q"], "left")
    out = []
    for c in df.columns:
        if c in usable:
            out.append(F.coalesce(F.col(c), F.col(f"_i_{c}"), F.lit(float(means[c]))).alias(c))
        elif c in cols:
            out.append(F.col(c))
        else:
            out.append(F.col(c))
    return j.select(*out)
