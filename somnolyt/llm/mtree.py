"""Exact top-k search by inner product with an M-tree, best node first.

Vectors become integer points.  An M-tree keeps them in pages; an entry of an
inner page names a child page with its routing point, its covering radius, the
largest norm below it and its distance from the page's own routing point; an
entry of a leaf is a point with its norm and that same distance.  A query keeps
a heap of pages by their upper bound and always opens the best one.  Since
2<q,x> = |q|^2 + |x|^2 - d(q,x)^2, a lower bound of a distance bounds a score
from above, and the triangle inequality gives one without computing anything:
d(q,x) >= |d(q,p) - d(p,x)| - r with the stored d(p,x).  Only entries that this
does not rule out are multiplied.  Bounds carry slack for rounding and rule out
only what is strictly below the k-th score, so results are exact.

* Equal vectors share one entry with their k + 1 smallest ids and how often each
  occurs; any later id is outranked by those for every query.
* A bounded sample of the points (``SAMPLE``) gives the top level, at most
  ``SAMPLE`` cells; every point goes to its nearest cell.  A cell with more than
  ``TREE_ROWS`` points becomes several trees, cut by a hash, so no task builds or
  searches a larger one.  Pages are written to the shared folder.
* A query first searches one tree of its own cell; its k-th score there is a
  floor.  Then it goes only to cells whose bound reaches the floor, in blocks of
  ``BLOCK_QUERIES`` queries, and the best k of all trees are its result.

Broadcast are the cells alone: one routing point, radius and norm each.

Defined results: vectors that are null, empty, or hold a null or a non-finite
component take no part, nor do rows without an id; components beyond 2^28 after
scaling count as 2^28, so scores of up to 127 components fit 64 bits; vectors of
unlike length are compared as if the shorter ended in zeros; rows that carry the
query's id are its own and no candidates; repeated rows are candidates as often
as they occur, and a query id that occurs with several vectors asks once for
each distinct one; ties go to the smaller id; an empty table gives an empty
result; only the id and the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .textkit import batch_of

#: Fixed value: factor that turns components into integers.
SCALE = 256
#: Largest absolute component after scaling.
LARGEST = 1 << 28
#: Points that the top level is chosen from; points of one tree; entries of a page; queries of a block.
SAMPLE, TREE_ROWS, PAGE, BLOCK_QUERIES = 4096, 20_000, 512, 10_000
#: Relative slack of bounds, for rounding.
_SLACK = 1e-7

POINTS = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary())])


def points(rows: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): floor(scale * x) as little-endian 32-bit integers,
    without trailing zeros, so that equal points have equal bytes."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = batch.column(1)
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
            flat = np.clip(flat, -LARGEST, LARGEST).astype("<i4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            for at, to in zip(np.r_[0, ends[:-1]], ends):
                used = np.flatnonzero(flat[at:to])
                out.append(flat[at:at + (used[-1] + 1 if len(used) else 0)].tobytes())
            yield batch_of(POINTS, batch.column(0), out)
    vector = F.col(vector_column)
    good = vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (rows.filter(F.coalesce(good, F.lit(False)) & F.col(id_column).isNotNull())
            .select(F.col(id_column).cast("long"), vector.cast("array<double>"))
            .mapInArrow(task, "vec_id long, vector binary"))


def entries_of(found: DataFrame, k: int) -> DataFrame:
    """(vector, ids): distinct points with their k + 1 smallest ids and counts."""
    counted = found.groupBy("vector", "vec_id").agg(F.count("*").alias("n"))
    first = Window.partitionBy("vector").orderBy("vec_id")
    kept = counted.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    return kept.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))


def matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Points as rows of doubles, padded with zeros (exact: integers of 32 bits)."""
    out = np.zeros((len(blobs), width))
    for row, blob in zip(out, blobs):
        values = np.frombuffer(blob, "<i4")
        row[:len(values)] = values
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x from all rows of y."""
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0))


def scores(q: np.ndarray, x: np.ndarray, norm: float) -> np.ndarray:
    """Inner products as exact 64-bit integers; ``norm`` bounds the squared
    norms of x.  Every partial sum is at most |q||x|, so doubles hold small ones."""
    if (q @ q) * norm < 2.0 ** 105:
        return np.einsum("ij,j->i", x, q).astype(np.int64)  # one thread: a task has its own core only
    return x.astype(np.int64) @ q.astype(np.int64)


class Tree:
    """Pages of one M-tree: page 0 is the root.  ``build`` makes them from
    points, ``search`` opens them best first."""

    def __init__(self, pages: dict[int, dict]):
        self.pages = pages

    @classmethod
    def build(cls, x: np.ndarray, page: int = PAGE) -> "Tree":
        tree, norms = cls({}), (x * x).sum(axis=1)
        rng = np.random.default_rng(len(x))
        waiting, made = [(0, np.arange(len(x)), x[0] if len(x) else np.zeros(0))], 1
        while waiting:
            number, rows, centre = waiting.pop()
            if len(rows) <= page:
                tree.pages[number] = dict(leaf=True, at=rows, x=x[rows], norm=norms[rows], reach=np.zeros(len(rows)),
                                          above=distances(x[rows], centre[None])[:, 0])
                continue
            routing = rng.choice(rows, min(page, -(-3 * len(rows) // (2 * page))), replace=False)
            apart = distances(x[rows], x[routing])
            nearest = apart.argmin(axis=1)
            groups = [np.flatnonzero(nearest == i) for i in range(len(routing))]
            if max(map(len, groups)) > 0.9 * len(rows):  # points too alike for their distances to part them
                groups = np.array_split(np.arange(len(rows)), len(routing))
            kept = [i for i, g in enumerate(groups) if len(g)]
            tree.pages[number] = dict(
                leaf=False, at=np.arange(made, made + len(kept)), x=x[routing[kept]],
                norm=np.array([norms[rows[groups[i]]].max() for i in kept]),
                reach=np.array([apart[groups[i], i].max() for i in kept]),
                above=distances(x[routing[kept]], centre[None])[:, 0])
            waiting += [(made + j, rows[groups[i]], x[routing[i]]) for j, i in enumerate(kept)]
            made += len(kept)
        tree.pages[0]["centre"] = x[0] if len(x) else np.zeros(0)
        for p in tree.pages.values():
            p["largest"] = p["norm"].max(initial=0)
        return tree

    def search(self, q: np.ndarray, own: int, ids: list, k: int, floor: int | None = None) -> tuple[list, int]:
        """The k best (score, id) with score >= floor, id not ``own``, best
        first, and how many points were multiplied."""
        q2, length = q @ q, np.sqrt(q @ q)
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
        least, computed = -np.inf if floor is None else floor, 1
        heap = [(-np.inf, 0, distances(q[None], self.pages[0]["centre"][None])[0, 0])]
        while heap:
            bound, number, from_q = heapq.heappop(heap)
            if -bound < least:
                break
            page = self.pages[number]
            near = np.maximum(np.abs(from_q - page["above"]) * (1 - _SLACK) - page["reach"] * (1 + _SLACK), 0)
            open_ = np.flatnonzero((q2 + page["norm"]) * (0.5 + 2 * _SLACK) - near * near / 2 >= least - 1)
            if not len(open_):
                continue
            x = page["x"]
            if 2 * len(open_) > len(x):  # taking most rows out costs more than multiplying all
                product, computed = scores(q, x, page["largest"])[open_], computed + len(x)
            else:
                product, computed = scores(q, x[open_], page["largest"]), computed + len(open_)
            if page["leaf"]:
                hit = np.flatnonzero(product >= least)
                for i in hit[np.argsort(-product[hit])].tolist():
                    if product[i] < least:
                        break
                    for vec_id, n in ids[page["at"][open_[i]]]:
                        for _ in range(min(n, k) if vec_id != own else 0):
                            item = (int(product[i]), -vec_id)
                            if len(best) < k:
                                heapq.heappush(best, item)
                            elif item > best[0]:
                                heapq.heapreplace(best, item)
                    if len(best) == k:
                        least = max(least, best[0][0])
                continue
            reach, norm = page["reach"][open_], page["norm"][open_]
            x = x[open_]
            away = np.sqrt(np.maximum(q2 + (x * x).sum(axis=1) - 2.0 * product, 0))
            near = np.maximum(away * (1 - _SLACK) - reach * (1 + _SLACK), 0)
            upper = np.minimum((q2 + norm - near * near) / 2, product + length * reach)
            upper += _SLACK * (q2 + norm + length * reach) + 1
            for i in np.flatnonzero(upper >= least).tolist():
                heapq.heappush(heap, (-upper[i], int(page["at"][open_[i]]), away[i]))
        return [(score, -minus) for score, minus in sorted(best, key=lambda b: (-b[0], -b[1]))], computed


PAGES = pa.schema([("tree", pa.int64()), ("page", pa.int32()), ("leaf", pa.bool_()), ("points", pa.list_(pa.binary())),
                   ("children", pa.list_(pa.int32())), ("ids", pa.list_(pa.list_(pa.struct([("vec_id", pa.int64()), ("n", pa.int64())])))),
                   ("norm", pa.list_(pa.float64())), ("reach", pa.list_(pa.float64())), ("above", pa.list_(pa.float64())),
                   ("centre", pa.binary())])
_PAGES = ("tree long, page int, leaf boolean, points array<binary>, children array<int>, ids array<array<struct<vec_id:long,n:long>>>, "
          "norm array<double>, reach array<double>, above array<double>, centre binary")


def _packed(x: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in x.astype("<i4")]


def _builder(width: int):
    def build(group: pa.Table) -> pa.Table:
        ids, tree = group.column("ids").to_pylist(), group.column("tree")[0].as_py()
        made = Tree.build(matrix(group.column("vector").to_pylist(), width))
        rows = [dict(tree=tree, page=number, leaf=p["leaf"], points=_packed(p["x"]), norm=p["norm"], reach=p["reach"], above=p["above"],
                     children=None if p["leaf"] else p["at"], ids=[ids[i] for i in p["at"]] if p["leaf"] else None,
                     centre=p["centre"].astype("<i4").tobytes() if number == 0 else None) for number, p in made.pages.items()]
        return pa.Table.from_pylist(rows, PAGES)
    return build


def _tree_of(pages: pa.Table, width: int) -> tuple[Tree, list]:
    """A tree from its rows; leaf entries name places in the list of ids."""
    made, ids = {}, []
    for row in pages.to_pylist():
        at = np.array(row["children"], np.int64) if not row["leaf"] else np.arange(len(ids), len(ids) + len(row["points"]))
        if row["leaf"]:
            ids += [[(i["vec_id"], i["n"]) for i in some] for some in row["ids"]]
        made[row["page"]] = dict(leaf=row["leaf"], at=at, x=matrix(row["points"], width),
                                 **{c: np.array(row[c]) for c in ("norm", "reach", "above")})
        made[row["page"]]["largest"] = made[row["page"]]["norm"].max(initial=0)
        if row["page"] == 0:
            made[0]["centre"] = matrix([row["centre"]], width)[0]
    return Tree(made), ids


FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("nth", pa.int32())])
_FOUND = "query long, query_id long, vec_id long, score long, nth int"


def _searcher(width: int, k: int):
    def search(key: tuple, pages: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[] for _ in FOUND]
        if pages.num_rows and asked.num_rows:
            tree, ids = _tree_of(pages, width)
            columns = (asked.column(c).to_pylist() for c in ("query", "query_id", "vector", "floor"))
            for query, query_id, vector, floor in zip(*columns):
                best, _ = tree.search(matrix([vector], width)[0], query_id, ids, k, floor)
                for nth, (score, vec_id) in enumerate(best):
                    for column, value in zip(out, (query, query_id, vec_id, score, nth)):
                        column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, FOUND)], schema=FOUND)
    return search


def _cell_mapper(centres: np.ndarray, schema: pa.Schema):
    """Rows with a vector get their nearest cell and their distance from it."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector").to_pylist(), centres.shape[1])
            apart = distances(x, centres)
            cell = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int64)), pa.array(apart[np.arange(len(x)), cell]), pa.array((x * x).sum(axis=1))],
                schema=pa.schema([*batch.schema, *schema]))
    return task


def _cell_router(centres: np.ndarray, radius: np.ndarray, norm: np.ndarray, trees: list[np.ndarray], schema: pa.Schema):
    """Queries go to the trees of cells whose bound reaches their floor, except
    the one tree that they have searched."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("vector").to_pylist(), centres.shape[1])
            q2 = (q * q).sum(axis=1)[:, None]
            near = np.maximum(distances(q, centres) * (1 - _SLACK) - radius * (1 + _SLACK), 0)
            upper = np.minimum((q2 + norm - near * near) / 2, q @ centres.T + np.sqrt(q2) * radius)
            upper += _SLACK * (q2 + norm + np.sqrt(q2) * radius) + 1
            floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(float)
            row, cell = np.nonzero(~(upper < floor[:, None]))  # no floor: every cell
            tree = np.concatenate([trees[c] for c in cell] or [np.zeros(0, np.int64)])
            row = np.repeat(row, [len(trees[c]) for c in cell])
            other = tree != batch.column("searched").to_numpy()[row]
            taken = batch.take(pa.array(row[other]))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(tree[other], pa.int64())], schema=schema)
    return task


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k rows
    of ``rows`` with the highest inner product, ties to the smaller id."""
    spark = rows.sparkSession
    entries = stored(entries_of(points(rows, id_column, vector_column), k), "mtree-entries")
    asked = points(queries, id_column, vector_column).distinct().select(
        F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "vector")
    asked = stored(asked, "mtree-queries")

    total, widest = entries.agg(F.count("*"), F.max(F.octet_length("vector"))).first()
    n_queries, widest_query = asked.agg(F.count("*"), F.max(F.octet_length("vector"))).first()
    width, blocks = max(widest or 0, widest_query or 0, 4) // 4, -(-n_queries // BLOCK_QUERIES) or 1
    sample = [r.vector for r in entries.orderBy(F.xxhash64("vector")).limit(min(SAMPLE, -(-total // TREE_ROWS))).select("vector").collect()]
    centres = matrix([bytes(v) for v in sample], width) if sample else np.zeros((1, width))

    added = pa.schema([("cell", pa.int64()), ("away", pa.float64()), ("norm", pa.float64())])
    placed = stored(entries.mapInArrow(_cell_mapper(centres, added), "vector binary, ids array<struct<vec_id:long,n:long>>, cell long, away double, norm double"),
                    "mtree-cells")
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm")).collect()}
    n_trees = [-(-cells[c].n // TREE_ROWS) if c in cells else 0 for c in range(len(centres))]
    first_tree = np.cumsum([0, *n_trees])
    known = F.broadcast(spark.createDataFrame(
        [(c, n_trees[c], int(first_tree[c])) for c in sorted(cells)] or [(0, 1, 0)], "cell long, trees int, first long"))
    in_trees = placed.join(known, "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("vector"), F.col("trees"))).alias("tree"), "vector", "ids")
    pages = stored(in_trees.groupBy("tree").applyInArrow(_builder(width), _PAGES), "mtree-pages")

    # one tree of the query's own cell gives its floor
    homes = asked.mapInArrow(_cell_mapper(centres, added), "query long, query_id long, vector binary, cell long, away double, norm double")
    homes = stored(homes.join(known, "cell", "left").select(
        "query", "query_id", "vector", F.coalesce("first", F.lit(0)).alias("tree"), F.lit(None).cast("long").alias("floor")), "mtree-homes")
    first = stored(_search(pages, homes, width, k, blocks), "mtree-first")
    floors = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(
        "query", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    floored = homes.drop("floor").join(floors, "query", "left").select(
        "query", "query_id", "vector", "floor", F.col("tree").alias("searched"))
    trees = [np.arange(first_tree[c], first_tree[c + 1]) for c in range(len(centres))]
    radius, norm = (np.array([cells[c][name] if c in cells else 0.0 for c in range(len(centres))]) for name in ("radius", "norm"))
    routed = floored.mapInArrow(
        _cell_router(centres, radius, norm, trees, pa.schema([
            ("query", pa.int64()), ("query_id", pa.int64()), ("vector", pa.binary()), ("floor", pa.int64()),
            ("searched", pa.int64()), ("tree", pa.int64())])),
        "query long, query_id long, vector binary, floor long, searched long, tree long").drop("searched")
    found = first.unionByName(_search(pages, stored(routed, "mtree-routed"), width, k, blocks))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "nth")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(pages: DataFrame, asked: DataFrame, width: int, k: int, blocks: int) -> DataFrame:
    """Best k of each (query, tree): a tree meets its queries block by block."""
    at = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    pairs = at.select(F.col("tree").alias("of"), F.col("block").alias("part")).distinct()
    dealt = pages.join(pairs, F.col("tree") == F.col("of")).drop("of")
    return dealt.groupBy("tree", "part").cogroup(at.groupBy("tree", "block")).applyInArrow(_searcher(width, k), _FOUND)
