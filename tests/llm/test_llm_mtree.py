"""M-tree search against comparing all pairs."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from somnolyt.llm import mtree

SCHEMA = "vec_id long, embedding array<double>, vector string, score long, tree int, n int, query string"


def brute(rows, queries, k):
    """Result rows by plain loops over Python integers."""
    def point(x):
        return x and all(v is not None and math.isfinite(v) for v in x) and [math.floor(256 * v) for v in x]
    valid = [(i, point(x)) for i, x in rows if i is not None and point(x)]
    def stripped(x):
        return tuple(x[:max((i + 1 for i, v in enumerate(x) if v), default=0)])
    out = Counter()
    for i, q in {(i, stripped(point(x))) for i, x in queries if i is not None and point(x)}:
        found = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in valid if j != i)[:k]
        out.update((i, rank + 1, j, -s) for rank, (s, j) in enumerate(found))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "v", 1, 2, 3, "q") for i, x in rows], SCHEMA)


def check(spark, rows, k=5, every=7):
    df = frame(spark, rows).repartition(3)
    got = mtree.top_k(df, df.filter(f"vec_id % {every} = 0"), k).collect()
    want = brute(rows, [(i, x) for i, x in rows if i is not None and i % every == 0], k)
    assert Counter(map(tuple, got)) == want
    return got


ODD = [(0, [0.1, 0.2]), (1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf")]), (None, [1.0, 1.0]),
       (6, [0.1, 0.2]), (7, [0.1, 0.2, 0.0]), (7, [0.1, 0.2]), (8, [-0.5, 0.25, 3.0]), (9, [0.0, 0.0]), (14, [100000.5, -2.0]),
       (14, [100000.5, -2.0]), (-21, [0.001]), (10, [0.1, 0.2]), (11, [0.1, 0.2]), (12, [0.1, 0.2]), (13, [0.1, 0.2]),
       (15, [0.1, 0.2]), (16, [0.1, 0.2]), (16, [0.1, 0.2])]


def test_odd_rows(spark):
    check(spark, ODD)
    check(spark, ODD[:3])
    check(spark, [])
    check(spark, [(7, [1.0])])


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_many_trees(spark, monkeypatch, kind):
    monkeypatch.setattr(mtree, "TREE_ROWS", 60)
    monkeypatch.setattr(mtree, "BLOCK_QUERIES", 20)
    r = np.random.default_rng(5)
    x = r.normal(size=(700, 6)) / 3
    if kind == "clusters":
        x = x / 20 + r.normal(size=(9, 6))[r.integers(0, 9, 700)]
    if kind == "copies":
        x[:400] = x[0]
    check(spark, [(i, v.tolist()) for i, v in enumerate(x)])


@pytest.mark.parametrize("page", [2, 8, 64])
def test_search_prunes_and_is_exact(page):
    r = np.random.default_rng(7)
    x = np.floor(256 * (r.normal(size=(12, 8))[r.integers(0, 12, 3000)] + r.normal(size=(3000, 8)) / 30))
    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    x = np.floor(4096 * x)
    tree, ids, work = mtree.Tree.build(x, page), [[(i, 1)] for i in range(len(x))], 0
    for q in range(0, 3000, 60):
        best, computed = tree.search(x[q], q, ids, 5)
        products = (x @ x[q]).astype(int)
        want = sorted(((int(p), i) for i, p in enumerate(products) if i != q), key=lambda t: (-t[0], t[1]))[:5]
        assert best == want
        work += computed
    assert work < 0.5 * 50 * len(x)


def test_scores_past_53_bits_are_exact():
    q = np.array([2.0 ** 28, -(2.0 ** 28) + 1, 3.0])
    x = np.array([[2.0 ** 28 - 1, 2.0 ** 28 - 3, 5.0]])
    assert mtree.scores(q, x, (x * x).sum())[0] == (1 << 28) * ((1 << 28) - 1) + (1 - (1 << 28)) * ((1 << 28) - 3) + 15


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({E.oracle_sql()['op12_mtree_topk']})").fetchall()
    got = E.queries()["op12_mtree_topk"](spark, sf).select("query_id", "rank", "vec_id", "score").collect()
    assert Counter(map(tuple, got)) == Counter(want) and len(got) == 50
