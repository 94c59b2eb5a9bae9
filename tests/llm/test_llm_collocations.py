"""Collocations against plain loops, and the HAT-trie against a dictionary."""

import os
import random
import re
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from somnolyt.llm import collocations as C

sys.path.insert(0, os.path.dirname(__file__))
import edge_rows as edge  # noqa: E402


def brute(rows, top=2000):
    """Result rows by plain loops over (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= 30}
    longer = Counter()
    for p, c in f.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                q = (p[0], *p[i:i + k])
                longer[q] = max(longer[q], c)
    out = {}
    for p, a in f.items():
        if len(p) > 2 and 100 * longer[p] < 80 * a:
            score, _, left, right = min((2000000 * a // (f[p[:k + 1]] + f[p[0], *p[k + 1:]]), k, f[p[:k + 1]], f[p[0], *p[k + 1:]])
                                        for k in range(1, len(p) - 1))
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, rank + 1, ph.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
                  for rank, (s, a, ph, left, right) in enumerate(sorted(found)[:top]))


def rows_of(seed):
    r = random.Random(seed)
    words = ["the", "The", "old", "new", "york", "city", "é", "中文", "x1", "of", "rare\x1cword"]
    rows = [(r.choice(["en", "de", None, "und"]), " ".join(r.choices(words, k=r.randrange(60))) + r.choice([".", "!", "\n", ", the old\tnew york city "]))
            for _ in range(400)]
    return rows + [("en", None), ("en", ""), (None, None), ("fr", "one two"), ("en", "new york city of the old " * 3000)]


def test_equals_plain_loops(spark):
    rows = rows_of(1)
    frame = spark.createDataFrame([(*row, "p", 1, 2) for row in rows], "lang string, text string, phrase string, f long, size int").repartition(3)
    assert sorted(map(tuple, C.collocations(frame).collect())) == brute(rows)
    assert sorted(map(tuple, C.collocations(frame, 3).collect())) == brute(rows, 3)


@pytest.mark.parametrize("sieve", [None, np.full(4, 0xFFFFFFFF, np.uint32)])
def test_runs_of_many_spills_add_up(monkeypatch, sieve):
    for name, value in (("LIMIT", 300), ("VOCABULARY", 9), ("CHARS_AT_ONCE", 500)):
        monkeypatch.setattr(C, name, value)
    monkeypatch.setattr(C.HatTrie.__init__, "__defaults__", (3,))
    rows, want, got, runs = [(lang or "und", text or "") for lang, text in rows_of(2)], Counter(), Counter(), 0
    counter = C.Counter((1, 2) if sieve is None else (3, 4), sieve)
    batch = C.batch_of(C.pa.schema([("lang", C.pa.string()), ("text", C.pa.string())]), *zip(*rows))
    for lang, texts in C.text_groups(batch):
        for run in counter.add(lang, texts):
            phrases = run.column(1).to_pylist()
            named = list(zip(run.column(0).to_pylist(), phrases))
            assert len(set(named)) == len(named)
            got.update({(lang, p): 0 for p in phrases})
            for la, p, n in zip(*(c.to_pylist() for c in run.columns)):
                got[la, p] += n
            runs += 1
    for run in counter.finish():
        for la, p, n in zip(*(c.to_pylist() for c in run.columns)):
            got[la, p] += n
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want[lang, ""] += len(w)
            want.update((lang, " ".join(w[i:i + k])) for k in counter.lengths for i in range(len(w) - k + 1))
    assert +got == +want and runs > 20


def test_odd_rows(spark):
    docs = edge.documents(spark, edge.ROWS * 20)
    assert sorted(map(tuple, C.collocations(docs).collect())) == brute([("en", t) for _, t in edge.ROWS] * 20)
    assert C.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("burst", [1, 5, 1000])
def test_trie_holds_what_was_added(burst):
    r = np.random.default_rng(burst)
    trie, want, got = C.HatTrie(4, burst), Counter(), Counter()
    for _ in range(30):
        first, rest = r.integers(1, 6, 200), r.integers(0, 3, 200) << 42 | r.integers(0, 3, 200) << 21
        trie.add(first, rest)
        want.update(zip(first.tolist(), rest.tolist()))
        if trie.size > 20:
            before = trie.size
            gone = trie.take(10)
            assert len(gone[0]) == before - trie.size and trie.size <= 10
            got.update({(a, b): n for a, b, n in zip(*(x.tolist() for x in gone))})
    for a, b, n in zip(*(x.tolist() for x in trie.take())):
        got[a, b] += n
    assert got == want and trie.size == 0


def test_scores_are_exact_past_64_bits(spark):
    from pyspark.sql import functions as F
    a = 9_000_000_000_000_000
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(a + 7).alias("l"), F.lit(a * 3).alias("r")).select(
        F.expr(f"cast(a as decimal(20, 0)) * {C.SCORE_SCALE} div (cast(l as decimal(20, 0)) + r)")).first()
    assert row[0] == 2_000_000 * a // (a + 7 + a * 3)


def test_query_equals_sql_and_loops(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    rows = con.execute("SELECT lang, text FROM documents").fetchall()
    want = sorted(con.execute(E.oracle_sql()["op13_collocations"]).fetchall())
    got = sorted(map(tuple, E.queries()["op13_collocations"](spark, sf).collect()))
    assert got == want == brute(rows) and got
