"""Queries of the package: SQL twins, brute force, round trips, held-out accuracy."""

import hashlib
import os
import sys

import duckdb
import pytest

import __spark_entry__ as E

sys.path.insert(0, os.path.dirname(__file__))
import edge_rows as edge  # noqa: E402

SF = "/root/testdata/sf0.001"
QUALITY_SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_substring_dedup", "op6_exact_dedup", "op10_quality_rules"])
def test_equals_sql(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)
    res = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(r[i] for i in order) for r in res.fetchall()), key=str)


def test_every_number_is_registered():
    names = list(E.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1


def test_byte_bpe_equals_tiktoken(spark, con):
    import public_tokenizers as P
    import tiktoken

    from somnolyt.llm.bpe import coder
    ranks = coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for doc_id, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = library.encode_ordinary(text)
        want[doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                        hashlib.sha256(text.encode()).hexdigest())
    got = E.queries()["op5_byte_bpe"](spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_simhash_equals_all_pairs(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    fps = [edge.fingerprint(t) for _, t in rows]
    least = {}
    roots = edge.components(fps)
    for (doc_id, _), root in zip(rows, roots):
        least[root] = min(doc_id, least.get(root, doc_id))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in E.queries()["op3_simhash"](spark, SF).collect()}
    assert got == {d: (f"{fp:016x}", least[root]) for (d, _), fp, root in zip(rows, fps, roots)}


def test_packing_keeps_every_id(spark, con):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [1]
           for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    edge.pieces_are_whole(E.queries()["op9_packing"](spark, SF).collect(), ids)


@pytest.mark.parametrize("name, table, truth, least", [
    ("op4_toxicity", "labels", "toxic", 0.93), ("op7_quality_cnn", "labels", "quality", 0.97),
    ("op8_language_id", "documents", "lang", 0.98)])
def test_held_out_accuracy(spark, name, table, truth, least):
    rows = duckdb.sql(f"SELECT doc_id, {truth} FROM read_parquet('{QUALITY_SF}/{table}.parquet')").fetchall()
    known, n = dict(rows), duckdb.sql(f"SELECT count(*) FROM read_parquet('{QUALITY_SF}/documents.parquet')").fetchall()[0][0]
    got = E.queries()[name](spark, QUALITY_SF).collect()
    assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    said = [(r["lang_pred"] if truth == "lang" else r["predicted"], known[r.doc_id])
            for r in got if r.held_out and r.doc_id in known]
    assert sum(a == b for a, b in said) / len(said) >= least
