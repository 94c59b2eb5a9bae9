"""The pipeline against a brute-force version, and its stages on odd rows."""

import os
import sys

import duckdb
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from somnolyt.llm import catalog
from somnolyt.llm.storage import stored

sys.path.insert(0, os.path.dirname(__file__))
import edge_rows as edge  # noqa: E402

SF = "/root/testdata/sf0.001"


def _plain(rows, model):
    """Kept (doc_id, text) of plain stages up to packing."""
    rows = [(d, t) for d, t in rows if model.probability(*model.segments(t)) < 0.5]
    groups = {}
    for d, t in rows:
        groups.setdefault("".join(edge.words(t)), []).append((d, t))
    rows = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    roots, first = edge.components([edge.fingerprint(t) for _, t in rows]), {}
    for row, root in zip(rows, roots):
        first.setdefault(root, row)
    rows = list(first.values())
    return [(d, " ".join(k) if len(k) < len(edge.words(t)) else t)
            for (d, t), k in zip(rows, edge.without_repeats([t for _, t in rows]))]


def test_run_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall()
    model = catalog.toxicity_model(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [1] for d, t in _plain(rows, model)}
    edge.pieces_are_whole(corpus_pipeline.run(spark, SF).collect(), ids)


def test_stages_on_odd_rows(spark):
    """Every stage keeps the columns, survives odd rows and empty tables."""
    docs = edge.documents(spark)
    model = catalog.toxicity_model(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    want = _plain(edge.ROWS, model)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0
        columns = docs.columns
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
    got = docs.select("doc_id", "text", "n_chars").collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, want))
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
