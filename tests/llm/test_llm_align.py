"""Cross-tokenizer alignment against plain loops."""

import hashlib
import os
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as E
from somnolyt.llm import align

sys.path.insert(0, os.path.dirname(__file__))
import edge_rows as edge  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["a  b", "a▁b c", " a", "a ", "a\n b", "<|endoftext|> x</s>", "😀😀 x", "\0", "▁", "  ", "x" * 3000 + " " + "é" * 2000]


def brute(rows):
    """Result rows by plain loops over the libraries' tokens."""
    lib_a, lib_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib_a.encode_special_tokens = True
    back = align.byte_alphabet()
    spell_a = lambda i: bytes(back[c] for c in lib_a.id_to_token(i))
    spell_b = lambda i: (bytes([int(lib_b.id_to_piece(i)[3:5], 16)]) if lib_b.is_byte(i)
                         else lib_b.id_to_piece(i).replace("▁", " ").encode())
    aligned, holders = [], Counter()
    for doc_id, text in rows:
        a = lib_a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = lib_b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(map(spell_a, a)) != want or b"".join(map(spell_b, b)) != want:
            a, b = [], []
        groups, at_a, at_b, i, j = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                groups[-1][0].append(a[i])
                at_a += len(spell_a(a[i]))
                i += 1
            else:
                groups[-1][1].append(b[j])
                at_b += len(spell_b(b[j]))
                j += 1
            if at_a == at_b:
                groups.append(([], []))
        groups = groups[:-1]
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        holders.update(set(links))
        aligned.append((doc_id, a, b, groups, links))
    highest = defaultdict(int)
    for (x, _), n in holders.items():
        highest[x] = max(highest[x], n)
    out = Counter()
    for doc_id, a, b, groups, links in aligned:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[doc_id, len(a), len(b), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if holders[p] == highest[p[0]]),
            sum(n * holders[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if a else ""] += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.sampled_from([1, 2, 3, 7, 500]))
def test_pieces_find_every_shared_end(a, b, step):
    a, b = np.array(sorted(a), int), np.array(sorted(b), int)
    x, y = align.shared_ends(a, b, step)
    both = np.intersect1d(a, b)
    assert a[x - 1].tolist() == both.tolist() == b[y - 1].tolist()


def test_pieces_have_equal_work():
    a, b = np.arange(3, 9000, 3), np.arange(7, 9000, 7)
    cut = align.crossings(a, b, 100)
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    assert [sum(side == 0 for _, side in merged[:d]) for d in range(0, len(merged), 100)] == cut[:-1].tolist()


@pytest.mark.parametrize("small", [False, True])
def test_rows(spark, monkeypatch, small):
    """Odd rows; ``small`` runs the same rows over many chunks, pieces, link slices and large groups."""
    rows = edge.ROWS + [(100 + i, t) for i, t in enumerate(ODD)]
    if small:
        real = align.shared_ends
        monkeypatch.setattr(align, "shared_ends", lambda a, b: real(a, b, 5))
        monkeypatch.setattr(align, "LINKS_AT_ONCE", 50)
        monkeypatch.setattr(align, "LARGE_GROUP", 1)
        line = align.Line(align.tokenizer_pair(A, B), [t for _, t in rows])
        monkeypatch.undo()
        plain = align.Line(align.tokenizer_pair(A, B), [t for _, t in rows])
        assert all((x == y).all() for x, y in zip(line.linked(), plain.linked())) and line.digests() == plain.digests()
        return
    got = Counter(map(tuple, align.alignment_digests(edge.documents(spark, rows).repartition(3), A, B).collect()))
    assert got == brute(rows)
    assert sum(n for row, n in got.items() if row[1] == 0) >= 5
    assert align.alignment_digests(edge.documents(spark, []), A, B).count() == 0


def test_groups_spell_the_text(spark):
    pair = align.tokenizer_pair(A, B)
    rows = align.aligned_groups(edge.documents(spark), A, B).collect()
    texts = Counter(map(str, edge.ROWS))
    for row in rows:
        a, b = (b"".join(spell[i] for g in row.groups for i in g[side]) for side, spell in (("a", pair.a_bytes), ("b", pair.b_bytes)))
        assert a == b and (not a or texts[str((row.doc_id, a[1:].decode()))])


def test_query_equals_plain_loops(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM read_parquet('/root/testdata/sf0.001/documents.parquet')").fetchall()
    got = E.queries()["op11_alignment"](spark, "/root/testdata/sf0.001")
    assert Counter(map(tuple, got.collect())) == brute(rows)
