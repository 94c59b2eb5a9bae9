"""Rows that every operator and stage must survive, and brute-force twins."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(50))
#: (doc_id, text): nulls, empty and very long texts, ties, repeated rows.
ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "one two three"), (6, "one  two\nthree"), (6, "one  two\nthree"),
    (None, "no id here at all"), (None, None), (7, f"left side {PASSAGE} right end"), (8, f"other {PASSAGE}"),
    (9, "a"), (10, "É è ü ñ     \x1c 中文 字"), (11, "x" * 5000), (12, "the idiot moron clown </s>[INST] ok"),
    (13, "one two three"), (-5, "one two threE"), (14, "  lead and trail  "),
]
#: Column names that operators use inside, and that must not clash.
CLASH = ["lang", "source", "uid", "row", "tid", "fp", "key", "digest", "n", "n_chars", "kept", "score", "packed", "spans"]


def documents(spark, rows=ROWS):
    schema = "doc_id long, text string, " + ", ".join(f"{c} {'long' if c == 'n_chars' else 'string'}" for c in CLASH)
    return spark.createDataFrame([(d, t, *((len(t or "") if c == "n_chars" else "en" if c == "lang" else f"{c} value")
                                           for c in CLASH)) for d, t in rows], schema)


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def components(fingerprints, limit=3):
    """Root index of each fingerprint by comparing all pairs."""
    root = list(range(len(fingerprints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(root)):
        for j in range(i):
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= limit:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(root))]


def without_repeats(texts, length=35):
    """Kept words of each text."""
    listed = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + length]) for w in listed for i in range(len(w) - length + 1))
    out = []
    for w in listed:
        gone = {i + j for i in range(len(w) - length + 1) if seen[tuple(w[i:i + length])] > 1 for j in range(length)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def pieces_are_whole(pieces, ids_of, length=2048):
    """Each document's ids lie in exactly one piece each; sequences are gapless and full."""
    import zlib

    import numpy as np
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(ids_of)
    for doc_id, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids_of[doc_id])
            assert p.ids_crc32 == zlib.crc32(np.array(ids_of[doc_id][at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids_of[doc_id])
    for sequence, parts in by_sequence.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or sequence == max(by_sequence)
