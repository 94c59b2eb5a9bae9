"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

The text is parted by the vocabulary's public pattern and every match is
merged on its own.  Over a match's bytes stands a segment tree whose leaf i
holds (rank of the pair that starts at byte i, i) and whose inner nodes hold
the minimum, so the root is the leftmost pair of least rank.  A merge clears
the leaf of the absorbed token and sets the leaves of the merged token and of
its live left neighbour: three point updates of logarithmic cost, made side by
side, so a match of n bytes takes O(n log n) whatever its length.

New matches of like size are merged side by side: a matrix holds one tree a
row, and each step merges at every row's root.

Work is one pass over the documents without a shuffle.  Results of matches
are kept in a memo of bounded size in each Python worker.

Defined results: null text counts as empty and gives no ids; rows are encoded
one by one, so repeated rows and null ids keep their own result; an empty
table gives an empty result; only the id and text columns are read, so other
columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .textkit import TwoGenerationCache, batch_of, gather, slices

#: A space that the fast cut must not use: white space (or the end) follows.
_RUN_OF_SPACE = re.compile(r" (?:\s|$)")
_FAR = 1 << 62
_POSITION = (1 << 32) - 1
#: Entries of one generation of a worker's memo; texts that go through at a time.
MEMO_ENTRIES, TEXTS_AT_ONCE = 400_000, 500
#: Longest match that is merged side by side with others; matches at a time.
SIDE_BY_SIDE, PIECES_AT_ONCE = 64, 4096


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one match: merges of least rank first, leftmost among equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n, rank_of = len(piece), ranks.get
    size = 1 << max(0, (n - 2).bit_length())
    tree = [_FAR] * (2 * size)
    for i in range(n - 1):
        rank = rank_of(piece[i:i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] != _FAR:
        at = tree[1] & _POSITION
        gone = after[at]
        end = after[gone]
        after[at] = end
        value = _FAR
        if end < n:
            before[end] = at
            rank = rank_of(piece[at:after[end]])
            if rank is not None:
                value = rank << 32 | at
        # three point updates side by side: ancestors that they share are set once
        low = mid = high = size + at
        tree[mid] = value
        if gone < n - 1:
            high = size + gone
            tree[high] = _FAR
        left = before[at]
        if left >= 0:
            rank = rank_of(piece[left:end])
            low = size + left
            tree[low] = _FAR if rank is None else rank << 32 | left
        while low > 1:
            low >>= 1
            mid >>= 1
            high >>= 1
            a, b = tree[2 * low], tree[2 * low + 1]
            tree[low] = a if a < b else b
            if mid != low:
                a, b = tree[2 * mid], tree[2 * mid + 1]
                tree[mid] = a if a < b else b
            if high != mid:
                a, b = tree[2 * high], tree[2 * high + 1]
                tree[high] = a if a < b else b
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return tuple(out)


class PairRanks:
    """Rank of the token that two tokens side by side make, looked up for many
    pairs at a time.  Every cut of a token into two tokens is one entry."""

    def __init__(self, ranks: dict[bytes, int]):
        cuts = [(ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items()
                for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        cuts.sort()
        self.pairs, self.ranks = (np.array(x, np.int64) for x in zip(*cuts))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, and -1 for pairs that make no token."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], -1)


def merge_many(pieces: list[bytes], byte_ids: np.ndarray, pair_ranks: PairRanks) -> list[bytes]:
    """``merge`` of many matches of up to 64 bytes, step by step side by side:
    a row per match holds its tree, and each step takes every row's root.
    Ids come as little-endian 32-bit numbers."""
    n = np.array([len(p) for p in pieces])
    size = 1 << int(n.max() - 1).bit_length()
    rows = len(pieces)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(rows, size)
    inside = np.arange(size) < n[:, None]
    ids = byte_ids[raw].astype(np.int64)
    tree = np.full((rows, 2 * size), _FAR, np.int64)
    row, at = np.nonzero(inside[:, 1:])
    rank = pair_ranks(ids[row, at], ids[row, at + 1])
    tree[row, size + at] = np.where(rank >= 0, rank << 8 | at, _FAR)
    level = size
    while level > 1:
        np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2], out=tree[:, level // 2:level])
        level //= 2
    after = np.tile(np.arange(1, size + 1), (rows, 1))
    before = np.tile(np.arange(-1, size), (rows, 1))
    live = np.arange(rows)
    while True:
        root = tree[live, 1]
        live, root = live[root != _FAR], root[root != _FAR]
        if not len(live):
            break
        at, new = root & 255, root >> 8
        gone = after[live, at]
        end = after[live, gone]
        ids[live, at] = new  # a token's id is its rank
        inside[live, gone] = False
        after[live, at] = end
        before[live, end] = at
        left = before[live, at]
        right = np.where(end < n[live], pair_ranks(new, ids[live, np.minimum(end, size - 1)]), -1)
        leftward = np.where(left >= 0, pair_ranks(ids[live, np.maximum(left, 0)], new), -1)
        tree[live, size + gone] = _FAR
        tree[live, size + at] = np.where(right >= 0, right << 8 | at, _FAR)
        low = np.where(left >= 0, left, at)
        tree[live, size + low] = np.where(left >= 0, np.where(leftward >= 0, leftward << 8 | left, _FAR),
                                          tree[live, size + low])
        paths = [size + low, size + at, size + gone]
        for _ in range(size.bit_length() - 1):
            paths = [node >> 1 for node in paths]
            for node in paths:
                tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
    flat, stops = ids[inside].astype("<i4").tobytes(), 4 * np.cumsum(inside.sum(axis=1))
    return [flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]


class ByteBPE:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.pair_ranks = PairRanks(self.ranks)
        self.pattern = regex.compile(pattern)
        self.pieces = TwoGenerationCache(None, MEMO_ENTRIES)
        self.spaced = TwoGenerationCache(None, MEMO_ENTRIES)

    def _new_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of matches: a match that is a token, a long one on its own, and
        the others by size, many at a time."""
        out: list[bytes | None] = []
        by_size: dict[int, list[int]] = {}
        raw = [p.encode() for p in pieces]
        for i, piece in enumerate(raw):
            whole = self.ranks.get(piece)
            if whole is not None:
                out.append(whole.to_bytes(4, "little"))
            elif len(piece) > SIDE_BY_SIDE:
                out.append(np.array(merge(piece, self.ranks), "<i4").tobytes())
            else:
                out.append(None)
                by_size.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for some in by_size.values():
            for at in range(0, len(some), PIECES_AT_ONCE):
                part = some[at:at + PIECES_AT_ONCE]
                for i, ids in zip(part, merge_many([raw[i] for i in part], self.byte_ids, self.pair_ranks)):
                    out[i] = ids
        return out

    def _matches(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are parted by the pattern as a whole."""
        listed = self.pieces.many_lists([self.pattern.findall(t) for t in texts], self._new_pieces)
        return [b"".join(ids) for ids in listed]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; each distinct word of them is worked out once.

        A cut before a space that a non-space follows never changes the
        matches: the pattern joins that space to what follows, and what
        stands before it ends there in any case.  Texts with runs of white
        space that hold a space are parted as a whole instead."""
        texts = [t or "" for t in texts]
        whole = [bool(_RUN_OF_SPACE.search(t)) for t in texts]
        cut = pc.split_pattern(pa.array(["" if w else t for t, w in zip(texts, whole)], pa.string()), " ")
        coded, offsets = cut.values.dictionary_encode(), cut.offsets.to_numpy()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        heads = self._matches([t if w else words[codes[at]] for t, w, at in zip(texts, whole, offsets)])
        values = self.spaced.many_lists([words], lambda new: self._matches([" " + word for word in new]))[0]
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        codes = np.delete(codes, offsets[:-1])
        tails = gather(np.frombuffer(b"".join(values), "<i4"), lengths, codes)
        ends = np.r_[0, np.cumsum(lengths[codes])][np.cumsum(np.diff(offsets) - 1)]
        return [np.concatenate([np.frombuffer(head, "<i4"), tail]) for head, tail in zip(heads, np.split(tails, ends[:-1]))]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> bytes:
        """Bytes of the ids; an id outside the vocabulary is an error."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> ByteBPE:
    """One coder a worker process, kept across tasks."""
    return ByteBPE(path, pattern)


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
DECODED = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of (doc_id, text)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            for part in slices(batch, TEXTS_AT_ONCE):
                ids = code.encode_all(part.column(1).to_pylist())
                yield batch_of(ENCODED, part.column(0), list(map(len, ids)), ids)
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(task, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) of every row of (doc_id, ids); null ids decode to nothing."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            yield batch_of(DECODED, batch.column(0), [code.decode(ids or ()) for ids in batch.column(1).to_pylist()])
    return encoded.select(encoded["doc_id"].cast("long"), "ids").mapInArrow(task, "doc_id long, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids and digest both within one pass, so that the ids
    of a large corpus need not travel between two Python stages."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        shown = list(map(str, range(max(code.tokens) + 1)))
        for batch in batches:
            for part in slices(batch, TEXTS_AT_ONCE):
                counts, ids_hex, bytes_hex = [], [], []
                for ids in map(np.ndarray.tolist, code.encode_all(part.column(1).to_pylist())):
                    counts.append(len(ids))
                    ids_hex.append(hashlib.sha256(" ".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                    bytes_hex.append(hashlib.sha256(code.decode(ids)).hexdigest())
                yield batch_of(DIGESTS, part.column(0), counts, ids_hex, bytes_hex)
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(
        task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
