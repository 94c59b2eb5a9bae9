"""Alignment of two tokenizers' outputs by merge-path partitioning.

A text's tokens by tokenizer A and by tokenizer B cover the same bytes, so the
alignment is a merge of two sorted lists of byte ends: where both lists hold
the same end, a group of A and B tokens closes.

* The texts of a chunk are laid end to end as one line.  Both tokenizers end at
  every text's end, so no group crosses texts, and very long texts and many
  short ones are the same work.
* Merge path: diagonals of the merge grid, ``PIECE`` steps apart, are searched
  for their crossing with the path, all by one vectorised binary search.  The
  pieces between diagonals have equal work whatever the texts; each finds the
  ends that both sides share.  An end whose two sides fall on either side of a
  diagonal belongs to no piece; it is found at the diagonal, and differences of
  consecutive shared ends stitch the groups that pieces cut.
* Counts of id pairs are corpus-wide: a chunk is stored once with its distinct
  pairs and the documents that hold each; pairs are summed by a grouped
  aggregation, and the totals return to the chunks by a join on the pair.  The
  rows shuffled are a chunk's distinct pairs, never its links; no pair is
  broadcast and no chunk holds more than ``CHUNK_TOKENS`` tokens and one text.

Distinct words of a slice are tokenised once: no token of either vocabulary holds a space
after another character, so a text without runs of white space may be cut
before its spaces; other texts go through the tokenizers whole.

Defined results: null and empty texts, and texts that A's or B's tokens do not
spell byte by byte, have no tokens (zeros, empty digest) and count for no pair;
rows are handled one by one, so repeated rows and null ids keep their own
result and each row counts as a document; an empty table gives an empty result;
only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .textkit import batch_of, byte_alphabet, gather, slices

#: Steps of a piece; tokens after which a chunk is closed; texts and characters that are tokenised at a time
#: (one longer text goes alone); links that are laid out at a time.
PIECE, CHUNK_TOKENS, TEXTS_AT_ONCE, CHARS_AT_ONCE, LINKS_AT_ONCE = 1 << 14, 2_000_000, 2000, 2_000_000, 2_000_000
#: A group with more links than this is counted by its distinct ids.
LARGE_GROUP = 4096
#: Fixed value: the pattern that parts texts before byte-level merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that must not be cut at their spaces.
_WHOLE = re.compile(r"^ | (?:\s|$)")


class TokenizerPair:
    """Tokenizers A (byte-level BPE) and B (pieces with byte fallback), and the
    bytes of their tokens.

    A's merges make the ids in order, so its file is a list of ranks: any two
    tokens side by side that join to a token are the two that its merge names
    (what stands between two untouched ends was merged as if alone).  The rank
    encoder then gives the library's ids several times faster; a file whose
    merges are in another order is refused."""

    def __init__(self, a_path: str, b_path: str):
        alphabet = byte_alphabet()
        with open(a_path, encoding="utf-8") as text:
            file = json.load(text)
        named = [merge.split(" ") if isinstance(merge, str) else merge for merge in file["model"]["merges"]]
        special = {token["content"] for token in file["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        made = [file["model"]["vocab"]["".join(merge)] for merge in named]
        if made != list(range(256, 256 + len(made))):
            raise ValueError(f"{a_path}: ids are not in the order of the merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size()) for piece in [self.b.id_to_piece(i)]]
        self.a_length, self.b_length = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(x), np.uint8) for x in (self.a_bytes, self.b_bytes))

    def _spelled(self, words: list[str], n_cut: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of all words by A and by B (a space goes before each), how many
        each word has of either, and whether both spell the space and the word.
        The first ``n_cut`` words were cut at spaces, so A takes them as one text."""
        raw = [b" " + w.encode() for w in words]
        text, size = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(words))
        a = self.a.encode_ordinary("".join([" " + w for w in words[:n_cut]]))
        for word in words[n_cut:]:
            a += self.a.encode_ordinary(" " + word)
        a, b = np.array(a, np.int64), self.b.encode(words, num_threads=1)
        n_a = np.diff(np.searchsorted(np.cumsum(self.a_length[a]), np.cumsum(size), "right"), prepend=0)
        n_b = np.fromiter(map(len, b), np.int64, len(words))
        b = np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
        good = np.diff(np.r_[0, np.cumsum(self.b_length[b])][np.r_[0, np.cumsum(n_b)]]) == size
        same = gather(self.b_flat, self.b_length, b[np.repeat(good, n_b)]) == text[np.repeat(good, size)]
        good[np.repeat(np.flatnonzero(good), size[good])[~same]] = False
        if not np.array_equal(gather(self.a_flat, self.a_length, a), text):
            raise AssertionError("byte-level tokens spell their text")
        return [a, b], [n_a, n_b], good

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids and how many each text has, B ids and how many each text has;
        none for texts that are not spelled by both."""
        whole = [bool(t) and bool(_WHOLE.search(t)) for t in texts]
        cut = pc.split_pattern(pa.array([None if w or not t else t for t, w in zip(texts, whole)], pa.string()).fill_null(""), " ")
        coded = cut.values.dictionary_encode()
        words, codes, n_words = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy(), np.diff(cut.offsets.to_numpy())
        n_cut = len(words)
        at = np.cumsum(n_words) - n_words  # texts that are not cut have one empty word: it stands for the whole text, or goes
        for row, text in enumerate(texts):
            if whole[row]:
                codes[at[row]] = len(words)
                words.append(text)
        ids, counts, good = self._spelled(words, n_cut)
        doc = np.repeat(np.arange(len(texts)), n_words)
        kept = np.array([bool(t) for t in texts], bool)
        kept[doc[~good[codes]]] = False
        codes, doc = codes[kept[doc]], doc[kept[doc]]
        out = []
        for x, n in zip(ids, counts):
            out += [gather(x, n, codes), np.bincount(doc, n[codes], len(texts)).astype(np.int64)]
        return tuple(out)


def crossings(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> np.ndarray:
    """A elements before each diagonal of the merge of two increasing arrays
    (A first among equals), for diagonals 0, step, 2 step, ... and the last."""
    d = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        taken = np.zeros(len(d), bool)  # whether a[mid] is among the first d of the merge
        at = np.flatnonzero(open_)
        taken[at] = a[mid[at]] <= b[d[at] - mid[at] - 1]
        low = np.where(open_ & taken, mid + 1, low)
        high = np.where(open_ & ~taken, mid, high)
    return low


def shared_ends(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many A and B ends lie up to each end that both have, piece by piece."""
    cut_a = crossings(a, b, step)
    cut_b = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b)) - cut_a
    found_a, found_b = [], []
    for a0, a1, b0, b1 in zip(cut_a[:-1], cut_a[1:], cut_b[:-1], cut_b[1:]):
        left, right = a[a0:a1], b[b0:b1]
        if len(left) and len(right):
            at = np.searchsorted(right, left)
            hit = np.flatnonzero(right[np.minimum(at, len(right) - 1)] == left)
            found_a.append(hit + a0 + 1)
            found_b.append(at[hit] + b0 + 1)
        if a1 and b1 < len(b) and a[a1 - 1] == b[b1]:  # the diagonal parts the two sides of one end
            found_a.append(np.array([a1]))
            found_b.append(np.array([b1 + 1]))
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, int), np.zeros(0, int))


class Line:
    """The aligned line of a slice of texts: group bounds and each text's part."""

    def __init__(self, pair: TokenizerPair, texts: list[str | None]):
        self.pair = pair
        self.a, self.n_a, self.b, self.n_b = pair.encode(texts)
        ga, gb = shared_ends(np.cumsum(pair.a_length[self.a]), np.cumsum(pair.b_length[self.b]))
        self.a_start, self.b_start = np.r_[0, ga[:-1]][:len(ga)], np.r_[0, gb[:-1]][:len(gb)]
        self.m, self.n = ga - self.a_start, gb - self.b_start
        self.group_ends = np.searchsorted(ga, np.cumsum(self.n_a), "right")
        self.n_groups = np.diff(self.group_ends, prepend=0)
        self.doc = np.repeat(np.arange(len(texts)), self.n_groups)
        self.n_links = np.bincount(self.doc, self.m * self.n, len(texts)).astype(np.int64) if len(ga) else np.zeros(len(texts), np.int64)

    def digests(self) -> list[str]:
        """Hex SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each text ('' without tokens)."""
        shown = _shown(len(self.pair.a_bytes), len(self.pair.b_bytes))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        for ids, start, size, other, first in ((self.a, self.a_start, self.m, self.b_start, 0),
                                               (self.b, self.b_start, self.n, self.a_start + self.m, 2 * len(self.pair.a_bytes))):
            last = np.zeros(len(ids), np.int64)
            last[start + size - 1] = 1
            codes[np.arange(len(ids)) + np.repeat(other, size)] = first + 2 * ids + last
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            joined = "".join(map(shown.__getitem__, codes[at:at + n].tolist()))
            out.append(hashlib.sha256(joined[:-1].encode()).hexdigest() if n else "")
            at += n
        return out

    def linked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair code, links) of each text's distinct linked id pairs, in
        order; a pair's code is its A id times B's vocabulary plus its B id."""
        wide, keys, times = len(self.pair.b_bytes), [], []
        span = len(self.pair.a_bytes) * wide
        large = self.m * self.n > LARGE_GROUP
        for g in np.flatnonzero(large).tolist():
            (x, cx), (y, cy) = (np.unique(ids[s:s + k], return_counts=True) for ids, s, k in (
                (self.a, self.a_start[g], self.m[g]), (self.b, self.b_start[g], self.n[g])))
            keys.append((self.doc[g] * span + x[:, None] * wide + y).ravel())
            times.append((cx[:, None] * cy).ravel())
        size = np.where(large, 0, self.n)
        per_a, b_from = np.repeat(size, self.m), np.repeat(self.b_start, self.m)
        base = np.repeat(self.doc * span, self.m) + self.a * wide
        links = np.cumsum(per_a)
        at = 0
        while at < len(per_a):
            to = max(at + 1, int(np.searchsorted(links, (links[at - 1] if at else 0) + LINKS_AT_ONCE, "right")))
            n = per_a[at:to]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key, count = np.unique(np.repeat(base[at:to], n) + self.b[np.repeat(b_from[at:to], n) + inner], return_counts=True)
            keys.append(key)
            times.append(count)
            at = to
        if not keys:
            return (np.zeros(0, np.int64),) * 3
        key, count = np.concatenate(keys), np.concatenate(times)
        if len(keys) > 1:
            key, where = np.unique(key, return_inverse=True)
            count = np.bincount(where, count).astype(np.int64)
        return key // span, key % span, count


@lru_cache(maxsize=2)
def _shown(a_size: int, b_size: int) -> list[str]:
    """Decimal ids with what follows them: inside a side, and at its end."""
    return [f"{i}{c}" for i in range(a_size) for c in ",|"] + [f"{i}{c}" for i in range(b_size) for c in ",;"]


def text_slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """(ids, texts) of some rows at a time, bounded in rows and characters."""
    for part in slices(batch, TEXTS_AT_ONCE):
        ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
        slot = np.cumsum([len(t or "") for t in texts]) // CHARS_AT_ONCE
        for at, to in zip(bounds := np.flatnonzero(np.diff(slot, prepend=-1)), [*bounds[1:], len(texts)]):
            yield ids[at:to], texts[at:to]


@lru_cache(maxsize=2)
def tokenizer_pair(a_path: str, b_path: str) -> TokenizerPair:
    return TokenizerPair(a_path, b_path)


GROUPS = pa.schema([("doc_id", pa.int64()), ("groups", pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))])


def aligned_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, groups) of every row of (doc_id, text): each group's A ids and B ids in order."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(a_path, b_path)
        for batch in batches:
            for ids, texts in text_slices(batch):
                line = Line(pair, texts)
                groups = [{"a": line.a[s:s + m], "b": line.b[t:t + n]} for s, m, t, n in zip(
                    line.a_start.tolist(), line.m.tolist(), line.b_start.tolist(), line.n.tolist())]
                ends = line.group_ends.tolist()
                yield batch_of(GROUPS, ids, [groups[x:y] for x, y in zip([0, *ends], ends)])
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(
        task, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
CHUNKS = pa.schema([("chunk", pa.int64()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64())),
                    ("rows", pa.list_(pa.struct([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                                                 ("groups_sha256", pa.string()), ("picks", pa.binary())])))])


class _Chunk:
    """Texts whose pairs are counted together; a text's picks are places in the
    chunk's list of distinct pairs, and its links of each."""

    def __init__(self, number: int):
        self.number, self.rows, self.docs, self.pairs, self.links, self.tokens = number, [], [], [], [], 0

    def add(self, ids: list, line: Line) -> None:
        doc, code, count = line.linked()
        self.docs.append(doc + len(self.rows))
        self.pairs.append(code)
        self.links.append(count)
        self.rows += zip(ids, *(x.tolist() for x in (line.n_a, line.n_b, line.n_groups, line.n_links)), line.digests())
        self.tokens += len(line.a) + len(line.b)

    def batch(self) -> pa.RecordBatch:
        pairs, place, holders = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        picks = np.stack([place, np.concatenate(self.links)], axis=1).astype("<u4")
        ends = np.searchsorted(np.concatenate(self.docs), np.arange(len(self.rows)), "right")
        names = [f.name for f in CHUNKS.field("rows").type.value_type]
        rows = [dict(zip(names, (*row, picks[x:y].tobytes()))) for row, x, y in zip(self.rows, np.r_[0, ends], ends)]
        return batch_of(CHUNKS, [self.number], [pairs], [holders], [rows])


def _chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in batches:
            for ids, texts in text_slices(batch):
                chunk.add(ids, Line(pair, texts))
                if chunk.tokens >= CHUNK_TOKENS:
                    yield chunk.batch()
                    number += 1
                    chunk = _Chunk(number)
        if chunk.rows:
            yield chunk.batch()
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(
        task, f"chunk long, pairs array<long>, holders array<long>, rows array<struct<{DIGEST.replace(' ', ':').replace(',:', ',')},picks:binary>>")


def pair_counts(chunks: DataFrame, b_size: int) -> DataFrame:
    """(pair, documents, best): documents that hold each linked pair, and
    whether no other pair of the same A id is held by more."""
    totals = (chunks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
              .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("documents"))
              .withColumn("a", F.expr(f"pair div {b_size}")))
    totals = stored(totals, "pair-totals")
    highest = totals.groupBy("a").agg(F.max("documents").alias("highest"))
    return stored(totals.join(highest, "a").select("pair", "documents", (F.col("documents") == F.col("highest")).alias("best")), "pair-counts")


RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                    ("groups_sha256", pa.string())])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            totals = batch.column(1)[i].values
            size = 0 if totals is None else len(totals)
            documents, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
            if size:
                at = totals.field("place").to_numpy()
                documents[at] = totals.field("documents").to_numpy()
                best[at] = totals.field("best").to_numpy(zero_copy_only=False)
            out = []
            for row in batch.column(0)[i].as_py():
                place, links = np.frombuffer(row["picks"], "<u4").reshape(-1, 2).T.astype(np.int64)
                out.append((row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"],
                            int(links @ best[place]), int(links @ documents[place]), row["groups_sha256"]))
            yield batch_of(RESULT, *zip(*out))


def alignment_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is
    the most held of its A id), count_sum (documents of the pair, over links) and
    groups_sha256."""
    chunks = stored(_chunks(docs, a_path, b_path), "aligned")
    counts = pair_counts(chunks, len(tokenizer_pair(a_path, b_path).b_bytes))
    asked = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "documents", "best")).alias("totals"))
    return chunks.select("chunk", "rows").join(told, "chunk", "left").select("rows", "totals").mapInArrow(
        _scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
