"""Substring dedup with suffix automata of reference shards.

A window is ``length`` consecutive words of one document; a word goes if a
window that covers it also starts anywhere else in the corpus.

The reference is the corpus itself, so its automata have no size bound and
are not broadcast: every window is dealt to the one shard where all its equals
are, and each shard's automaton is built where its passages arrive.

1. Anchors.  In every window the leftmost least hash of its ANCHOR-word grams
   is its anchor; equal windows have equal anchors.  A run of windows with one
   anchor occurrence is a passage, so each window lies in exactly one passage
   and there are few passages to a document.  Anchors that occur once cannot
   hold a repeated window and end here.
2. Shards.  The words of the other passages are dealt by anchor.  An anchor
   with more than CROWDED passages is dealt by whole windows instead, and
   equal windows are summed before the shuffle.
3. Automata.  A shard's passages build a suffix automaton with the number of
   times each state's strings occur; then every passage is streamed through it
   for matching statistics: the longest suffix at each word that occurs twice.
   Where that reaches ``length`` the maximal span is recorded.
4. The spans return to their texts, and the words outside them are kept.

Texts are told apart by a 128-bit hash and travel compressed; copies of one
text are one text with a count, so a group of copies costs one passage set.

Defined results: null and empty texts have no words; texts shorter than a
window keep all words; rows are told apart by content, so repeated rows count
as occurrences of one another and get equal results; null ids are carried; an
empty table gives no rows; input columns travel as one struct, so extra
columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, stored
from .textkit import words_of

LENGTH = 35
#: Words of an anchor gram.
ANCHOR = 8
#: Passages of one anchor from which on they are dealt by whole windows.
CROWDED = 500
_LEVEL = 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def pack_text(text: str | None) -> bytes:
    return zlib.compress((text or "").encode("utf-8", "surrogatepass"), _LEVEL)


def text_id(text: str | None) -> bytes:
    return xxhash.xxh128_digest((text or "").encode("utf-8", "surrogatepass"))


def passages(words: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of each passage of a word sequence."""
    n = len(words) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    gram = min(ANCHOR, length)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        grams = h[:len(h) - gram + 1].copy()
        for j in range(1, gram):
            grams = grams * _BASE + h[j:len(h) - gram + 1 + j]
        grams ^= grams >> np.uint64(31)
        grams *= _MIX
        grams ^= grams >> np.uint64(29)
    per_window = length - gram + 1
    anchor_at = np.concatenate([
        at + np.lib.stride_tricks.sliding_window_view(grams[at:at + 65536 + per_window - 1], per_window).argmin(axis=1)
        + np.arange(min(65536, n - at)) for at in range(0, n, 65536)])
    first = np.flatnonzero(np.r_[True, anchor_at[1:] != anchor_at[:-1]])
    return grams[anchor_at[first]].view(np.int64), first, np.diff(np.r_[first, n])


class SuffixAutomaton:
    """Suffix automaton of several word sequences with occurrence counts."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _clone(self, at: int, word: int, old: int) -> int:
        """Split off the part of ``old`` that follows ``at`` by one word."""
        new = self._state(self.length[at] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = new
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = new
            at = self.link[at]
        return new

    def add(self, sequence: list[int], times: int) -> None:
        """Insert a sequence that occurs ``times`` times."""
        last = 0
        for word in sequence:
            have = self.next[last].get(word)
            if have is not None:
                last = have if self.length[have] == self.length[last] + 1 else self._clone(last, word, have)
            else:
                new, at = self._state(self.length[last] + 1, 0, {}), last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    have = self.next[at][word]
                    self.link[new] = have if self.length[have] == self.length[at] + 1 else self._clone(at, word, have)
                last = new
            self.count[last] += times

    def finish(self) -> None:
        """Sum the counts along the suffix links; then the longest suffix of
        each state that occurs at least twice."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for state in reversed(order):
            self.count[self.link[state]] += self.count[state]
        self.twice = [0] * len(self.next)
        for state in order:
            self.twice[state] = self.length[state] if self.count[state] >= 2 else self.twice[self.link[state]]

    def spans(self, sequence: list[int], length: int) -> list[tuple[int, int]]:
        """Maximal spans [from, to) of at least ``length`` words that occur twice."""
        state, matched, out = 0, 0, []
        for end, word in enumerate(sequence, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            long = min(matched, self.twice[state])
            if long >= length:
                if out and out[-1][1] >= end - long:
                    out[-1] = (min(out[-1][0], end - long), end)
                else:
                    out.append((end - long, end))
        return out


# --- tasks -----------------------------------------------------------------

ANCHORS = pa.schema([("anchor", pa.int64()), ("tid", pa.binary()), ("first", pa.int32()), ("n", pa.int32())])


def _anchor_task(length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, firsts, counts, ids, times = [], [], [], [], []
            for text in batch.column(0):
                text = text.as_py()
                a, f, n = passages(words_of(text), length)
                if len(a):
                    anchors.append(a), firsts.append(f), counts.append(n), ids.append(text_id(text)), times.append(len(a))
            if anchors:
                tid = pa.array(ids, pa.binary()).take(pa.array(np.repeat(np.arange(len(ids)), times)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(anchors)), tid, pa.array(np.concatenate(firsts).astype(np.int32)),
                     pa.array(np.concatenate(counts).astype(np.int32))], schema=ANCHORS)
    return task


PASSAGES = pa.schema([("shard", pa.int64()), ("crowded", pa.bool_()), ("words", pa.binary()), ("tid", pa.binary()),
                      ("first", pa.int32()), ("times", pa.int64())])


def _cut_task(length: int):
    """Words of the listed passages of each text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, packed, listed, times in zip(*(batch.column(i) for i in range(4))):
                words, tid, times, rows = zlib.decompress(packed.as_py()).split(), tid.as_py(), times.as_py(), []
                for p in listed.as_py():
                    first, n = p["first"], p["n"]
                    if p["crowded"]:
                        for at in range(first, first + n):
                            window = b" ".join(words[at:at + length])
                            rows.append((xxhash.xxh3_64_intdigest(window) - (1 << 63), True, window, tid, at, times))
                    else:
                        rows.append((p["anchor"], False, b" ".join(words[first:first + n + length - 1]), tid, first, times))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PASSAGES)],
                                                     schema=PASSAGES)
    return task


SPANS = pa.schema([("shard", pa.int64()), ("words", pa.binary()), ("tid", pa.binary()), ("begin", pa.int32()), ("end", pa.int32())])
#: Words from which on the shards seen so far become an automaton.
SHARD_WORDS = 100_000


def _shard_spans(rows: list[tuple], length: int) -> list[tuple]:
    """Spans of the passages of whole shards: (shard, words, tid, begin, end).

    Equal passages are inserted once with their summed count and streamed once."""
    total: dict[tuple[int, bytes], int] = {}
    for shard, words, _, _, times in rows:
        total[shard, words] = total.get((shard, words), 0) + times
    symbols: dict[tuple[int, bytes], int] = {}
    coded = {key: [symbols.setdefault((key[0], w), len(symbols)) for w in key[1].split()] for key in total}
    automaton = SuffixAutomaton()
    for key, times in total.items():
        automaton.add(coded[key], times)
    automaton.finish()
    found = {key: automaton.spans(sequence, length) for key, sequence in coded.items()}
    return [(shard, words if tid is None else None, tid, first + a, first + b)
            for shard, words, tid, first, _ in rows for a, b in found[shard, words]]


def _shard_task(length: int):
    """Rows sorted by shard; whole shards are gathered up to SHARD_WORDS words."""
    def out(spans: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*spans), SPANS)], schema=SPANS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, current = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != current and size >= SHARD_WORDS:
                    if spans := _shard_spans(held, length):
                        yield out(spans)
                    held, size = [], 0
                current = row[0]
                held.append(row)
                size += row[1].count(b" ") + 1
        if held and (spans := _shard_spans(held, length)):
            yield out(spans)
    return task


def kept_words(words: list[bytes], spans) -> list[bytes]:
    """Words outside the spans [begin, end)."""
    keep = np.ones(len(words), bool)
    for span in spans or ():
        keep[span["begin"]:span["end"]] = False
    return [w for w, k in zip(words, keep) if k]


# --- plan ------------------------------------------------------------------

def packed_rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(row, tid, packed): the named columns, the text's id and packed bytes."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text")
    schema = T.StructType([rows.schema["row"], T.StructField("tid", T.BinaryType()), T.StructField("packed", T.BinaryType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(text_id, texts), pa.binary()), pa.array(map(pack_text, texts), pa.binary())],
                names=["row", "tid", "packed"])
    return rows.mapInArrow(task, schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowded: int = CROWDED) -> DataFrame:
    """(tid, spans): the repeated spans of each text that has any, written, so
    that a join on tid can split the rows of a common text."""
    anchors = stored(docs.select("text").mapInArrow(_anchor_task(length), "anchor long, tid binary, first int, n int"), "anchor-rows")
    # written, so that the join below deals both sides anew and can split a common anchor's rows
    counts = stored(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= 2), "anchors")
    listed = (anchors.join(counts, "anchor")
              .groupBy("tid").agg(
                  F.collect_set(F.struct("anchor", "first", "n", (F.col("c") > crowded).alias("crowded"))).alias("listed"),
                  F.count(F.lit(1)).alias("rows"))
              .select("tid", "listed", (F.col("rows") / F.size("listed")).cast("long").alias("times")))
    texts = _texts(docs)
    cut = stored(texts.join(listed, "tid").select("tid", "packed", "listed", "times").mapInArrow(
        _cut_task(length), "shard long, crowded boolean, words binary, tid binary, first int, times long"), "passages")
    discard(anchors, counts)
    windows = (cut.filter("crowded").groupBy("shard", "words").agg(F.sum("times").alias("times")).filter("times >= 2")
               .select("shard", "words", F.lit(None).cast("binary").alias("tid"), F.lit(0).alias("first"), "times"))
    shards = (cut.filter("not crowded").select("shard", "words", "tid", "first", "times").unionByName(windows)
              .repartition("shard").sortWithinPartitions("shard"))
    spans = stored(shards.mapInArrow(_shard_task(length), "shard long, words binary, tid binary, begin int, end int"), "spans")
    direct = spans.filter("tid is not null").select("tid", "begin", "end")
    hot = (cut.filter("crowded").select("shard", "words", "tid", "first")
           .join(spans.filter("tid is null").select("shard", "words"), ["shard", "words"], "left_semi")
           .select("tid", F.col("first").alias("begin"), (F.col("first") + length).alias("end")))
    found = stored(direct.unionByName(hot).groupBy("tid").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "repeats")
    discard(cut, spans)
    return found


def _texts(docs: DataFrame) -> DataFrame:
    """(tid, packed) of each distinct text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(text_id, texts), pa.binary()),
                                              pa.array(map(pack_text, texts), pa.binary())], names=["tid", "packed"])
    packed = docs.select("text").mapInArrow(task, "tid binary, packed binary")
    return packed.groupBy("tid").agg(F.first("packed").alias("packed"))


def substring_dedup(docs: DataFrame, columns: list[str] | None = None, length: int = LENGTH,
                    crowded: int = CROWDED) -> DataFrame:
    """Every row: row (the named columns), kept_text, n_words, n_removed.

    kept_text is the kept words joined by one space."""
    rows = packed_rows(docs, docs.columns if columns is None else columns)
    joined = rows.join(repeated_spans(docs, length, crowded), "tid", "left").select("row", "packed", "spans")
    schema = T.StructType([rows.schema["row"], T.StructField("kept_text", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, gone = [], [], []
            for packed, spans in zip(batch.column(1), batch.column(2)):
                words = zlib.decompress(packed.as_py()).split()
                kept = kept_words(words, spans.as_py())
                texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                sizes.append(len(words))
                gone.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())],
                names=["row", "kept_text", "n_words", "n_removed"])
    return joined.mapInArrow(task, schema)
