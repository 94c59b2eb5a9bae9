"""Packing along a space-filling curve.

Each document is tokenised and its tokens, hashed to signs, are summed into a
point of few dimensions; the Hilbert index of that point is its sort key, so
documents of like content lie near one another on the curve.  Documents are
range-sorted by that key and laid end to end; the line is cut every
``length`` tokens, so all sequences but the last are full.

1. One pass writes (key, doc_id, uid, ids) to the shared folder.
2. Only (key, doc_id, uid, count) is range-sorted; running sums within each
   range and one total a range give every document its place.
3. The places return to the ids by uid, and each document is cut on its own.

No task holds more than a batch of documents, whatever the skew, and the only
thing summed in one task is one number per range partition.

Defined results: null text counts as empty (its end token is still packed);
ties on the curve go by doc_id (nulls first), then row; repeated rows are
packed as often as they occur; an empty table gives no pieces; only doc_id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .storage import stored
from .textkit import batch_of, byte_alphabet, coded_words, gather, slices

LENGTH = 2048
END_ID = 1
DIMENSIONS, BITS = 3, 10
_END = np.array([END_ID], "<u2").tobytes()
#: Texts and characters that go through at a time (one longer text goes alone).
TEXTS_AT_ONCE, CHARS_AT_ONCE = 2000, 2_000_000

#: The pre-tokenizer pattern of the public vocabulary file (fixed value), and a break between words.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
#: A marked piece: its bytes as characters, the last one 256 higher.
_MARKED = r"[\x00-\xff]*[\u0100-\u01ff]"


def marked(raw: bytes) -> str:
    return raw[:-1].decode("latin-1") + chr(0x100 + raw[-1])


class WordTokenizer:
    """Ids of the public word tokenizer, worked out once per distinct word of a
    slice of texts.

    The tokenizer drops white space and no merge crosses it, so a text's ids are
    its words' ids in order.  Latin-1 words need no normal form; they are
    lower-cased and cut into the tokenizer's own pieces here, and all pieces are
    merged in one call of a rank encoder: the file's merges make the ids in
    order, and a piece's last byte, whose symbol ends a word, is marked as a
    character of its own.  All other words go through the library one by one, as
    do words that hold one of the file's added tokens: those have no white
    space, so none spans two words, and letters as well as signs, so none is
    ever one piece."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.coder = self._rank_coder(path, vocabulary)
        self.last = {c: marked(c.encode()) for c in map(chr, range(128))}

    @staticmethod
    def _rank_coder(path: str, vocabulary: dict[str, int]) -> tiktoken.Encoding | None:
        """The merges as ranks; None if the file's ids are not in the order of its merges."""
        with open(path, encoding="utf-8") as text:
            merges = json.load(text)["model"]["merges"]
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if made != list(range(512, 512 + len(made))):
            return None
        alphabet, ranks = byte_alphabet(), {}
        for token, i in vocabulary.items():
            raw = bytes(alphabet[c] for c in token.removesuffix("</w>"))
            ranks[(marked(raw) if token.endswith("</w>") else raw.decode("latin-1")).encode()] = i
        for b in range(256):  # halves of two-byte characters: they never stay alone
            ranks.setdefault(bytes([b]), (1 << 16) + b)
        return tiktoken.Encoding("words", pat_str=_MARKED, mergeable_ranks=ranks, special_tokens={})

    def _library_ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)

    def _latin(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, ids per word) of Latin-1 words, all pieces in one call; None if
        an id does not end where its piece does."""
        pieces = _PIECE.findall("\n".join(words).lower() + "\n")
        last = self.last
        shown = ["" if p == "\n" else p[:-1] + last[p[-1]] if p.isascii() else marked(p.encode()) for p in pieces]
        ids = np.array(self.coder.encode_ordinary("".join(shown)), np.int64)
        breaks = np.fromiter((p == "\n" for p in pieces), bool, len(pieces))
        stops = np.r_[0, np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1]
        before = np.cumsum(~breaks)[breaks]  # pieces up to each word's end
        if len(before) != len(words) or len(stops) - 1 != len(pieces) - len(words) or ids.max(initial=0) >= len(self.ends):
            return None
        return ids.astype(np.uint16), np.diff(stops[before], prepend=0)

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts as unsigned 16-bit numbers (null: none)."""
        words, codes, ends = coded_words(texts)
        joined = "\n".join(words)
        held = [token for token in self.added if token in joined]
        simple = [w.isascii() or max(w) <= "\xff" for w in words]
        if held:
            simple = [s and not any(token in w for token in held) for w, s in zip(words, simple)]
        latin = [w for w, s in zip(words, simple) if s]
        done = self._latin(latin) if latin and self.coder is not None else None
        if done is None:
            done, simple = (np.zeros(0, np.uint16), np.zeros(0, np.int64)), [False] * len(words)
        others = [self._library_ids(w) for w, s in zip(words, simple) if not s]
        simple = np.array(simple, bool)
        place = np.empty(len(words), np.int64)
        place[simple], place[~simple] = np.arange(simple.sum()), simple.sum() + np.arange(len(others))
        lengths = np.r_[done[1], np.array(list(map(len, others)), np.int64)]
        codes = place[codes]
        ids = gather(np.concatenate([done[0], *others]), lengths, codes)
        stops = np.r_[0, np.cumsum(lengths[codes])][ends]
        return np.split(ids, stops[:-1])


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def signs(size: int = 1 << 16, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A sign per id and dimension, from a multiplicative hash of the id."""
    with np.errstate(over="ignore"):
        h = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.stack([((h >> np.uint64(40 + d)) & np.uint64(1)).astype(np.int8) * 2 - 1 for d in range(dimensions)], axis=1)


def cells(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Grid cells of points: each coordinate is squashed to (0, 1), then cut."""
    unit = 0.5 + 0.5 * points / (1.0 + np.abs(points))
    return np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def hilbert_index(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of grid cells (rows) by Gray-code rotation of the axes,
    from the highest bit down; neighbours on the curve are adjacent cells."""
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (np.int64(1) << level) - 1
        for d in range(n):
            turned = (x[d] >> level) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> level) & 1 == 1, (np.int64(1) << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            key = key << 1 | (x[d] >> level) & 1
    return key


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, bounded in rows and in the characters of column 2."""
    for part in slices(batch, TEXTS_AT_ONCE):
        slot = np.cumsum(pc.utf8_length(part.column(2)).fill_null(0).to_numpy(zero_copy_only=False)) // CHARS_AT_ONCE
        starts = np.flatnonzero(np.diff(slot, prepend=-1))
        for at, to in zip(starts.tolist(), [*starts[1:].tolist(), part.num_rows]):
            yield part.slice(at, to - at)


TOKENS = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, uid, key, n, ids): ids as little-endian unsigned 16-bit numbers
    ending in the end id, key the Hilbert index of the document's point."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, table = word_tokenizer(path), signs()
        for whole in batches:
            for batch in _parts(whole):
                counts, blobs, points = [], [], np.zeros((batch.num_rows, DIMENSIONS))
                for i, ids in enumerate(code.ids(batch.column(2))):
                    if len(ids):
                        points[i] = table.take(ids, axis=0).sum(axis=0, dtype=np.int64) / np.sqrt(len(ids))
                    counts.append(len(ids) + 1)
                    blobs.append(ids.tobytes() + _END)
                yield batch_of(TOKENS, batch.column(0), batch.column(1), hilbert_index(cells(points)), counts, blobs)
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("uid"), "text")
    return rows.mapInArrow(task, "doc_id long, uid long, key long, n long, ids binary")


PLACES = pa.schema([("uid", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each document within its range partition."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = total + np.cumsum(n)
        if len(n):
            total = int(ends[-1])
        yield batch_of(PLACES, batch.column(0), np.full(len(n), part, np.int32), ends - n, n)


def along_curve(tokens: DataFrame) -> DataFrame:
    """(uid, place): tokens before each document on the whole curve."""
    spark = tokens.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = (tokens.select("uid", "n", "key", "doc_id")
            .repartitionByRange(parts, "key", F.col("doc_id").asc_nulls_first(), "uid")
            .sortWithinPartitions("key", F.col("doc_id").asc_nulls_first(), "uid"))
    places = stored(line.select("uid", "n").mapInArrow(_running, "uid long, part int, before long, n long"), "places")
    totals = places.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range partition
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return places.join(F.broadcast(bases), "part").select("uid", (F.col("base") + F.col("before")).alias("place"))


def _cutter(length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, blob, place in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, done = np.frombuffer(blob, np.dtype("<u2")).astype("<u4"), 0
                while done < len(ids):
                    sequence, offset = divmod(place + done, length)
                    step = min(length - offset, len(ids) - done)
                    rows.append((doc_id, done, step, ids[done:done + step].tobytes(), len(ids), sequence, offset))
                    done += step
            yield batch_of(PIECES, *(zip(*rows) if rows else [[] for _ in PIECES]))
    return task


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset."""
    tokens = stored(tokenize(docs, path), "tokens")
    placed = tokens.select("doc_id", "uid", "ids").join(along_curve(tokens), "uid")
    return placed.select("doc_id", "ids", "place").mapInArrow(
        _cutter(length),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
