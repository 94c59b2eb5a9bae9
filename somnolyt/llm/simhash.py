"""SimHash near-dedup with a Gray-order hierarchical index.

A text's fingerprint takes, for each of 64 bits, the majority over the XXH64
of its word shingles.  Equal fingerprints are merged first, so copies count
once from there on.

Candidates: the 64 bits are cut into five blocks.  Fingerprints that differ in
three bits or fewer agree in two whole blocks at least, so each goes to ten
buckets, one for every pair of blocks and their bits.  A bucket that many
fingerprints share is cut again by the same argument: the other bits make four
more blocks, of which one must agree.

Index: a bucket's fingerprints are sorted by Gray rank, so neighbours share
bits.  Runs of FANOUT neighbours become a node that holds the bits they all
agree in (mask and pattern), and so on up to one root a bucket.  A query goes
down from the root; at each node it adds only the differences in bits that the
node fixes and its parent does not, and once the sum passes the limit the
whole group is dropped.  At a leaf the sum is the Hamming distance.

Buckets emit a spanning forest of their links, never all pairs, and the links
are joined into components by alternating stars (``components``).

Defined results: null and empty texts have fingerprint zero and are linked
like any other; component_id is the least doc_id that is not null (null if
there is none); repeated rows share a fingerprint; an empty table gives no
rows; the input row travels as one struct, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import stars
from .storage import stored

SHINGLE, LIMIT, SEED = 3, 3, 42
FANOUT = 8
#: Fingerprints of a bucket from which on it is cut again.
CROWDED = 4096
#: (query, node) pairs that are followed at a time.
FRONTIER = 2_000_000
#: (first bit, bits) of the five blocks.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
_SLAB = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text (0 without words)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z change
    n = len(words)
    if n == 0:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(b" ".join(words), SEED)
    hashes = (digest(b" ".join(words[i:i + shingle]), SEED) for i in range(n - shingle + 1))
    if shingle == 3:
        spaced = [w + b" " for w in words]
        hashes = (digest(a + b + c, SEED) for a, b, c in zip(spaced, spaced[1:], words[2:]))
    h = np.fromiter(hashes, np.uint64, n - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _SLAB):
        bits = np.unpackbits(h[at:at + _SLAB].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, columns: list[str], shingle: int = SHINGLE) -> DataFrame:
    """Written rows (row, uid, fp): the named columns, a row number and the
    fingerprint as a signed long."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                       F.monotonically_increasing_id().alias("uid"), "text")
    schema = T.StructType([rows.schema["row"], T.StructField("uid", T.LongType()), T.StructField("fp", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             names=["row", "uid", "fp"])
    return stored(rows.mapInArrow(task, schema), "fingerprints")


def _bits(fp: Column, first: int, count: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << count) - 1))


def gray_rank(fp: Column) -> Column:
    """Position of the bits in Gray-code order (prefix parity of the bits)."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp


def _pair_keys(fp: Column) -> Column:
    """Ten bucket keys: the pair of blocks, then their bits."""
    keys = []
    for number, (a, b) in enumerate(combinations(BLOCKS, 2)):
        bits = F.shiftleft(_bits(fp, *a), b[1]).bitwiseOR(_bits(fp, *b))
        keys.append(F.lit(number << 26).cast("long").bitwiseOR(bits))
    return F.array(*keys)


def _finer_keys(key: Column, fp: Column) -> Column:
    """Four keys within a crowded bucket: the bits outside its two blocks are
    cut into four blocks, one of which agrees for any link in the bucket."""
    cut = None
    for number, (a, b) in enumerate(combinations(BLOCKS, 2)):
        rest = [bit for first, count in BLOCKS if (first, count) not in (a, b) for bit in range(first, first + count)]
        parts = [rest[len(rest) * i // 4:len(rest) * (i + 1) // 4] for i in range(4)]
        masks = [sum(1 << bit for bit in part) for part in parts]
        signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        finer = F.array(*[F.xxhash64(key, F.lit(i), fp.bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])
        chosen = F.shiftrightunsigned(key, 26) == number
        cut = F.when(chosen, finer) if cut is None else cut.when(chosen, finer)
    return cut


def _levels(bucket: np.ndarray, fps: np.ndarray) -> list[dict[str, np.ndarray]]:
    """The index from its leaves up: per node mask, pattern, first and last
    leaf, first child and number of children; one root a bucket at the end."""
    n = len(fps)
    level = {"mask": np.full(n, ~np.uint64(0)), "pattern": fps, "bucket": bucket, "last": np.arange(n)}
    levels = [level]
    while len(level["bucket"]) > len(np.unique(bucket)):
        own = level["bucket"]
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        within = np.arange(len(own)) - np.repeat(begins, np.diff(np.r_[begins, len(own)]))
        first = np.flatnonzero(within % FANOUT == 0)
        count = np.diff(np.r_[first, len(own)])
        leader = np.repeat(level["pattern"][first], count)
        differ = np.bitwise_or.reduceat(level["pattern"] ^ leader, first)
        mask = np.bitwise_and.reduceat(level["mask"], first) & ~differ
        level = {"mask": mask, "pattern": level["pattern"][first] & mask, "bucket": own[first],
                 "last": level["last"][first + count - 1], "child": first, "children": count}
        levels.append(level)
    return levels


def _distance(q: np.ndarray, pattern: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.bitwise_count((q ^ pattern) & mask).astype(np.int8)


def search(bucket: np.ndarray, fps: np.ndarray, limit: int = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of fingerprints of one bucket within ``limit`` bits.
    Rows are sorted by bucket, then Gray rank."""
    levels = _levels(bucket, fps)
    top = levels[-1]
    root = np.searchsorted(top["bucket"], bucket)
    sizes = np.diff(np.r_[-1, top["last"]])[root]
    edges = np.r_[0, np.flatnonzero(np.diff(np.cumsum(sizes) // FRONTIER)) + 1, len(fps)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        query = np.arange(lo, hi)
        node = root[lo:hi]
        spent = _distance(fps[query], top["pattern"][node], top["mask"][node])
        for depth in range(len(levels) - 1, 0, -1):
            upper, lower = levels[depth], levels[depth - 1]
            keep = (spent <= limit) & (upper["last"][node] > query)
            query, node, spent = query[keep], node[keep], spent[keep]
            count = upper["children"][node]
            up = np.repeat(np.arange(len(node)), count)
            child = upper["child"][node][up] + np.arange(len(up)) - np.repeat(np.cumsum(count) - count, count)
            query, spent = query[up], spent[up]
            fixed = lower["mask"][child] & ~upper["mask"][node][up]
            spent = spent + _distance(fps[query], lower["pattern"][child], fixed)
            node = child
        keep = (spent <= limit) & (node > query)
        yield query[keep], node[keep]


def forest(bucket: np.ndarray, fps: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, root fp) that span each bucket's components."""
    label = np.arange(len(fps))
    for i, j in search(bucket, fps, limit):
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if np.array_equal(before, label):
                break
    while not np.array_equal(label, label[label]):
        label = label[label]
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _links_of(limit: int):
    def rows(bucket: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        alone = new & np.r_[new[1:], True]
        if alone.all():
            return None
        kept = np.cumsum(new)[~alone]
        u, v = forest(kept, fps[~alone].view(np.uint64), limit)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=LINKS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the bucket that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held and bucket[0] == held[-1][0][-1] and bucket[-1] == bucket[0]:
                held.append((bucket, fps))
                continue
            bucket = np.concatenate([*(h[0] for h in held), bucket])
            fps = np.concatenate([*(h[1] for h in held), fps])
            cut = int(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[-1])
            held = [(bucket[cut:], fps[cut:])]
            if cut and (out := rows(bucket[:cut], fps[:cut])) is not None:
                yield out
        if held and (out := rows(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))) is not None:
            yield out
    return task


def links(distinct: DataFrame, limit: int = LIMIT, crowded: int = CROWDED) -> DataFrame:
    """(u, v): links that span the components of distinct fingerprints (fp)."""
    if not 0 <= limit <= 3:
        raise ValueError("five blocks prove links of three bits or fewer")
    dealt = distinct.select("fp", F.explode(_pair_keys(F.col("fp"))).alias("key"))
    full = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded).select("key", "n")
    known = dealt.join(full, "key", "left")
    bucket = F.explode(F.when(F.col("n").isNull(), F.array(F.xxhash64("key")))
                       .otherwise(_finer_keys(F.col("key"), F.col("fp"))))
    dealt = known.select("fp", bucket.alias("bucket"), gray_rank(F.col("fp")).alias("gray"))
    placed = dealt.repartition("bucket").sortWithinPartitions("bucket", "gray")
    return placed.select("bucket", "fp").mapInArrow(_links_of(limit), "u long, v long")


def components(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of (row.doc_id, fp)."""
    named = stored(rows.groupBy("fp").agg(F.min("row.doc_id").alias("doc_id")), "distinct")
    star = stars(links(named, limit))
    rooted = named.join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = fingerprints(docs, ["doc_id"], shingle)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(components(rows, limit), "fp").select(
        F.col("row.doc_id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """One row of each component stays: the least doc_id (nulls last), then the
    first row.  The input's columns are returned."""
    rows = fingerprints(docs, docs.columns, shingle)
    named = stored(rows.groupBy("fp").agg(F.min(_order()).alias("first")), "distinct")
    star = stars(links(named.select("fp"), limit))
    rooted = named.join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "first", F.coalesce("root", "fp").alias("root"))
    stays = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.uid").alias("uid"))
    return rows.join(stays, "uid", "left_semi").select("row.*")


def _order() -> Column:
    doc_id = F.col("row.doc_id")
    return F.struct(doc_id.isNull().alias("nameless"), doc_id.alias("doc_id"), F.col("uid"))
