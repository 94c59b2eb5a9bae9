"""Phrase collocations counted in HAT-tries.

A phrase is a run of words within a piece of text.  Every word's window, the
longest run of up to ``longest`` words that starts there, goes into a trie once;
the count of a phrase is the sum below its node.

* A task's trie is shallow: under the language and a range of first word ids
  stands a hash container of windows.  A container that grows past ``BURST``
  bursts into one per first word, or per second word of longer windows.
* When the trie holds ``LIMIT`` windows, whole subtrees are spilled, the largest
  first, until half is left: their phrases' sums leave as one sorted run.
* Runs are merged per prefix: every phrase is a prefix of windows, a run holds
  it at most once, and the sums of a phrase meet in the partition that its hash
  names.  Partitions by first word alone would follow its skew.

Counting goes twice over the texts.  The first pass counts words and pairs.
Only a run of frequent pairs can be a frequent longer phrase, so the second pass
counts longer windows where all pairs pass a sieve of the frequent ones: a Bloom
filter of at most ``SIEVE_BITS`` bits, the only thing broadcast.  What passes it
wrongly is counted too and falls to its own count, so results are exact whatever
the size of the filter.

Defined results: null texts count as empty, a null language as ``und``; repeated
rows count as often as they occur; ties in score and count go by the phrase's
bytes; an empty table gives an empty result; only lang and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter as Tally
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .textkit import batch_of

#: Least count, share that absorbs a phrase (in percent), scale of scores, longest phrase, rows a language.
LEAST, ABSORBED, SCORE_SCALE, LONGEST, TOP = 30, 80, 2_000_000, 4, 2000
#: Windows in a trie; windows in a container before it bursts; words with an id; characters at a time.
LIMIT, BURST, VOCABULARY, CHARS_AT_ONCE = 1_000_000, 20_000, 400_000, 4_000_000
#: Bits of the sieve a frequent pair, and at most.
BITS_A_PAIR, SIEVE_BITS = 16, 1 << 27
#: Bits of a word id in a container's key.
_ID = 21
_BREAK = b"\xff"  # no byte of UTF-8

_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 0xFF
_TABLE = bytes(_TABLE)


def tokens_of(texts: list[str]) -> list[bytes]:
    """Lower-cased words of all texts in order, with a break between pieces."""
    return "\n".join(texts).encode().translate(_TABLE).replace(_BREAK, b" \xff ").split()


class HatTrie:
    """Counts of windows.  The root leads from a range of first ids to a hash
    container, which counts the packed ids of its windows.  A container that
    grows past ``burst`` becomes a node that leads from the next id (the first
    one, if the range holds several) to containers."""

    def __init__(self, longest: int, burst: int = BURST):
        self.burst, self.size = burst, 0
        self.below = _ID * (longest - 1)  # bits of a window after its first id
        self.range = min(6, 63 - self.below)  # bits of a first id inside a container
        self.shift = self.below if self.range else self.below - _ID
        self.containers: dict[int, Tally] = {}
        self.nodes: dict[int, dict[int, Tally]] = {}

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        """Count windows, container by container."""
        if self.range:
            key = np.sort(first << self.below | rest)
            first, rest = key >> self.below, key & (1 << self.below) - 1
        else:
            order = np.lexsort((rest, first))
            first, rest = first[order], rest[order]
        place, key = first >> self.range, (first & (1 << self.range) - 1) << self.below | rest
        keys = key.tolist()
        for head, at, to in _parts(place):
            node = self.nodes.get(head)
            if node is not None:
                self._route(node, key[at:to])
                continue
            container = self.containers.get(head)
            if container is None:
                container = self.containers[head] = Tally()
            before = len(container)
            container.update(keys[at:to])
            self.size += len(container) - before
            if len(container) > self.burst:
                node = self.nodes[head] = {}
                for k, n in self.containers.pop(head).items():
                    node.setdefault(k >> self.shift, Tally())[k] = n

    def _route(self, node: dict[int, Tally], key: np.ndarray) -> None:
        keys = key.tolist()
        for child, at, to in _parts(key >> self.shift):
            container = node.get(child)
            if container is None:
                container = node[child] = Tally()
            before = len(container)
            container.update(keys[at:to])
            self.size += len(container) - before

    def take(self, left: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Remove whole subtrees, the largest first, until at most ``left``
        windows stay: (first id, packed remainder, count) of what went."""
        subtrees = [(len(c), self.containers, head) for head, c in self.containers.items()]
        subtrees += [(sum(map(len, node.values())), self.nodes, head) for head, node in self.nodes.items()]
        subtrees.sort(key=lambda s: -s[0])
        heads, sizes, keys, counts = [], [], [], []
        for size, level, head in subtrees:
            if self.size <= left:
                break
            gone = level.pop(head)
            for container in gone.values() if level is self.nodes else (gone,):
                keys += container.keys()
                counts += container.values()
            heads.append(head)
            sizes.append(size)
            self.size -= size
        place, key = np.repeat(np.array(heads, np.int64), sizes), np.array(keys, np.int64)
        return place << self.range | key >> self.below, key & (1 << self.below) - 1, np.array(counts, np.int64)


def _parts(sorted_keys: np.ndarray):
    """(key, start, end) of each run of equal keys."""
    starts = np.flatnonzero(np.r_[len(sorted_keys) > 0, sorted_keys[1:] != sorted_keys[:-1]])
    return zip(sorted_keys[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_keys)])


def mixed(left: np.ndarray, right: np.ndarray, lang: int) -> np.ndarray:
    """A 64-bit hash of a language and two words' hashes."""
    with np.errstate(over="ignore"):
        h = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(lang)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each hash in a filter of a power of two of bits."""
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(32) & mask).astype(np.int64)


def holds(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a filter (32-bit words) may hold each hash."""
    a, b = probes(h, 32 * len(words))
    return (words[a >> 5] >> (a & 31).astype(np.uint32) & words[b >> 5] >> (b & 31).astype(np.uint32) & 1).astype(bool)


class Counter:
    """One task's tries, one a language, over one set of word ids."""

    def __init__(self, lengths: tuple[int, ...], sieve: np.ndarray | None):
        self.lengths, self.longest, self.sieve = lengths, max(lengths), sieve
        self._renew()

    def _renew(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.hashes: list[int] = []
        self.tries: dict[str, HatTrie] = {}
        self.totals: dict[str, int] = {}

    def _codes(self, tokens: list[bytes]) -> np.ndarray:
        """Ids of the tokens, from 1; breaks are 0."""
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        found, ids = [], self.ids
        for word in coded.dictionary.to_pylist():
            if word == _BREAK:
                found.append(0)
                continue
            i = ids.get(word)
            if i is None:
                i = ids[word] = len(ids) + 1
                if self.sieve is not None:
                    self.hashes.append(xxhash.xxh64_intdigest(word))
            found.append(i)
        return np.array(found, np.int64)[coded.indices.to_numpy()] if tokens else np.zeros(0, np.int64)

    def add(self, lang: str, texts: list[str]) -> Iterator[pa.RecordBatch]:
        """Count the windows of some texts; yields the runs that this spills."""
        code = np.r_[self._codes(tokens_of(texts)), np.zeros(self.longest, np.int64)]
        trie = self.tries.setdefault(lang, HatTrie(self.longest))
        n = len(code) - self.longest
        self.totals[lang] = self.totals.get(lang, 0) + int(np.count_nonzero(code))
        inside = code[:-1] > 0
        linked = inside & (code[1:] > 0)
        if self.sieve is not None:
            at = np.flatnonzero(linked)
            hashes = np.array([0, *self.hashes], np.uint64)
            linked[at] = holds(self.sieve, mixed(hashes[code[at]], hashes[code[at + 1]], xxhash.xxh64_intdigest(lang)))
        whole, rest = inside[:n].copy(), np.zeros(n, np.int64)
        start = np.ones(n, bool)
        for k in range(1, self.longest):
            whole &= linked[k - 1:k - 1 + n]
            rest = rest << _ID | np.where(whole, code[k:k + n], 0)
            if k < min(self.lengths):
                start &= whole
        at = np.flatnonzero(start & (code[:n] > 0))
        trie.add(code[at], rest[at])
        while sum(t.size for t in self.tries.values()) > LIMIT:
            fullest = max(self.tries, key=lambda x: self.tries[x].size)
            yield self._run(fullest, self.tries[fullest].size // 2)
        if len(self.ids) > VOCABULARY:
            yield from self.finish()

    def _run(self, lang: str, left: int) -> pa.RecordBatch:
        """Sums of all phrases below the subtrees that are taken, sorted."""
        first, rest, counts = self.tries[lang].take(left)
        words = [b"", *self.ids]
        columns = [first] + [rest >> _ID * (self.longest - 1 - k) & (1 << _ID) - 1 for k in range(1, self.longest)]
        used = np.unique(np.concatenate(columns))
        names = sorted(words[i] for i in used.tolist())  # '' stands for no word and is first
        rank = np.zeros(len(words), np.int64)
        rank[[0 if not name else self.ids[name] for name in names]] = np.arange(len(names))
        names = pa.array(names, pa.binary()).cast(pa.string())
        absent = 0 if len(used) and used[0] == 0 else -1
        columns = [rank[c] if absent == 0 else np.where(c > 0, rank[c], -1) for c in columns]
        order = np.lexsort(columns[::-1])
        columns, counts = [c[order] for c in columns], counts[order]
        phrases, sums = [], []
        for length in self.lengths:
            there = np.flatnonzero(columns[length - 1] != absent)
            part = [c[there] for c in columns[:length]]
            new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in part], axis=0)]) if len(there) else there
            if len(new):
                sums.append(np.add.reduceat(counts[there], new))
                phrases.append(pc.binary_join_element_wise(*(names.take(pa.array(c[new])) for c in part), " "))
        phrases = pa.concat_arrays(phrases) if phrases else pa.array([], pa.string())
        return batch_of(RUNS, pa.array([lang] * len(phrases), pa.string()), phrases, np.concatenate(sums) if sums else [])

    def finish(self) -> Iterator[pa.RecordBatch]:
        """All that is left, and each language's words under the empty phrase."""
        for lang in self.tries:
            yield self._run(lang, 0)
        yield batch_of(RUNS, list(self.totals), [""] * len(self.totals), list(self.totals.values()))
        self._renew()


RUNS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def text_groups(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """(language, texts) of some rows at a time, bounded in characters."""
    by_lang: dict[str, list] = {}
    held = 0
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        by_lang.setdefault(lang, []).append(text)
        held += len(text)
        if held >= CHARS_AT_ONCE:
            yield from by_lang.items()
            by_lang, held = {}, 0
    yield from by_lang.items()


def phrase_counts(docs: DataFrame, lengths: tuple[int, ...], least: int = LEAST, sieve=None) -> DataFrame:
    """(lang, phrase, f) of phrases of the given lengths with f >= least, and
    the words of each language under the empty phrase.  ``sieve`` is a broadcast
    filter that all pairs of counted windows pass."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(lengths, None if sieve is None else sieve.value)
        for batch in batches:
            for lang, texts in text_groups(batch):
                yield from counter.add(lang, texts)
        yield from counter.finish()
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    runs = rows.mapInArrow(task, "lang string, phrase string, f long").repartition("lang", "phrase")
    return runs.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def sieve_of(pairs: DataFrame):
    """Broadcast filter of the pairs (lang, phrase): a collected bitmap whose
    size is bounded, whatever the pairs."""
    bits = 1 << 16
    while bits < min(BITS_A_PAIR * pairs.count(), SIEVE_BITS):
        bits *= 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [[xxhash.xxh64_intdigest(w) for w in phrase.encode().split(b" ")] for phrase in batch.column(1).to_pylist()]
            left, right = (np.array([h[i] for h in hashes], np.uint64) for i in (0, 1))
            langs = np.array([xxhash.xxh64_intdigest(x) for x in batch.column(0).to_pylist()], np.uint64)
            at = np.concatenate(probes(mixed(left, right, langs), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 5).astype(np.int32)), pa.array(np.int64(1) << (at & 31))], ["place", "bits"])
    found = pairs.select("lang", "phrase").mapInArrow(task, "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 32, np.uint32)
    words[found["place"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return pairs.sparkSession.sparkContext.broadcast(words)


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, f, size): phrases of up to four words with f >= least;
    size 0 is a language's words."""
    def sized(df: DataFrame) -> DataFrame:
        return df.select("lang", "phrase", "f", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("size"))
    short = stored(sized(phrase_counts(docs, (1, 2), least)), "phrases-short")
    sieve = sieve_of(short.filter("size = 2"))
    long = stored(sized(phrase_counts(docs, (3, LONGEST), least, sieve)).filter("size > 0"), "phrases-long")
    return short.unionByName(long)


def _part(start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice("words", start, length), " ")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """First ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    phrases = stored(frequent_phrases(docs), "phrases")
    counts = phrases.filter("size > 0").select("lang", "phrase", "f")
    found = phrases.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("words"))

    # every cut of a phrase in two; the lowest score counts, then the first cut
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    halves = stored(cuts.join(side("left", "l"), ["lang", "left"]), "phrase-cuts").join(side("right", "r"), ["lang", "right"])
    exact = F.expr(f"cast(a as decimal(20, 0)) * {SCORE_SCALE} div (cast(l as decimal(20, 0)) + r)")
    scored = halves.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # phrases that a longer one nearly always covers
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: _part(s, m))))
    covers = found.filter("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
    covers = covers.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = scored.join(covers, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < ABSORBED * F.col("a")))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order).cast("long"))
    words = phrases.filter("size = 0").select("lang", F.col("f").alias("n"))
    return first.filter(F.col("rank") <= top).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
