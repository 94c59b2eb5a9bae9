"""Language ID by segmentation-marginalised unigrams.

A word, with the space before it, has in each language the sum over all its
segmentations into pieces of a fixed public vocabulary, every piece of the file
included, each piece weighted by that language's unigram probability; the
forward algorithm sums them in one sweep over the word's bytes.  A text's
log-probability is the sum over its words, and the score is the predicted
language's posterior under equal priors.

Piece probabilities are fitted by expectation-maximisation over all
segmentations (forward and backward sums) on a bounded sample of whole texts of
each language, one task a language; the resulting table has at most one row a
piece and language.  Scoring is one pass over all whole texts without a shuffle.

Words are maximal runs of letters in lower case (no digit, no underscore), of
any length.  Words of one byte length are summed together in numpy; a word so
long that its probability could fall below the smallest float is summed alone,
in a window of the longest piece that is rescaled as it rolls.  Both are the
same sum.  Distinct words are worked out once per worker (a memo of bounded
size; very long words stay out of it).

Defined results: null texts and texts without a letter get ``und`` and score
0; so does every text when there was nothing to learn from; ties go to the
language first in order; rows are judged one by one, so repeated rows and null
ids keep their own result; only doc_id, text and lang are read.
"""

from __future__ import annotations

import base64
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import TwoGenerationCache, batch_of, id_bucket

#: Documented bounds of the sample of a language: texts, and code points after
#: which no further text is taken (texts are taken whole, whatever their length).
TEXTS_A_LANGUAGE, SAMPLE_CHARS = 150, 2_000_000
#: EM rounds.
ROUNDS = 3
#: Probability that is left to a piece never seen in a language.
UNSEEN = 1e-7
#: Words in the memo, and the longest word (code points) that enters it.
MEMO_ENTRIES, MEMO_WORD = 300_000, 64
_WORD = re.compile(r"[^\W\d_]+")
#: In the trie: a start of pieces that is no piece itself.
_NO_PIECE = -1


class Vocabulary:
    """Pieces (bytes) of a public rank file and all their starts."""

    def __init__(self, pieces: dict[bytes, int]):
        self.size, self.longest = len(pieces), max(map(len, pieces), default=0)
        self.trie = {p[:k]: _NO_PIECE for p in pieces for k in range(1, len(p))}
        self.trie.update(pieces)

    def edges(self, word: bytes) -> list[tuple[int, int, int]]:
        """(start, end, piece) of every piece that occurs in the word."""
        find, n, out = self.trie.get, len(word), []
        for i in range(n):
            for j in range(i + 1, n + 1):
                piece = find(word[i:j])
                if piece is None:
                    break
                if piece >= 0:
                    out.append((i, j, piece))
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """All pieces of the public rank file; every single byte is one."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(line.split()[0]): i for i, line in enumerate(lines)})


def words_of(text: str | None) -> list[str]:
    """Lower-case letter runs of a text; none if it has no letter."""
    words = _WORD.findall(text.lower()) if text else []
    if words and not any(w.isalpha() for w in words) and not any(c.isalpha() for w in words for c in w):
        return []
    return words


def spelled(word: str) -> bytes:
    """A word as it stands in running text: a space, then its UTF-8."""
    return b" " + word.encode("utf-8", "surrogatepass")


def safe_length(least: float) -> int:
    """Bytes up to which products of a byte's least probability stay floats."""
    return int(-280 / np.log10(least))


class Lattice:
    """The pieces of several words of one byte length, by (end, size)."""

    def __init__(self, words: list[bytes], vocab: Vocabulary):
        self.words, self.n = len(words), len(words[0])
        find, n, stride = vocab.trie.get, self.n, self.n + 1
        flat, sizes = [], []
        for word in words:
            before = len(flat)
            for i in range(n):
                for j in range(i + 1, stride):
                    piece = find(word[i:j])
                    if piece is None:
                        break
                    if piece >= 0:
                        flat.append((j * stride + i) * vocab.size + piece)
            sizes.append(len(flat) - before)
        step, piece = np.divmod(np.array(flat, np.int64), vocab.size)
        rows = np.repeat(np.arange(self.words), sizes)
        order = np.argsort(step.astype(np.int32), kind="stable")
        step, piece, rows = step[order], piece[order], rows[order]
        cuts = np.nonzero(np.diff(step))[0] + 1
        #: (start, end, words, pieces): each word at most once a step, ends ascending.
        self.steps = [(int(at[0] % stride), int(at[0] // stride), w, ids) for at, w, ids in zip(
            *(np.split(x, cuts) for x in (step, rows, piece)))] if flat else []

    def forward(self, table: np.ndarray) -> np.ndarray:
        """alpha (words, n + 1, languages): the summed probability of all
        segmentations of each prefix."""
        alpha = np.zeros((self.words, self.n + 1, table.shape[1]))
        alpha[:, 0] = 1
        for i, j, rows, pieces in self.steps:
            alpha[rows, j] += alpha[rows, i] * table[pieces]
        return alpha

    def backward(self, table: np.ndarray) -> np.ndarray:
        """beta (words, n + 1, languages): the same of each suffix."""
        beta = np.zeros((self.words, self.n + 1, table.shape[1]))
        beta[:, self.n] = 1
        for i, j, rows, pieces in sorted(self.steps, key=lambda step: -step[0]):
            beta[rows, i] += beta[rows, j] * table[pieces]
        return beta


def rolling_log(word: bytes, vocab: Vocabulary, table: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of a word of any
    length, in every language.  Only the last ``longest`` prefixes are held;
    a language is rescaled whenever its newest sum gets small.

    A piece is at most ``longest`` bytes and every byte is a piece, so what the
    window holds stays within the range of floats."""
    find, n, reach = vocab.trie.get, len(word), vocab.longest
    ring = np.zeros((reach + 1, table.shape[1]))
    ring[0] = 1
    logs = np.zeros(table.shape[1])
    for i in range(n):
        here = ring[i % (reach + 1)].copy()
        ring[i % (reach + 1)] = 0
        small = here < 1e-60
        if small.any():
            factor = np.where(small, here, 1.0)
            logs += np.log(factor)
            here /= factor
            ring /= factor
        for j in range(i + 1, min(n, i + reach) + 1):
            piece = find(word[i:j])
            if piece is None:
                break
            if piece >= 0:
                ring[j % (reach + 1)] += here * table[piece]
    return logs + np.log(ring[n % (reach + 1)])


def expect_long(word: bytes, weight: float, vocab: Vocabulary, p: np.ndarray, expected: np.ndarray) -> None:
    """Add a long word's expected piece counts, summed in logarithms."""
    steps, n = vocab.edges(word), len(word)
    cost = np.log(p[[piece for _, _, piece in steps]])
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0
    for at, (i, j, _) in enumerate(steps):  # starts ascend, so alpha[i] is whole here
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + cost[at])
    for at in range(len(steps) - 1, -1, -1):
        i, j, _ = steps[at]
        beta[i] = np.logaddexp(beta[i], beta[j] + cost[at])
    for at, (i, j, piece) in enumerate(steps):
        expected[piece] += weight * np.exp(alpha[i] + cost[at] + beta[j] - alpha[n])


def fit_pieces(texts: list[str], vocab: Vocabulary) -> np.ndarray:
    """Unigram probabilities of the pieces for one language's texts."""
    counts = Counter(spelled(word) for text in texts for word in words_of(text))
    n_bytes = sum(len(word) * n for word, n in counts.items())
    safe = safe_length(min(1 / vocab.size, UNSEEN / (n_bytes + 1)))
    by_length, long = defaultdict(list), []
    for word in sorted(counts):
        long.append(word) if len(word) > safe else by_length[len(word)].append(word)
    dense = [(Lattice(words, vocab), np.array([counts[w] for w in words], float)) for words in by_length.values()]
    p = np.full(vocab.size, 1 / vocab.size)
    for _ in range(ROUNDS):
        expected = np.zeros(vocab.size)
        for lattice, weight in dense:
            alpha, beta = lattice.forward(p[:, None])[:, :, 0], lattice.backward(p[:, None])[:, :, 0]
            scale = weight / alpha[:, -1]
            for i, j, rows, pieces in lattice.steps:
                np.add.at(expected, pieces, scale[rows] * alpha[rows, i] * p[pieces] * beta[rows, j])
        for word in long:
            expect_long(word, counts[word], vocab, p, expected)
        p = (expected + UNSEEN) / (expected.sum() + UNSEEN * vocab.size)
    return p


def learn(docs: DataFrame, path: str, modulus: int, held: int,
          texts_a_language: int = TEXTS_A_LANGUAGE) -> dict[str, dict[int, float]]:
    """{lang: {piece: probability}} from training rows with a lang."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (id_bucket("doc_id", modulus) != held))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    drawn = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= texts_a_language)
    before = Window.partitionBy("lang").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    sample = (drawn.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
              .filter(F.col("before") < SAMPLE_CHARS).select("lang", "text"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        p = fit_pieces(list(group["text"]), vocabulary(path))
        used = np.nonzero(p > 2 * UNSEEN)[0]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "piece": used.astype(np.int32), "p": p[used]})

    out: dict[str, dict[int, float]] = {}
    for row in sample.groupBy("lang").applyInPandas(fit, "lang string, piece int, p double").collect():
        out.setdefault(row.lang, {})[row.piece] = row.p
    return out


class Scorer:
    """Scores texts against the learned languages."""

    def __init__(self, path: str, langs: list[str], learned: dict[str, dict[int, float]]):
        self.vocab, self.langs = vocabulary(path), langs
        self.table = np.full((self.vocab.size, len(langs)), UNSEEN)
        for column, lang in enumerate(langs):
            for piece, p in learned[lang].items():
                self.table[piece, column] = p
        self.safe = safe_length(UNSEEN)
        self.memo = TwoGenerationCache(lambda word: self._logs([word])[word], MEMO_ENTRIES)

    def _logs(self, words: Iterable[str]) -> dict[str, tuple[float, ...]]:
        """Log-probability of each distinct word in every language."""
        out, by_length = {}, defaultdict(list)
        for word in words:
            raw = spelled(word)
            if len(raw) > self.safe:
                out[word] = tuple(rolling_log(raw, self.vocab, self.table))
            else:
                by_length[len(raw)].append((word, raw))
        for pairs in by_length.values():
            sums = Lattice([raw for _, raw in pairs], self.vocab).forward(self.table)[:, -1]
            out.update(zip((word for word, _ in pairs), map(tuple, np.log(sums))))
        return out

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(lang_pred, score) of each text; new words are summed together."""
        out, listed, apart = [], [], []
        for text in texts:
            words = words_of(text)
            long = [w for w in words if len(w) > MEMO_WORD]
            apart.append(self._logs(dict.fromkeys(long)) if long and self.langs else {})
            listed.append((words, long))
        young, old = self.memo.young, self.memo.old
        fresh = {w for words, _ in listed for w in words if w not in young and w not in old and len(w) <= MEMO_WORD}
        found = self._logs(fresh) if fresh and self.langs else {}
        self.memo.make = lambda word: found[word] if word in found else self._logs([word])[word]
        for (words, long), slow in zip(listed, apart):
            if not words or not self.langs:
                out.append(("und", 0.0))
                continue
            short = [w for w in words if len(w) <= MEMO_WORD] if long else words
            parts = self.memo.many(short) + [slow[w] for w in long]
            logs = np.fromiter(chain.from_iterable(parts), float).reshape(len(words), -1).sum(axis=0)
            best = int(logs.argmax())
            out.append((self.langs[best], float(1 / np.exp(logs - logs[best]).sum())))
        return out


PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
#: Texts that are scored together (bounds what is held besides the memo).
TEXTS_AT_ONCE = 200


def identify(docs: DataFrame, learned: dict[str, dict[int, float]], path: str) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    langs = sorted(learned)
    model = docs.sparkSession.sparkContext.broadcast(learned)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(path, langs, model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                pairs = scorer.score(part.column(1).to_pylist())
                yield batch_of(PREDICTED, part.column(0), [p[0] for p in pairs], [p[1] for p in pairs])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        task, "doc_id long, lang_pred string, score double")
