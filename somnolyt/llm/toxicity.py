"""Toxicity by maximum-scoring segments.

Tokens and their stems (prefixes) get log-odds of toxic against clean texts
with an informative Dirichlet prior (their overall shares); a text counts a
token once, so repetition cannot feign evidence.  Only log-odds that stand out
of their own error count; a token without any of its own takes those of its
longest stem that has some.  Every other token costs a small drift, so the
expected score of clean text is below zero.  One linear scan finds every maximal scoring
segment of a text.  The best segment of clean texts follows an extreme-value
law whose location grows with the logarithm of the length; fitted on the clean
texts of the sample that have a segment it turns segment scores into p-values.  Under that
law the segments of clean text that reach a score are a Poisson number, which
tells the chance of r segments as good as the r best; the r that stands out
most is the text's evidence, so many middling passages count as well as one
strong one, and a logistic unit over it, fitted on both kinds of texts, gives
the text's probability.

The model is fitted on a bounded sample of labelled rows (``sampling``);
scoring is one pass over all whole texts without a shuffle.

Defined results: null and empty texts have no segment and get the probability
of no evidence; rows are scored one by one, so repeated rows and null ids keep
their own score; with labels of one kind only the lexicon is empty and every
score is that kind's share (0 without labels); only the id and text columns
are read, so others cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import TwoGenerationCache, batch_of, id_bucket

#: Documented bound of the training sample.
TRAINING_ROWS = 6000
#: Weight of the prior as a share of the sample's tokens; z-value that a
#: token's log-odds must reach; cost of every other token; segments reported.
PRIOR, SIGNIFICANT, DRIFT, P_VALUE = 0.1, 3.0, 0.02, 0.01
#: Lengths in bytes of a token's stems; shortest text and least scale of the
#: extreme-value law.
STEMS, LEAST_TOKENS, LEAST_SCALE = range(4, 13), 32, 0.25
MEMO_ENTRIES = 300_000
#: Bytes to token bytes: ASCII lower case, ASCII punctuation parts tokens.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def tokens_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def features(tokens: list[bytes]) -> set[bytes]:
    """Distinct tokens and stems of a text; a stem ends in an asterisk."""
    words = set(tokens)
    return words | {w[:k] + b"*" for w in words for k in STEMS if k < len(w)}


def log_odds(toxic: Counter, clean: Counter) -> dict[bytes, float]:
    """Significant log-odds ratios under a Dirichlet prior of overall shares."""
    n_t, n_c = sum(toxic.values()), sum(clean.values())
    a_0 = max(1.0, PRIOR * (n_t + n_c))
    out = {}
    for token in toxic.keys() | clean.keys():
        t, c = toxic[token], clean[token]
        a = a_0 * (t + c) / (n_t + n_c)
        delta = (np.log((t + a) / (n_t + a_0 - t - a)) - np.log((c + a) / (n_c + a_0 - c - a)))
        if abs(delta) / np.sqrt(1 / (t + a) + 1 / (c + a)) >= SIGNIFICANT:
            out[token] = float(delta)
    return out


def maximal_segments(scores: list[float], at: list[int], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), by one
    scan over the tokens that have a score; the tokens between cost drift.

    Kept candidates hold the running sum before (left) and after (right) them
    and the place of the nearest earlier candidate with a lower left sum; a new
    one joins that candidate if it reaches a higher right sum, and is tried
    again with what they cover.  Where no earlier candidate has a lower left
    sum, none can be joined any more, so all of them are final.  A candidate
    that a search passes by is never met again, so the scan is linear."""
    done: list[tuple[int, int, float]] = []
    kept: list[list] = []  # [first, last, left, right, place of the nearest with a lower left sum]
    total, before = 0.0, -1
    for position, score in zip(at, scores):
        total -= drift * (position - before - 1)
        before = position
        left, total = total, total + score
        if score <= 0:
            continue
        first, right, j = position, total, len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                break
            first, left, below = kept[j][0], kept[j][2], kept[j][4]
            del kept[j:]
            j = below
        if j < 0:
            done.extend((a, b, r - l) for a, b, l, r, _ in kept)
            kept = []
        kept.append([first, position, left, right, j])
    return done + [(a, b, r - l) for a, b, l, r, _ in kept]


@dataclass
class Model:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    location: float = 0.0
    scale: float = 1.0
    slope: float = 0.0
    intercept: float = -40.0

    def __post_init__(self) -> None:
        self.memo = TwoGenerationCache(self._score, MEMO_ENTRIES)

    def _score(self, token: bytes) -> float:
        """A token's log-odds, else those of its longest stem, else 0."""
        if token in self.lexicon:
            return self.lexicon[token]
        for k in reversed(STEMS):
            if k < len(token) and token[:k] + b"*" in self.lexicon:
                return self.lexicon[token[:k] + b"*"]
        return 0.0

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(tokens, maximal segments) of a whole text."""
        tokens = tokens_of(text)
        found = np.array(self.memo.many(tokens), float)
        at = np.nonzero(found)[0]
        return len(tokens), maximal_segments(found[at].tolist(), at.tolist(), DRIFT)

    def evidence(self, n: int, score: float) -> float:
        """-log of the chance that clean text of n tokens has such a segment."""
        z = (score - self.location) / self.scale - np.log(max(n, LEAST_TOKENS))
        expected = np.exp(-min(z, 700.0))  # of segments that good
        return float(z if expected < 1e-12 else -np.log(-np.expm1(-min(expected, 700.0)) + 1e-300))

    def total_evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        """The greatest evidence of the r best segments together, over all r.

        Clean text has a Poisson number of segments as good as the r-th best;
        its chance to be r or more is at most the term of r over 1 - expected /
        (r + 1).  The r-th try costs log(r (r + 1)), as many r are tried."""
        if not segments:
            return 0.0
        scores = np.sort(np.array([s for _, _, s in segments]))[::-1]
        r = np.arange(1.0, len(scores) + 1)
        z = (scores - self.location) / self.scale - np.log(max(n, LEAST_TOKENS))
        expected = np.exp(-np.clip(z, -700.0, 700.0))
        short = expected < r  # of what was found
        share = np.where(short, expected / (r + 1), 0.0)
        found = expected + r * z + np.cumsum(np.log(r)) + np.log1p(-share) - np.log(r * (r + 1))
        found[0] = self.evidence(n, scores[0]) - np.log(2.0)
        return max(0.0, float(np.max(found, where=short, initial=0.0)))

    def probability(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        z = self.intercept + self.slope * self.total_evidence(n, segments)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _extreme_value(maxima: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """Gumbel location (for one token) and scale by moments: a maximum over n
    tokens lies scale * log(n) higher than one over a single token."""
    scale, logs = 1.0, np.log(np.maximum(lengths, LEAST_TOKENS))
    if len(maxima) < 2:  # clean texts have no segments, so any segment stands out
        return 0.0, LEAST_SCALE
    for _ in range(20):
        scale = max(LEAST_SCALE, float(np.std(maxima - scale * logs)) * np.sqrt(6) / np.pi)
    return float(np.mean(maxima - scale * logs)) - 0.5772156649015329 * scale, scale


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge."""
    design, w = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2),
                               design.T @ (p - y) + 1e-2 * w)
        w -= np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def train(sample: list[tuple[str, int]]) -> Model:
    """Fit lexicon, extreme-value law and probability on labelled texts."""
    y = np.array([label for _, label in sample], float)
    if len(y) == 0 or y.min() == y.max():
        return Model(intercept=40.0 if len(y) and y[0] == 1 else -40.0)
    counts = Counter(), Counter()
    for text, label in sample:
        counts[label].update(features(tokens_of(text)))
    model = Model(lexicon=log_odds(counts[1], counts[0]))
    scanned = [model.segments(text) for text, _ in sample]
    best = np.array([max((s for _, _, s in segments), default=0.0) for _, segments in scanned])
    lengths = np.array([n for n, _ in scanned], float)
    model.location, model.scale = _extreme_value(best[(y == 0) & (best > 0)], lengths[(y == 0) & (best > 0)])
    x = np.array([model.total_evidence(n, segments) for n, segments in scanned])
    model.slope, model.intercept = _logistic(np.minimum(x, 50.0) / 10, y)
    model.slope /= 10
    return model


SCORES = pa.schema([
    ("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.list_(pa.struct([
        ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())])))])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages): passages are the maximal segments of
    p-value P_VALUE or less, as token positions."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(1):
                n, segments = model.segments(text.as_py())
                scores.append(model.probability(n, segments))
                passages.append([{"first": a, "last": b, "score": s, "p_value": p} for a, b, s in segments
                                 if (p := float(np.exp(-max(0.0, model.evidence(n, s))))) <= P_VALUE])
            yield batch_of(SCORES, batch.column(0), scores, passages)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        task, "doc_id long, score double, "
              "passages array<struct<first:long,last:long,score:double,p_value:double>>")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of probability under one half, with all their columns."""
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [model.probability(*model.segments(text.as_py())) < 0.5 for text in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))
    return docs.mapInArrow(task, docs.schema)


def verdicts(scores: DataFrame, modulus: int, held: int) -> DataFrame:
    """Adds held_out, predicted and the number of passages."""
    return scores.select("doc_id", (id_bucket("doc_id", modulus) == held).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("passages").cast("long").alias("n_passages"))
