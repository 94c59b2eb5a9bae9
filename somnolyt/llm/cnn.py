"""Quality classifier: a byte-level convolutional network in numpy.

Input channels are the bytes of the whole text and one flag a byte block that
says whether the block repeats the bytes some lag before it.  Learned filters
of WIDTH bytes run over the text in steps of STEP; chunks of two cells
overlap by a cell and cover the whole text; each filter is max-pooled within a
chunk, and the chunks' maxima and means are combined by a logistic unit into
one probability.

Training is mini-batch gradient descent on a bounded sample of labelled rows
(``sampling``); scoring is one pass over all whole texts without a shuffle.

Defined results: null and empty texts are scored like a text of padding; rows
are scored one by one, so repeated rows and null ids keep their own score;
without labels of both kinds every score is the share of label 1 (0.5 if there
are none); only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import batch_of, id_bucket

WIDTH, STEP, FILTERS, CELL = 6, 2, 8, 256
BLOCK, LAGS = 4, range(2, 21)
EPOCHS, BATCH, RATE, SEED = 9, 32, 0.02, 7
#: Documented bound of the training sample.
TRAINING_ROWS = 2000
#: Bytes that are scored at a time (a text's state is only its pooled cells).
SLAB = 1 << 18


def padded(text: str | None) -> np.ndarray:
    """Bytes of the text, filled with zeros to whole cells: two at least, and
    as many zeros at the end as the longest lag, so that texts laid end to end
    cannot reach into one another's flags."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    cells = max(2, -(-(len(raw) + LAGS[-1]) // CELL))
    return np.frombuffer(raw.ljust(cells * CELL, b"\0"), np.uint8)


def repeats(raw: np.ndarray) -> np.ndarray:
    """Share of blocks in each cell that repeat the bytes at some lag before."""
    flags = np.zeros(len(raw) // BLOCK, bool)
    same = np.zeros(len(raw), bool)
    full = raw != 0
    for lag in LAGS:
        np.equal(raw[lag:], raw[:-lag], out=same[lag:])
        same &= full
        flags |= same.view(np.uint32) == 0x01010101
    return flags.reshape(-1, CELL // BLOCK).mean(axis=1, dtype=np.float32)


@dataclass
class Network:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weight: np.ndarray  # (2 * (FILTERS + 1),)
    offset: float

    def paired(self) -> np.ndarray:
        """Filters as tables over pairs of bytes: a third of the look-ups."""
        f = self.filters
        return np.stack([(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)])

    def cells(self, texts: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
        """Largest response of each filter, then the repeat share, in each
        cell of texts laid end to end."""
        raw = np.concatenate([*texts, np.zeros(WIDTH, np.uint8)])
        n = (len(raw) - WIDTH) // STEP
        code = raw[0::2].astype(np.intp) << 8 | raw[1::2]
        got = pairs[0].take(code[:n], axis=0)
        for j in range(1, WIDTH // 2):
            got += pairs[j].take(code[j:n + j], axis=0)
        # a window that begins in a text's closing zeros must not see the next text
        last = np.cumsum([len(t) // STEP for t in texts])
        for back in range(1, WIDTH // 2):
            got[last - back] = got[last - WIDTH // 2]
        top = np.maximum(got.reshape(-1, CELL // STEP, FILTERS).max(axis=1) + self.bias, 0)
        return np.concatenate([top, repeats(raw[:-WIDTH])[:, None]], axis=1)

    def scores(self, texts: list[str | None]) -> list[float]:
        """Probability of label 1 of each whole text.  Short texts share a
        slab; a longer one is cut into slabs that overlap by whole cells, and
        only its cells' maxima are kept."""
        pairs, out, slab, size = self.paired(), [], [], 0

        def flush() -> None:
            if slab:
                cells = self.cells(slab, pairs)
                for part in np.split(cells, np.cumsum([len(t) // CELL for t in slab])[:-1]):
                    out.append(self.probability(_combine(part)))
                slab.clear()
        for text in texts:
            raw = padded(text)
            if size + len(raw) > SLAB:
                flush()
                size = 0
            if len(raw) > SLAB:
                out.append(self.probability(_combine(self._long(raw, pairs))))
            else:
                slab.append(raw)
                size += len(raw)
        flush()
        return out

    def _long(self, raw: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Cells of one long text: each slab has a cell more on both sides, and
        those extra cells are dropped."""
        parts = []
        for at in range(0, len(raw), SLAB):
            begin, end = max(0, at - CELL), min(len(raw), at + SLAB + CELL)
            cells = self.cells([raw[begin:end]], pairs)
            parts.append(cells[(at - begin) // CELL:][:SLAB // CELL])
        return np.concatenate(parts)

    def probability(self, pooled: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(pooled @ self.weight + self.offset, -40, 40))))


def _combine(cells: np.ndarray) -> np.ndarray:
    """Pooled vector of a text: chunks are two neighbouring cells each."""
    chunks = np.maximum(cells[:-1], cells[1:])
    return np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])


def train(sample: list[tuple[str, int]]) -> Network | float:
    """Fit the network; with one kind of label only, that label's share."""
    y = np.array([label for _, label in sample], float)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    texts = [padded(text) for text, _ in sample]
    repeated = [repeats(raw) for raw in texts]
    draw = np.random.default_rng(SEED)
    net = Network(draw.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                  np.concatenate([draw.normal(0, 0.3, 2 * FILTERS + 2)]).astype(np.float32), 0.0)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in _parameters(net).items()}
    step = 0
    for epoch in range(EPOCHS):
        order = draw.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            grads = {k: np.zeros_like(v) for k, v in _parameters(net).items()}
            for i in order[at:at + BATCH]:
                _backward(net, texts[i], repeated[i], y[i], balance[i] / BATCH, grads)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, v in _parameters(net).items():
                m, s = state[k]
                m += 0.1 * (grads[k] - m)
                s += 0.01 * (grads[k] ** 2 - s)
                v -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)).astype(v.dtype)
            net.offset = float(net.offset_cell[0])
    del net.offset_cell
    return net


def _parameters(net: Network) -> dict[str, np.ndarray]:
    if not hasattr(net, "offset_cell"):
        net.offset_cell = np.array([net.offset])
    return {"filters": net.filters, "bias": net.bias, "weight": net.weight, "offset": net.offset_cell}


def _backward(net: Network, raw: np.ndarray, repeated: np.ndarray, y: float, share: float, grads: dict) -> None:
    """Add one text's gradient; max-pooling sends it to one position a filter
    for each of the (at most FILTERS * cells) maxima in use."""
    n = len(raw)
    raw = np.concatenate([raw, np.zeros(WIDTH, np.uint8)])
    got = net.filters[0][raw[0:n:STEP]]
    for k in range(1, WIDTH):
        got = got + net.filters[k][raw[k:k + n:STEP]]
    got = got.reshape(-1, CELL // STEP, FILTERS)
    where = got.argmax(axis=1)
    top = np.take_along_axis(got, where[:, None, :], axis=1)[:, 0, :] + net.bias
    cells = np.concatenate([np.maximum(top, 0), repeated[:, None]], axis=1)
    pooled = _combine(cells)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.weight + net.offset_cell[0], -40, 40)))
    dz = (p - y) * share
    grads["weight"] += dz * pooled
    grads["offset"] += dz
    chunks = np.maximum(cells[:-1], cells[1:])[:, :FILTERS]
    dchunk = np.full(chunks.shape, dz * net.weight[FILTERS + 1:2 * FILTERS + 1] / len(chunks), np.float32)
    dchunk[chunks.argmax(axis=0), np.arange(FILTERS)] += dz * net.weight[:FILTERS]
    left = cells[:-1, :FILTERS] >= cells[1:, :FILTERS]
    dcell = np.zeros((len(cells), FILTERS), np.float32)
    dcell[:-1] += dchunk * left
    dcell[1:] += dchunk * ~left
    dcell *= top > 0
    grads["bias"] += dcell.sum(axis=0)
    at = where * STEP + (np.arange(len(cells)) * CELL)[:, None]
    cell, f = np.nonzero(dcell)
    for k in range(WIDTH):
        np.add.at(grads["filters"][k], (raw[at[cell, f] + k], f), dcell[cell, f])


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, model: Network | float) -> DataFrame:
    """(doc_id, score) of every whole text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield batch_of(SCORES, batch.column(0),
                           model.scores(texts) if isinstance(model, Network) else [model] * len(texts))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, score double")


def verdicts(scores: DataFrame, modulus: int, held: int) -> DataFrame:
    """Adds held_out and predicted to (doc_id, score)."""
    return scores.select("doc_id", (id_bucket("doc_id", modulus) == held).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
