"""Small helpers shared by the text operators of this package."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the word rule of every operator here (ASCII white space parts words).
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; null and empty give none.

    ``bytes.split`` parts at exactly the six ASCII white-space bytes, which
    cannot occur inside a multi-byte UTF-8 sequence."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, codes, ends): the distinct words of a batch of texts, a code per
    word occurrence, and where each text's codes end.  Null texts have none."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    full = pc.not_equal(pc.binary_length(lists.values), 0)
    ends = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))][lists.offsets.to_numpy()]
    coded = lists.values.filter(full).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), ends[1:]


def gather(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Concatenation of the parts that the codes name, where part i is
    ``lengths[i]`` items of ``flat`` after those of the parts before it."""
    starts, n = (np.cumsum(lengths) - lengths)[codes], lengths[codes]
    ends = np.cumsum(n)
    return flat[np.repeat(starts - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of the byte-level alphabet: printable Latin-1
    characters stand for themselves, the other bytes for 256, 257, ... in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column that is used several times (or inside a lambda) may be inlined
    into each use by the optimizer; a lambda variable is bound exactly once."""
    return F.transform(F.array(value), body)[0]


def id_bucket(key: Column | str, modulus: int) -> Column:
    """``crc32`` of the key's decimal text modulo ``modulus`` (null keys: -1)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(modulus), F.lit(-1)).cast("int")


def py_id_bucket(key: int, modulus: int) -> int:
    return zlib.crc32(str(key).encode()) % modulus


class TwoGenerationCache:
    """Bounded memo of ``make(key)``: when the young half is full it becomes
    the old half, so frequent keys survive and memory stays within
    ``2 * limit`` entries whatever the vocabulary of the corpus."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
            self._keep(key, value)
        return value

    def many(self, keys) -> list:
        """Values of all keys; the usual case, a hit, costs one dict probe."""
        found = list(map(self.young.get, keys))
        if None in found:
            for i, value in enumerate(found):
                if value is None:
                    found[i] = self(keys[i])
        return found

    def many_lists(self, listed: list[list], make_many) -> list[list]:
        """Values of several key lists.  Each distinct key is looked up once,
        and what is missing is made in one call of ``make_many(keys)``, which
        returns values in the order of the keys."""
        values = dict.fromkeys(chain.from_iterable(listed))
        young, old, fresh = self.young.get, self.old.get, []
        for key in values:
            value = young(key)
            if value is None:
                value = old(key)
                fresh.append(key) if value is None else self._keep(key, value)
            values[key] = value
        for key, value in zip(fresh, make_many(fresh) if fresh else ()):
            values[key] = value
            self._keep(key, value)
        return [list(map(values.__getitem__, keys)) for keys in listed]

    def _keep(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


def slices(batch: pa.RecordBatch, rows: int):
    """The batch in parts of ``rows`` rows, to bound what is held at a time."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema)
