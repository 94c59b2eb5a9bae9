"""Bounded samples of labelled rows for the classifiers of this package.

A sample is a fixed number of rows chosen by a hash of their id, so it does
not grow with the corpus and is the same for any partitioning.  Only labels
are sampled: what is scored afterwards is every row and every whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import id_bucket

#: Documented bounds: rows of a sample, and code points of a sampled text.
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int,
                    rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """(text, label) of up to ``rows`` training rows (id bucket not ``held``).

    Labels are thinned to twice the bound first and broadcast (they are
    bounded), so texts outside the sample never leave their task."""
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
              .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (id_bucket("doc_id", modulus) != held))
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = (texts.filter(F.length("text") <= chars).join(F.broadcast(chosen), "doc_id")
             .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).select("text", "label"))
    return [(r.text, r.label) for r in found.collect()]
