"""Corpus pipeline over ``documents``: toxicity, exact dedup, SimHash near-dedup,
substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a frame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of documents; the last
returns the pieces of the packed sequences.

Defined results follow the operators (see their docstrings): null texts count
as empty and stay unless they copy another row, repeated rows are copies, an
empty table stays empty, and extra columns are carried through to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somnolyt.llm import catalog, exact, packing, simhash, substring, toxicity
from somnolyt.llm.storage import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the toxicity operator does not predict as toxic."""
    return toxicity.drop_toxic(docs, catalog.toxicity_model(spark, docs, sf_dir))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the longest row, then the least doc_id."""
    return exact.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component."""
    return simhash.drop_near_copies(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; texts that hold a repeated window are their kept words joined
    by one space, and n_chars follows the text where it is a column."""
    found = substring.substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(columns["n_chars"])
    return found.select(*[(text if c == "text" else e).alias(c) for c, e in columns.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept texts in sequences along the curve."""
    return catalog.packed_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack),
]

#: Learned scores, XXH64 shingles and tokenizers have no SQL form; the tests
#: hold the pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
