"""Exact dedup as a stateful stream with disk-backed keyed state.

Arrivals (the rows' ids with a digest of their normalised text) are written
once to the shared folder and read as a stream.  The stream keeps, for every digest,
the row that stays (its stable identifier, its length and where its content
lies) and the number of rows; state is kept by RocksDB, checkpointed to the
shared folder, and never expires, so a later run over the same folder goes on
where the last one ended.  The state is then read as a table.

Hits are checked on full bytes: within each digest the least and greatest
normalised texts must be the same bytes.  Should a digest ever hold two texts,
the groups are formed by the texts themselves instead.

Both the stream and the check combine rows before the shuffle, so a group of
copies as large as a third of all rows reaches its key as one row a task.

Defined results: null text counts as empty; of equal texts the longest
original stays, then the smallest doc_id (nulls last), then the first row;
repeated rows are told apart by a row number that is written with the
arrivals; an empty table gives no rows; the input row travels as one struct,
so extra columns cannot clash with the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_path, stored
from .textkit import GAP

#: Files of one micro-batch.
FILES_A_BATCH = 1000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = {"spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
          "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
          # many small stores: no disk set aside ahead of the writes
          "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def arrivals(docs: DataFrame, columns: list[str], digest=sha256) -> DataFrame:
    """Written rows (row, uid, digest, n_chars); row holds the named columns."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text")
    return stored(own.select(
        "row", F.monotonically_increasing_id().alias("uid"), digest(normalised(F.col("text"))).alias("digest"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")), "arrivals")


def _summed(rows: DataFrame, key: str, locator: Column) -> DataFrame:
    """Per key: the struct that orders rows (the least stays) and the count."""
    doc_id = F.col("row.doc_id")
    stays = F.struct((-F.col("n_chars")).alias("shorter"), doc_id.isNull().alias("nameless"),
                     doc_id.alias("doc_id"), F.col("uid"), locator.alias("locator"))
    return rows.groupBy(key).agg(F.min(stays).alias("stays"), F.count(F.lit(1)).alias("n"))


def state_of_stream(rows: DataFrame, files_a_batch: int = FILES_A_BATCH) -> DataFrame:
    """Run the stream over written arrivals and read its state:
    (digest, keep_uid, keep_id, locator, n)."""
    spark: SparkSession = rows.sparkSession
    home = shared_path(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        source = rows.inputFiles()[0].rsplit("/", 1)[0]
        stream = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_a_batch).parquet(source))
        query = (_summed(stream, "digest", F.col("_metadata.file_path"))
                 .writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", home).start())
        query.awaitTermination()
        state = spark.read.format("statestore").load(home)
        kept, n = state.schema["value"].dataType.fieldNames()
        return stored(state.select(
            F.col("key.digest").alias("digest"), F.col(f"value.`{kept}`.uid").alias("keep_uid"),
            F.col(f"value.`{kept}`.doc_id").alias("keep_id"), F.col(f"value.`{kept}`.locator").alias("locator"),
            F.col(f"value.`{n}`").alias("n")), "dedup-groups")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digests_hold_one_text(docs: DataFrame, digest=sha256) -> bool:
    """The check of hits on full bytes, read from the documents themselves."""
    text = docs.select(normalised(F.col("text")).alias("text"))
    per_digest = (text.groupBy(digest(F.col("text")).alias("digest"))
                  .agg(F.min("text").alias("least"), F.max("text").alias("greatest")))
    return per_digest.filter(F.col("least") != F.col("greatest")).isEmpty()


def exact_groups(docs: DataFrame, columns: list[str], digest=sha256) -> tuple[DataFrame, DataFrame]:
    """(arrivals, groups): rows and, by digest, the row that stays and the size."""
    rows = arrivals(docs, columns, digest)
    if rows.isEmpty():
        return rows, rows.select("digest", F.col("uid").alias("keep_uid"), F.col("row.doc_id").alias("keep_id"),
                                 F.lit("").alias("locator"), F.lit(0).cast("long").alias("n"))
    if digests_hold_one_text(docs, digest):
        return rows, state_of_stream(rows)
    rows = arrivals(docs, columns, lambda text: text)
    return rows, _summed(rows, "digest", F.lit("")).select(
        "digest", F.col("stays.uid").alias("keep_uid"), F.col("stays.doc_id").alias("keep_id"),
        F.col("stays.locator").alias("locator"), "n")


def exact_dedup(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    named = docs.select("doc_id", "text")
    shown = named.withColumn("text_sha256", sha256(normalised(F.col("text"))))
    rows, groups = exact_groups(shown, ["doc_id", "text_sha256"], digest)
    return rows.join(groups, "digest").select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"),
        (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("row.text_sha256").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The input rows that stay, with the input's columns."""
    rows, groups = exact_groups(docs, docs.columns)
    return rows.join(groups.select(F.col("keep_uid").alias("uid")), "uid", "left_semi").select("row.*")
