"""Structured Streaming scorer: new patient files arriving in a folder are
encoded with the training parameters and scored by a saved pipeline.

Every step is a per-row projection (recode, rules, one-hot by fitted
levels, scaling with fitted centres and ranges, model transform), so the
stream keeps no state; the checkpoint lives under the session's shared
checkpoint folder.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import models
from ..plans.matrix import MatrixParams, apply_model_matrix
from ..session import ensure_checkpoint_dir
from ..sources.cohort import KEY


def scored_stream(spark: SparkSession, source_dir: str, schema: T.StructType,
                  params: MatrixParams, model: PipelineModel, fmt: str = "parquet") -> DataFrame:
    """Streaming DataFrame of (patient_id, prediction, score) for files in ``source_dir``."""
    raw = spark.readStream.schema(schema).format(fmt).load(source_dir)
    X = apply_model_matrix(raw, params, KEY)
    return models.predict(model, X, KEY).select(KEY, "prediction", "score")


def start_scoring(spark: SparkSession, source_dir: str, schema: T.StructType, params: MatrixParams,
                  model: PipelineModel, sink_dir: str, name: str = "patient_scores",
                  available_now: bool = True) -> StreamingQuery:
    """Append scores to Parquet at ``sink_dir`` (exactly-once via the checkpoint)."""
    ckpt = ensure_checkpoint_dir(spark).rstrip("/") + f"/streams/{name}"
    writer = (scored_stream(spark, source_dir, schema, params, model).writeStream
              .format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt)
              .outputMode("append").queryName(name))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
