"""Report cleaning as a Structured Streaming job.

Every row-local operator (the cleaner, tokenizers, perturbations) is a pure
Column expression, so it runs unchanged on a streaming DataFrame. The stream
reads new parquet files of reports, cleans them and appends to a parquet
sink; the checkpoint lives in the shared folder named by
``spark.checkpoint.dir`` so a restarted driver resumes exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.common import evaluate_once

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def cleaned_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Streaming DataFrame of cleaned reports: (doc_id, lang, text)."""
    raw = (spark.readStream.schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    cleaned = raw.where(F.col("text").isNotNull()).select("doc_id", "lang", T.clean_note("text").alias("text"))
    return evaluate_once(cleaned, "text").where(F.col("text").isNotNull())


def run_clean_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str | None = None,
                     available_now: bool = True):
    """Start the cleaning stream (append mode); returns the StreamingQuery."""
    from textloom.session import ensure_checkpoint_dir
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/clean"
    writer = (cleaned_stream(spark, source_dir).writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
