"""Incremental prepare: new raw log files -> parsed, masked long-form lines, and rejects.

The same parse, mask and reject rules as the batch path, run as a Structured Streaming file
source with an exactly-once parquet sink; the checkpoint lives in the shared folder, so a
restarted or moved driver resumes where it stopped. A line that is no log line never stops the
stream: it is written with its reason. Trace-level checks (conformance, keywords) then run in
batch over the appended table, as in the reference's prepare-then-evaluate flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.functions.text import content, parse_v1, template_of
from logweave.sources.files import reject_counts, reject_reason


def ingest_logs(spark: SparkSession, source_dir: str, out: str, checkpoint: str,
                available_now: bool = True, max_files: int = 1000) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes every file present, then stops.

    ``out`` is partitioned by ``reason`` (``none`` for good lines) and day; the counts of each
    micro-batch are the observed metrics ``ingest`` of its progress."""
    raw = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files)
           .load(source_dir))
    p = raw.select(F.col("_metadata.file_path").alias("file"), "value", parse_v1(F.col("value")).alias("_p"))
    p = p.withColumn("reason", reject_reason(F.col("value"), F.col("_p.parsed"), F.col("_p.ts_text")))
    p = p.observe("ingest", *reject_counts())
    good = F.col("reason").isNull()
    line = content(F.col("_p.service"), F.col("_p.level"), F.col("_p.message"))
    lines = p.select(
        "file", *[F.when(good, F.col(f"_p.{c}")).alias(c) for c in ("ts_text", "level", "service", "trace_id")],
        F.when(good, line).alias("content"), F.when(good, template_of(line)).alias("template"),
        F.when(~good, F.col("value")).alias("value"), F.coalesce("reason", F.lit("none")).alias("reason"),
        F.when(good, F.to_date(F.try_to_timestamp(F.col("_p.ts_text")))).alias("day"))
    w = (lines.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).partitionBy("reason", "day").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def ingested(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The good lines and the rejects ``(file, reason, value)`` written so far."""
    rows = spark.read.parquet(out)
    return (rows.where(F.col("reason") == "none").drop("reason", "value"),
            rows.where(F.col("reason") != "none").select("file", "reason", "value"))
