"""Redaction of files as they arrive. Each document stands alone, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.deidentify import Rules, deidentify
from ..sources.files import extracted


def documents_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """doc_id, path, text of files that arrive in a folder; files that no format takes are left out."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return extracted(files).where("error IS NULL").select(F.xxhash64("path").alias("doc_id"), "path", "text")


def redact_stream(documents: DataFrame, out: str, checkpoint: str, rules: Rules | None = None) -> StreamingQuery:
    """Writes each document's output to `out` as Parquet, those that may not be handed out without their text."""
    done = deidentify(documents, rules)
    handed = done.select("doc_id", F.when(F.col("deliverable"), F.col("output")).alias("output"), "deliverable", F.size("accepted").alias("n_spans"), "findings")
    return handed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def sessions_with_ttl(events: DataFrame, minutes: int = 30) -> DataFrame:
    """session_id and last seen time of analysis sessions (session_id, at) that nothing has touched for so long: the
    expiry of stored analyses, as event-time session windows."""
    return events.withWatermark("at", f"{minutes} minutes").groupBy("session_id", F.session_window("at", f"{minutes} minutes")).agg(F.max("at").alias("last_seen"), F.count("*").alias("n_events"))
