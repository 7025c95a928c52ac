"""The same plans over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright import config as C
from pagewright.operators.lines import explode_lines, remap_language, with_model_columns
from pagewright.operators.passes import document_passes
from pagewright.operators.scoring import classify
from pagewright.sinks import write_lines


def classify_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, cfg: C.EngineConfig = C.DEFAULT) -> StreamingQuery:
    """Parquet documents (doc_id, text, lang) that appear in folder -> classified lines below out.

    A document arrives whole, so its passes run within its micro-batch. Lines lie
    below document=<document>: one that arrives again, or whose batch is repeated,
    replaces its own lines. Of a document twice in a batch the longer text counts.
    """
    stream = spark.readStream.schema("doc_id long, text string, lang string").parquet(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        once = batch.groupBy("doc_id").agg(F.max_by(F.struct("text", "lang"), F.struct(F.length("text"), "text")).alias("d")).select("doc_id", "d.*")
        lines = remap_language(with_model_columns(explode_lines(once)))
        write_lines(document_passes(classify(lines, cfg), cfg), out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_documents(arrived: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents (doc_id, text) whose text isn't the one that was classified (seen: doc_id, sha256); the others needn't be done again."""
    return arrived.withColumn("sha256", F.sha2("text", 256)).join(seen.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_anti")


def event_windows(events: DataFrame, minutes: int = 60, lateness: str = "2 hours") -> DataFrame:
    """Counts and mean values by type and tumbling window, late events up to lateness included; batch or stream."""
    df = events.withWatermark("ts", lateness) if events.isStreaming else events
    return df.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")
