"""Incremental redaction: new files are detected, redacted and appended; the checkpoint keeps what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect
from ..plans.review import anonymize


def redact_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, pack: str = "bger-2020", max_files: int = 100):
    """Redact the documents (Parquet files with doc_id, text, legal_area) that arrive in a folder, a bounded number of files
    in each batch, and stop when none is left. A batch that is run again replaces its own output."""
    schema = "doc_id string, text string, legal_area string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        _, applied = anonymize(batch, pack=pack)
        applied.select("doc_id", "output", "edits").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def detect_stream(stream: DataFrame) -> DataFrame:
    """Pattern mentions of a stream of documents: stateless, so any output mode will do."""
    return stream.select("doc_id", F.posexplode(detect.pattern_array(F.col("text"))).alias("seq", "m")).select("doc_id", "seq", "m.*")


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Mentions by type and window of arrival (column ts), late ones up to a watermark included."""
    found = stream.withWatermark("ts", late).select("ts", F.explode(detect.pattern_array(F.col("text"))).alias("m"))
    return found.groupBy(F.window("ts", width), F.col("m.type").alias("type")).count()
