"""Entity documents as a stream: new files of a folder become claims as they arrive. Stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.claims import extract_claims


def stream_claims(spark: SparkSession, folder: str, year: int, files_at_once: int | None = None, **options) -> DataFrame:
    """Claims of the documents in text files (plain, .gz, .bz2) of a folder; ``options`` are those of ``extract_claims``."""
    reader = spark.readStream.format("text")
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return extract_claims(reader.load(folder).select(F.col("value").alias("line")), "line", year, **options)


def write_claims_stream(claims: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the stream to Parquet by snapshot_year; exactly once, by the checkpoint folder. ``once`` stops after what is there."""
    writer = claims.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("snapshot_year").outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
