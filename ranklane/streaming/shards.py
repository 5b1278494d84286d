"""Corpus shards as a stream: new files are parsed and appended once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklane.functions.text import is_blank
from ranklane.sources.corpus import parsed, shard_index


def stream_shards(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """shard, docid, title, text and problem of the lines of new files under ``path``, as the batch reader has them: a line
    with a problem isn't dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return parsed(lines.select("value", shard_index(F.col("_metadata.file_path")).alias("shard")).where(~is_blank(F.col("value"))))


def ingest(stream: DataFrame, target: str, checkpoint: str):
    """Appends the stream to Parquet with exactly-once files; ends when all present files are done."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
