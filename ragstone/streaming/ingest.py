"""Streaming ingestion: new files become chunks with embeddings as they arrive (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragstone.functions.chunkers import fixed
from ragstone.functions.embedders import hash_embedding
from ragstone.functions.text import file_stem


def chunk_stream(spark: SparkSession, folder: str, chunker: Callable[[Column], Column] = fixed, embedding: Callable[[Column], Column] = hash_embedding) -> DataFrame:
    """``(source, chunk_index, text, embedding)`` of the Markdown files that appear in a folder; column expressions only, so it streams stateless."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").load(folder)
    rows = files.select(file_stem(F.col("_metadata.file_path")).alias("source"), F.posexplode(chunker(F.col("value"))).alias("chunk_index", "text"))
    return rows.withColumn("embedding", embedding(F.col("text")))


def start(stream: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the stream to a Parquet table; the file sink and the checkpoint make it exactly once."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
