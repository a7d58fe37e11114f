"""Streams of N-Quads lines and of documents: the stateless operators run on them as they are."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.nquads import parse, well_formed


def quads(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed quads of the text files that arrive in a folder; a file's path scopes its blank nodes."""
    lines = spark.readStream.text(path).select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("line"))
    return parse(lines).filter("error is null").filter(well_formed())


def each_batch(stream: DataFrame, work, checkpoint: str):
    """Run ``work(batch, batch_id)`` on every micro-batch: for flattening, framing and whatever else groups."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
