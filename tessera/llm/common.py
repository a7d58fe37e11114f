"""What the operators share: tables, words, and the folder that all executors see."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import dropped, shared_path, written  # noqa: F401

#: White space that separates words: space and \t \n \v \f \r, nothing else.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of Arrow data that a task makes something of at once.
SLICE = 1 << 22


def sliced(batches, most: int = SLICE):
    """Arrow batches in slices of about ``most`` bytes or one row. A batch has up to 10,000 rows, however long: lists of all its texts, and columns of the same size, would be several times as much."""
    for b in batches:
        rows = max(1, b.num_rows * most // max(1, b.nbytes))
        for row in range(0, b.num_rows, rows):
            yield b.slice(row, rows)


def words(text: Column) -> Column:
    """The words of a text in order; none for null and for white space alone."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
