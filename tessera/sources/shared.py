"""The folder that driver and executors share, and tables written there to cut lineage."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where spark.checkpoint.dir is unset, a local session remembers the folder that was made for it.
OWN = "spark.tessera.own.dir"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: a folder of our own if driver and executors are one process, else an error, as other machines wouldn't see it."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN, None)
    if not place:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(OWN, place)
    return place.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tessera/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder and read them back. What isn't dropped is the cluster's to clear."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


#: Bytes of a method beyond which the JVM doesn't compile it, by default.
COMPILED = 8000


@contextmanager
def split_code(spark: SparkSession):
    """Jobs within it run stages of very wide expressions as projections of small methods: one method for such a stage is longer than the JVM compiles, and would be interpreted for every row."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(min(int(before), COMPILED)))
    try:
        yield
    finally:
        spark.conf.set(limit, before)


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, through the file system that Spark wrote them with, and let go of the shuffles behind plans that are gone."""
    import gc

    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()  # frees the plans that Python held, so that Spark's cleaner finds their shuffles
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()
