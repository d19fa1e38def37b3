"""Tables written to the shared folder, so that lineage ends and a plan stays small."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; one of our own only on a
    single machine where the setting is absent."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="panelforge-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder; nothing if the session is gone."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's owner cleans up
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df and reread it; the table is removed when the process ends. Reading it costs no more
    than its bytes, whatever made it, and a lost executor repeats nothing that was done before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelforge-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    atexit.register(drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)
