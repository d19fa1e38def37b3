"""Shared plumbing of the training-data operators: tables, scratch storage, word splitting."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this subpackage.
WS = r"[\x20\x09-\x0D]"
NON_WS = r"[^\x20\x09-\x0D]"

#: Rows and bytes that one Arrow batch may carry to a Python worker; texts may be long.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once; the settings are read when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


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


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark._jvm, spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: the folder's owner cleans up
        pass


def materialize(df: DataFrame, name: str, keep: bool = True) -> DataFrame:
    """Write ``df`` as a table in the shared folder and reread it: lineage ends here, and a lost
    executor costs only what it was doing. The table is removed when the session's process ends,
    for results may be read lazily until then; ``forget`` removes it sooner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelforge-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    atexit.register(_drop, spark, path)
    return out


def forget(df: DataFrame) -> None:
    """Remove a table made by ``materialize`` that nothing reads any more."""
    if path := getattr(df, "_scratch", None):
        _drop(df.sparkSession, path)


def words(text: Column) -> Column:
    """The array of words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def with_rank(df: DataFrame, order: list[Column], name: str, rank: str = "rank") -> DataFrame:
    """A global 0-based rank without one task seeing all rows: sort by range, number each
    partition's rows, add the counts of the partitions before it (one row per partition)."""
    mid = F.monotonically_increasing_id()
    t = materialize(df.orderBy(*order).withColumn("_mid", mid), name)
    t = t.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = t.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    before = counts.select("_pid", F.coalesce(before, F.lit(0)).alias("_before"))
    return t.join(F.broadcast(before), "_pid").withColumn(rank, F.col("_idx") + F.col("_before")).drop("_pid", "_idx", "_mid", "_before")
