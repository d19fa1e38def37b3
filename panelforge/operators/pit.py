"""Point-in-time lookup of disclosures: nothing announced later is ever seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot(pit: DataFrame, date: str) -> DataFrame:
    """The latest disclosure of every stock as of one date; ties go to the latest period."""
    w = Window.partitionBy("ts_code").orderBy(F.col("ann_date").desc(), F.col("end_date").desc())
    return pit.filter(F.col("ann_date") <= date).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def as_of(left: DataFrame, pit: DataFrame, columns: list[str]) -> DataFrame:
    """The same for every (ts_code, trade_date) of the left side, which keeps all its rows: both sides
    in one line by stock and date, disclosures before the rows of their day, and the last disclosure
    carried on. One shuffle, and no row of the result but the left side's own."""
    kept = [c for c in left.columns if c != "ts_code"]
    found = ["ann_date", *columns]
    a = left.select("ts_code", F.col("trade_date").alias("_at"), F.lit(1).alias("_side"), F.lit("").alias("_end"), F.struct(*kept).alias("_row"), *[F.lit(None).cast(pit.schema[c].dataType).alias(f"_p_{c}") for c in found])
    b = pit.select("ts_code", F.col("ann_date").alias("_at"), F.lit(0).alias("_side"), F.col("end_date").alias("_end"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *[F.col(c).alias(f"_p_{c}") for c in found])
    w = Window.partitionBy("ts_code").orderBy("_at", "_side", "_end").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct(*[F.col(f"_p_{c}").alias(c) for c in found])), ignorenulls=True).over(w)
    j = a.unionByName(b).withColumn("_last", last).filter("_side = 1")
    return j.select("ts_code", *[F.col("_row")[c].alias(c) for c in kept], *[F.col("_last")[c].alias(c) for c in found])
