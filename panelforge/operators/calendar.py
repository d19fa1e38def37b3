"""Trading calendar: index, shifts, schedules. The calendar is the small table of distinct dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _all():
    return Window.orderBy("trade_date")


def index(bars: DataFrame) -> DataFrame:
    """trade_date, idx (from 0), next_date. One row per distinct date: a few thousand."""
    d = bars.select("trade_date").distinct()
    return d.withColumns({"idx": (F.row_number().over(_all()) - 1).cast("int"), "next_date": F.lead("trade_date").over(_all())})


def weekdays(spark, start: str, end: str) -> DataFrame:
    """Monday to Friday, both ends included."""
    d = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start), "yyyyMMdd"), F.to_date(F.lit(end), "yyyyMMdd"))).alias("d"))
    return d.filter(F.weekday("d") < 5).select(F.date_format("d", "yyyyMMdd").alias("trade_date"))


def every(dates: DataFrame, k: int, start: int = 0, tail: str = "") -> DataFrame:
    """Every k-th date from position start; tail 'last' adds the last date, 'rest' all dates after
    the last one taken."""
    d = dates.withColumn("rn", F.row_number().over(_all()) - 1)
    n = d.agg(F.max("rn").alias("top"))
    d = d.crossJoin(F.broadcast(n)) if tail else d  # one row
    hit = (F.col("rn") >= start) & ((F.col("rn") - start) % k == 0)
    if tail == "last":
        hit = hit | (F.col("rn") == F.col("top"))
    elif tail == "rest":
        hit = hit | (F.col("rn") > start + F.floor((F.col("top") - start) / k) * k)
    return d.filter(hit).select("trade_date")


def schedule(factor_dates: DataFrame, cal: DataFrame, interval: int) -> DataFrame:
    """Rebalance periods: every interval-th factor date (all of them, if that leaves fewer than
    three); entry is the next trading day, exit the trading day after the next rebalance date."""
    d = factor_dates.select("trade_date").distinct()
    d = d.withColumns({"rn": F.row_number().over(_all()) - 1, "n": F.count("*").over(Window.partitionBy())})
    d = d.filter((F.ceil(F.col("n") / interval) < 3) | (F.col("rn") % interval == 0))
    d = d.withColumns({"period": F.row_number().over(_all()), "next_t": F.lead("trade_date").over(_all())}).filter("next_t is not null")
    a = cal.select(F.col("trade_date").alias("trade_date"), F.col("next_date").alias("entry_date"))
    b = cal.select(F.col("trade_date").alias("next_t"), F.col("next_date").alias("exit_date"))
    d = d.join(F.broadcast(a), "trade_date").join(F.broadcast(b), "next_t").filter("entry_date is not null and exit_date is not null")
    return d.select("period", "trade_date", "entry_date", "exit_date")
