"""Rank information coefficients over several horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import divide, quantise
from . import calendar
from .features import scan
from .xsection import spearman

LAGS = (1, 5, 20)


def forward_returns(bars: DataFrame, lags: tuple = LAGS) -> DataFrame:
    """trade_date (T), ts_code, lag, fwd_ret from T+1 to T+1+lag by the calendar of all bars; rows
    without a usable price at either end are left out."""
    cal = calendar.index(bars).select("trade_date", "idx")
    p = bars.select("ts_code", "trade_date", "adj_close").join(F.broadcast(cal), "trade_date").select("ts_code", "idx", "adj_close")
    entry = p.select("ts_code", (F.col("idx") - 1).alias("t"), F.col("adj_close").alias("p0"), F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    exit_ = p.select("ts_code", "idx", F.col("adj_close").alias("p1"))
    j = entry.withColumn("idx", F.col("t") + 1 + F.col("lag")).join(exit_, ["ts_code", "idx"]).filter("p0 > 0 and p1 is not null and p1 <> 0")
    dates = F.broadcast(cal.select("trade_date", F.col("idx").alias("t")))
    return j.join(dates, "t").select("trade_date", "ts_code", "lag", (F.col("p1") / F.col("p0") - 1).alias("fwd_ret"))


def rank_ic(factor: DataFrame, bars: DataFrame, lags: tuple = LAGS, min_pairs: int = 10) -> DataFrame:
    """factor: trade_date, ts_code, factor_val. Returns lag, trade_date, n, ic."""
    pairs = factor.filter("factor_val is not null").join(forward_returns(bars, lags), ["trade_date", "ts_code"])
    return spearman(pairs, "factor_val", "fwd_ret", ["lag", "trade_date"]).filter((F.col("n") >= min_pairs) & F.col("corr").isNotNull()).withColumnRenamed("corr", "ic")


def summary(ic: DataFrame) -> DataFrame:
    """lag, mean_ic, std_ic, ir (annualised by the lag), positive_ratio (in %), n_dates, final cum_ic."""
    s = ic.groupBy("lag").agg(F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("std_ic"), (F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)) * 100).alias("positive_ratio"), F.count("*").alias("n_dates"), F.sum("ic").alias("cum_ic"))
    return s.withColumn("ir", divide(F.col("mean_ic"), F.col("std_ic"), 1e-6, 0.0) * F.sqrt(F.lit(252.0) / F.col("lag")))


def published(s: DataFrame) -> DataFrame:
    """A summary rounded as it is shown: four places, the ratio three, the share two."""
    return s.withColumns({"mean_ic": quantise(F.col("mean_ic"), 4), "std_ic": quantise(F.col("std_ic"), 4), "ir": quantise(F.col("ir"), 3), "positive_ratio": quantise(F.col("positive_ratio"), 2)})


def of_factor(metrics: DataFrame, bars: DataFrame, name: str, lags: tuple = LAGS, start: str | None = None, end: str | None = None, use_clean: bool = True) -> DataFrame:
    """Rank ICs of a stored factor between two dates, from its clean or raw values; all prices count."""
    return rank_ic(scan(metrics, name, start, end, use_clean), bars, lags)


def cumulative(ic: DataFrame) -> DataFrame:
    return ic.withColumn("cum_ic", F.sum("ic").over(Window.partitionBy("lag").orderBy("trade_date")))


def decay(ic: DataFrame, lags: tuple = LAGS) -> DataFrame:
    """One row per lag asked for; lags without dates get zeros."""
    want = ic.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    s = summary(ic).select("lag", "mean_ic", "ir")
    return want.join(s, "lag", "left").fillna(0.0, ["mean_ic", "ir"])
