"""Raw factors of all dates and stocks in one pass over the bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.industries import OTHER
from ..functions.scalars import market_value, ratio
from . import calendar, pit
from .xsection import clean

LOOKBACK = 30
NAMES = ("MOM_20D", "REV_5D", "VOL_20D", "EP_TTM", "ROE_TTM")


def _std_of_last(w: Window, most: int = 20, least: int = 15) -> F.Column:
    """Population deviation of the last returns within the lookback, whose first bar has none: most
    of them where n_bars exceeds it, else n_bars - 1."""
    by_rows = [F.stddev_pop("daily_ret").over(w.rowsBetween(1 - n, 0)) for n in range(least, most + 1)]
    out = by_rows[-1]
    for n, x in zip(range(least, most), by_rows, strict=False):
        out = F.when(F.col("n_bars") == n + 1, x).otherwise(out)
    return F.when(F.col("n_bars") > least, out)


def price_features(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """ts_code, trade_date, close, total_mv, n_bars, daily_ret, mom_20, rev_5, vol_20. The lookback
    counts calendar dates; lags count the stock's own bars within it. A price of zero gives the next
    ones infinite returns (zero after zero: NaN), which stay."""
    cal = F.broadcast(calendar.index(bars).select("trade_date", "idx"))
    b = bars.select("ts_code", "trade_date", "close", "adj_close").join(cal, "trade_date")
    w = Window.partitionBy("ts_code").orderBy("idx")
    near = w.rangeBetween(-(lookback - 1), 0)
    b = b.withColumns({
        "n_bars": F.count("*").over(near),
        "_d": F.lag("adj_close").over(w), "_m": F.lag("adj_close", 19).over(w), "_r": F.lag("adj_close", 4).over(w),
    })
    b = b.withColumn("daily_ret", ratio(F.col("adj_close"), F.col("_d")) - 1).withColumn("_v", _std_of_last(w))
    return b.select(
        "ts_code", "trade_date", "close", market_value(F.col("close"), F.col("ts_code")).alias("total_mv"), "n_bars", "daily_ret",
        F.when(F.col("n_bars") >= 20, ratio(F.col("adj_close"), F.col("_m")) - 1).alias("mom_20"),
        F.when(F.col("n_bars") >= 5, ratio(F.col("adj_close"), F.col("_r")) - 1).alias("rev_5"),
        F.col("_v").alias("vol_20"),
    )


#: Factors by name: the column that holds each.
COLUMNS = {"MOM_20D": "mom_20", "REV_5D": "rev_5", "VOL_20D": "vol_20", "EP_TTM": "ep_ttm", "ROE_TTM": "roe_ttm"}


def raw_factors(bars: DataFrame, basic: DataFrame, disclosures: DataFrame, min_rows: int = 10, names: tuple = NAMES, dates: DataFrame | None = None) -> DataFrame:
    """Long form: trade_date, ts_code, factor_name, raw_val, industry, total_mv. Stocks with fewer
    than five bars in the lookback, and factors with fewer than min_rows rows on a date, are left out.
    Only the named factors are computed; disclosures are read only for those that need them. dates:
    trade_date, a calendar's rows; only these are computed."""
    f = price_features(bars).filter("n_bars >= 5")
    f = f if dates is None else f.join(F.broadcast(dates), "trade_date", "left_semi")
    if {"EP_TTM", "ROE_TTM"} & set(names):
        f = pit.as_of(f, disclosures, ["ttm_net_profit", "roe_ttm"]).withColumn("ep_ttm", F.try_divide(F.col("ttm_net_profit"), F.col("total_mv")))
    known = basic.select("ts_code", "industry", F.lit(True).alias("_known"))
    f = f.join(known, "ts_code", "left").withColumn("industry", F.when(F.col("_known"), F.col("industry")).otherwise(OTHER))
    stack = ", ".join(f"'{n}', {COLUMNS[n]}" for n in names)
    long = f.select("trade_date", "ts_code", "industry", "total_mv", F.expr(f"stack({len(names)}, {stack}) as (factor_name, raw_val)"))
    long = long.filter("raw_val is not null")
    n = F.count("*").over(Window.partitionBy("trade_date", "factor_name"))
    return long.withColumn("_n", n).filter(F.col("_n") >= min_rows).select("trade_date", "ts_code", "factor_name", "raw_val", "industry", "total_mv")


def factor_metrics(bars: DataFrame, basic: DataFrame, disclosures: DataFrame, names: tuple = NAMES, industries: tuple | None = None, dates: DataFrame | None = None) -> DataFrame:
    """The cleaned factors of all dates: trade_date, ts_code, factor_name, raw_val, clean_val."""
    raw = raw_factors(bars, basic, disclosures, names=names, dates=dates)
    return clean(raw, industries=industries).select("trade_date", "ts_code", "factor_name", "raw_val", "clean_val")


def scan(metrics: DataFrame, name: str, start: str | None = None, end: str | None = None, use_clean: bool = True) -> DataFrame:
    """trade_date, ts_code, factor_val of one factor between two dates (both ends included; None: no
    bound), from its clean or raw values. Prices are never bounded by these dates: exits lie beyond."""
    f = metrics.filter(F.col("factor_name") == name)
    f = f.filter(F.col("trade_date") >= start) if start else f
    f = f.filter(F.col("trade_date") <= end) if end else f
    return f.select("trade_date", "ts_code", F.col("clean_val" if use_clean else "raw_val").alias("factor_val"))
