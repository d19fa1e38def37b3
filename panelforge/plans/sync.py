"""Incremental synchronisation by high watermark: full load, head backfill, forward sync, catch-up."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import falsy
from ..operators import calendar, features
from ..sources import landed, synthetic
from ..sources.scratch import written
from ..sources.tables import Warehouse


def latest_states(bars: DataFrame) -> DataFrame:
    """ts_code, trade_date, close, adj_factor of each stock's last bar; null or zero close and
    factor become 10.0 and 1.0."""
    last = bars.groupBy("ts_code").agg(F.max_by(F.struct("trade_date", "close", "adj_factor"), "trade_date").alias("s"))
    return last.select("ts_code", "s.trade_date", falsy(F.col("s.close"), 10.0).alias("close"), falsy(F.col("s.adj_factor"), 1.0).alias("adj_factor"))


def after(df: DataFrame, column: str, watermark: str | None) -> DataFrame:
    return df.filter(F.col(column) > watermark) if watermark is not None else df


def factor_dates(new_dates: DataFrame) -> DataFrame:
    """All of at most ten dates, else every fifth and the last."""
    return new_dates if new_dates.count() <= 10 else calendar.every(new_dates, 5, tail="last")


def populate(w: Warehouse, dates: DataFrame) -> int:
    """Factors of these dates, computed together and upserted. Bars are read from the lookback of the
    first date to the last date; other parts of the table aren't opened."""
    dates = written(dates.select("trade_date").distinct(), "factor_dates")
    first, last = dates.agg(F.min("trade_date"), F.max("trade_date")).first()
    if first is None:
        return 0
    before = w.read("daily_bar", end=first).select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(features.LOOKBACK)
    start = before.agg(F.min("trade_date")).first()[0] or first
    bars = w.read("daily_bar", start, last)
    return w.upsert("factor_metrics", features.factor_metrics(bars, w.read("stock_basic"), w.read("financial_pit"), dates=dates))


def _missing(w: Warehouse) -> DataFrame:
    """Trading dates after the last one that has factors; all of them if none has."""
    mark = w.read("factor_metrics").agg(F.max("trade_date")).first()[0]
    return after(w.read("daily_bar", mark).select("trade_date").distinct(), "trade_date", mark)


def catch_up(w: Warehouse) -> int:
    """How many dates without factors were computed."""
    lag = written(_missing(w), "lagging_dates")
    n = lag.count()
    if n:
        populate(w, lag)
    return n


def sync(spark: SparkSession, w: Warehouse, years: float = 5, n_stocks: int = 100, as_of: date | None = None, factors: bool = True) -> dict:
    """Bring the warehouse up to as_of (today): status (full_sync, updated, up_to_date), bars and
    disclosures added, dates that got factors. Stocks already there are kept. Dates that lack factors
    are caught up even if factors is False, but not after a full load."""
    today = as_of or date.today()
    start = (today - timedelta(days=int(years * 365.25))).strftime("%Y%m%d")
    end = today.strftime("%Y%m%d")
    w.init()
    if not w.read("stock_basic").head(1):
        w.upsert("stock_basic", synthetic.universe(spark, n_stocks))
    stocks = w.read("stock_basic")
    lo, hi = w.read("daily_bar").agg(F.min("trade_date"), F.max("trade_date")).first()
    if hi is None:
        days = calendar.weekdays(spark, start, end)
        n = w.upsert("daily_bar", synthetic.bars(stocks, days))
        f = w.upsert("financial_pit", synthetic.disclosures(stocks, int(start[:4]), today.year))
        done = sampled(days) if factors else days.limit(0)
        if factors:
            populate(w, done)
        return {"status": "full_sync", "new_bars": n, "new_disclosures": f, "new_factor_dates": done.count()}
    n = f = k = 0
    if start < lo:  # the head: no state to go on from, no factors, no disclosures
        n += w.upsert("daily_bar", synthetic.bars(stocks, calendar.weekdays(spark, start, lo).filter(F.col("trade_date") < lo)))
    if hi < end:
        days = calendar.weekdays(spark, hi, end).filter(F.col("trade_date") > hi)
        if days.head(1):
            n += w.upsert("daily_bar", synthetic.bars(stocks, days, latest_states(w.read("daily_bar"))))
            mark = w.read("financial_pit").agg(F.max("ann_date")).first()[0]
            f = w.upsert("financial_pit", after(synthetic.disclosures(stocks, int(hi[:4]), today.year), "ann_date", mark))
            if factors:
                chosen = factor_dates(days)
                populate(w, chosen)
                k = chosen.count()
    late = catch_up(w)
    return {"status": "updated" if n or late else "up_to_date", "new_bars": n, "new_disclosures": f, "new_factor_dates": k + late}


def sampled(days: DataFrame) -> DataFrame:
    """Every fifth date from the 21st, and all after the last of these."""
    return calendar.every(days, 5, start=20, tail="rest")


def on_startup(spark: SparkSession, w: Warehouse, years: float = 5, as_of: date | None = None) -> dict:
    """Empty: two years of sixty stocks. Behind: an ordinary sync. Then dates without factors."""
    today = (as_of or date.today()).strftime("%Y%m%d")
    w.init()
    latest = w.read("daily_bar").agg(F.max("trade_date")).first()[0]
    out = {"status": "up_to_date", "new_bars": 0, "new_disclosures": 0}
    if latest is None:
        out = sync(spark, w, 2, 60, as_of)
    elif latest < today:
        out = sync(spark, w, years, as_of=as_of)
    if late := catch_up(w):
        out["late_factor_dates"] = late
    return out


def sample_load(spark: SparkSession, w: Warehouse, n_stocks: int = 100, start: str = "20220101", end: str = "20241231") -> DataFrame:
    """Synthetic stocks, bars from start to end and disclosures from the year before; row counts."""
    w.init()
    w.upsert("stock_basic", synthetic.universe(spark, n_stocks))
    stocks = w.read("stock_basic")
    w.upsert("daily_bar", synthetic.bars(stocks, calendar.weekdays(spark, start, end)))
    w.upsert("financial_pit", synthetic.disclosures(stocks, int(start[:4]) - 1, int(end[:4])))
    return w.counts()


def landed_load(spark: SparkSession, w: Warehouse, listed: DataFrame, answers: DataFrame, n_stocks: int = 300, pages: DataFrame | None = None, years: tuple[int, int] = (2021, 2026), enough: int = 500) -> DataFrame:
    """Constituents, the landed bars of stocks that have at most ``enough`` bars so far, synthetic
    disclosures, and factors of sampled dates; row counts."""
    w.init()
    stocks = landed.constituents(listed, n_stocks, pages)
    w.upsert("stock_basic", stocks)
    have = w.read("daily_bar").groupBy("ts_code").agg(F.count("*").alias("n")).filter(F.col("n") > enough)
    pending = stocks.select("ts_code").join(have, "ts_code", "left_anti")
    w.upsert("daily_bar", landed.klines(answers.join(pending, "ts_code", "left_semi")))
    w.upsert("financial_pit", synthetic.disclosures(stocks, *years))
    populate(w, sampled(w.read("daily_bar").select("trade_date").distinct()))
    return w.counts()
