"""Synthetic universe, bars and disclosures, seeded by the stock's code: reruns agree."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.industries import INDUSTRIES

BARS = "ts_code string, trade_date string, open double, high double, low double, close double, pre_close double, vol double, amount double, adj_factor double, adj_close double"


def universe(spark: SparkSession, n: int = 100) -> DataFrame:
    """70 % Main, 18 % ChiNext, 12 % STAR; industries in turn; two special-treatment names."""
    i = F.col("i")
    main, chi = int(n * 0.7), int(n * 0.88)
    code = F.when(i <= main, F.format_string("60%04d.SH", i)).when(i <= chi, F.format_string("30%04d.SZ", i)).otherwise(F.format_string("68%04d.SH", i))
    st = i.isin(7, 33)
    return spark.range(1, n + 1).withColumnRenamed("id", "i").select(
        code.alias("ts_code"), F.concat(F.when(st, "ST").otherwise(""), F.format_string("Stock%04d", i)).alias("name"),
        F.element_at(F.array(*map(F.lit, INDUSTRIES)), ((i - 1) % len(INDUSTRIES) + 1).cast("int")).alias("industry"),
        F.date_format(F.add_months(F.lit("2015-01-01").cast("date"), (i % 12 * 9).cast("int")), "yyyyMMdd").alias("list_date"),
        st.cast("int").alias("is_st"), F.when(i <= main, "Main").when(i <= chi, "ChiNext").otherwise("STAR").alias("market_board"),
    )


def bars(stocks: DataFrame, dates: DataFrame, state: DataFrame | None = None, seed: str = "bars") -> DataFrame:
    """A random walk per stock with suspensions, one-word limits and, on every 200th date, a dividend
    that raises the adjustment factor; from the listing on. Test data: the walk depends on its path and
    is made row by row in Python, a stock to a row. state: ts_code, close, adj_factor to resume from."""
    if state is None:
        s = stocks.withColumns({"last_close": F.lit(None).cast("double"), "last_adj": F.lit(None).cast("double")})
    else:
        s = stocks.join(state.select("ts_code", F.col("close").alias("last_close"), F.col("adj_factor").alias("last_adj")), "ts_code", "left")
    s = s.crossJoin(F.broadcast(dates.agg(F.sort_array(F.collect_set("trade_date")).alias("days"))))  # one row: the calendar

    def walk(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                days = [(k, d) for k, d in enumerate(r.days) if d >= r.list_date]
                rng = np.random.default_rng(zlib.crc32(f"{seed}|{r.ts_code}|{days[0][1] if days else ''}".encode()))
                close = r.last_close if pd.notna(r.last_close) and r.last_close else 8.0 + zlib.crc32(r.ts_code.encode()) % 90
                adj = r.last_adj if pd.notna(r.last_adj) and r.last_adj else 1.0
                limit = 0.20 if r.market_board in ("ChiNext", "STAR") else 0.10
                for k, d in days:
                    pre, u, vol = round(close, 2), rng.random(), float(int(rng.uniform(5e4, 5e6)))
                    if k and k % 200 == 0:
                        adj = round(adj * pre / max(1.0, pre - round(rng.uniform(0.5, 1.5), 2)), 4)
                    if u < 0.015 and not r.is_st:
                        o = h = lo = close = pre
                        vol = 0.0
                    elif u < 0.023:
                        o = h = lo = close = round(pre * (1 + limit), 2)
                    elif u < 0.027:
                        o = h = lo = close = round(pre * (1 - limit), 2)
                    else:
                        close = max(0.5, round(pre * (1 + float(np.clip(rng.normal(0.0003, 0.018), -limit, limit))), 2))
                        o = round(pre * (1 + rng.normal(0, 0.004)), 2)
                        h, lo = max(o, close) * (1 + abs(rng.normal(0, 0.004))), min(o, close) * (1 - abs(rng.normal(0, 0.004)))
                    out.append((r.ts_code, d, o, h, lo, close, pre, vol, round(vol * (o + close) / 2 * 100, 2), adj, round(close * adj, 4)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BARS.split(", ")])

    return s.select("ts_code", "list_date", "is_st", "market_board", "last_close", "last_adj", "days").repartition("ts_code").mapInPandas(walk, BARS)


def disclosures(stocks: DataFrame, first_year: int, last_year: int, min_ann_date: str | None = None) -> DataFrame:
    """Quarterly: cumulative profit within the year, trailing sum of four quarters (scaled up where
    there are fewer), announced one to three months after the quarter's end."""
    q = stocks.select("ts_code").withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year)))).withColumn("q", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    h = F.pmod(F.xxhash64("ts_code", "year", "q"), F.lit(10_000)) / 10_000.0
    size = F.pmod(F.xxhash64("ts_code"), F.lit(1000)) * 1e6 + 1e8
    q = q.withColumns({"profit": size * (0.6 + 0.8 * h), "end": F.last_day(F.make_date("year", F.col("q") * 3, F.lit(1))), "equity": size * 12})
    w = Window.partitionBy("ts_code").orderBy("end")
    q = q.withColumns({
        "net_profit": F.sum("profit").over(Window.partitionBy("ts_code", "year").orderBy("q")),
        "ttm_net_profit": F.sum("profit").over(w.rowsBetween(-3, 0)) * 4 / F.count("*").over(w.rowsBetween(-3, 0)),
        "ann_date": F.date_format(F.date_add("end", (25 + F.pmod(F.xxhash64("ts_code", "end"), F.lit(60))).cast("int")), "yyyyMMdd"),
        "end_date": F.date_format("end", "yyyyMMdd"),
    })
    out = q.select("ts_code", "ann_date", "end_date", (F.col("net_profit") / F.col("equity") * 100).alias("roe"), "net_profit", (F.col("net_profit") * 8).alias("revenue"), "ttm_net_profit", (F.col("ttm_net_profit") / F.col("equity") * 100).alias("roe_ttm"))
    return out.filter(F.col("ann_date") > min_ann_date) if min_ann_date else out
