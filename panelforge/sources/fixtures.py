"""Adapters from the star-schema tables to the panel contracts (bars, disclosures, stocks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(c: str):
    return F.concat(F.lpad(F.col(c).cast("string"), 6, "0"), F.lit(".SH"))


def bar_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per supplier and month: the main panel."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    li = li.withColumns({"px": px, "mi": (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1})
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "px")
    b = li.groupBy(F.col("l_suppkey").alias("sk"), "mi").agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"),
        F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("amount"),
    )
    year = F.floor(F.col("mi") / 12)
    return b.select(
        _code("sk").alias("ts_code"),
        F.concat((1995 + year).cast("string"), F.lpad((F.pmod("mi", F.lit(12)) + 1).cast("string"), 2, "0"), F.lit("01")).alias("trade_date"),
        "open", "high", "low", "close",
        F.coalesce(F.lag("close").over(Window.partitionBy("sk").orderBy("mi")), "open").alias("pre_close"),
        F.when((F.col("sk") * 7 + F.col("mi")) % 67 == 0, F.lit(0.0)).otherwise(F.col("q")).alias("vol"),
        "amount", (1 + F.lit(0.05) * year).alias("adj_factor"), (F.col("close") * (1 + F.lit(0.05) * year)).alias("adj_close"),
    )


def bar_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per user and day of the events stream: a short history. Events without a value count
    but set no price."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    at = F.when(F.col("value").isNotNull(), F.struct("ts", "event_id"))
    b = ev.groupBy(F.col("user_id").alias("sk"), F.date_format("ts", "yyyyMMdd").alias("trade_date")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("vol")
    )
    return b.select(_code("sk").alias("ts_code"), "trade_date", "open", "high", "low", "close", "vol", F.col("close").alias("adj_close"))


def pit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly disclosures with late and same-day ones."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax")
    qi = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1
    g = li.groupBy(F.col("l_suppkey").alias("sk"), qi.alias("qi")).agg(
        F.sum(F.col("l_extendedprice") * (F.lit(0.1) - F.col("l_discount") + F.col("l_tax"))).alias("net_profit"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
    )
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sk"), (F.abs("s_acctbal") + 1000).alias("equity"))
    aq = F.when(F.col("qi") % 8 == 3, F.col("qi") + 1).otherwise(F.col("qi"))
    end = lambda q: F.last_day(F.add_months(F.lit("1995-01-01").cast("date"), (q * 3 + 2).cast("int")))
    w = Window.partitionBy("sk").orderBy("qi")
    g = g.join(s, "sk").withColumns({
        "ttm_net_profit": F.sum("net_profit").over(w.rowsBetween(-3, 0)),
        "end_date": F.date_format(end(F.col("qi")), "yyyyMMdd"),
        "ann_date": F.date_format(F.date_add(end(aq), (20 + (F.col("sk") * 13 + aq * 7) % 70).cast("int")), "yyyyMMdd"),
    })
    return g.select(
        _code("sk").alias("ts_code"), "ann_date", "end_date", (F.col("net_profit") / F.col("equity") * 100).alias("roe"),
        "net_profit", "revenue", "ttm_net_profit", (F.col("ttm_net_profit") / F.col("equity") * 100).alias("roe_ttm"), "qi",
    )


def basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        _code("s_suppkey").alias("ts_code"),
        F.when(k % 17 == 0, F.concat(F.lit("*ST"), "s_name")).otherwise(F.col("s_name")).alias("name"),
        F.when(k % 41 != 0, F.concat(F.lit("IND_"), F.col("s_nationkey").cast("string"))).alias("industry"),
        F.when(k % 5 == 0, "19961115").otherwise("19900101").alias("list_date"),
        F.when(k % 19 == 0, 1).otherwise(0).alias("is_st"),
        F.when(k % 10 <= 6, "Main").when(k % 10 <= 8, "ChiNext").otherwise("STAR").alias("market_board"),
    )
