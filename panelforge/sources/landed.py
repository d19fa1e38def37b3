"""Landed responses of market services: daily bars as nested JSON, constituent lists, scraped pages.

Nothing here fetches; another process lands the answers in a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import industries
from ..functions.scalars import board, exchange_code

#: The answer: by symbol, adjusted bars or plain ones, each a row of texts (date, open, close, high,
#: low, volume, and what else the service adds).
ANSWER = "struct<data: map<string, struct<hfqday: array<array<string>>, day: array<array<string>>>>>"
LIST_DATE = "20100101"


def symbol(ts_code: Column) -> Column:
    """The service's name of a stock: its exchange and the code before the dot."""
    return F.concat(F.when(F.endswith(ts_code, F.lit(".SH")), F.lit("sh")).otherwise(F.lit("sz")), F.substring_index(ts_code, ".", 1))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """ts_code, part, body of files named <ts_code>_<part>.json, each a whole answer."""
    t = spark.read.option("wholetext", True).text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)_(\d+)\.json$", 1).alias("ts_code"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)_(\d+)\.json$", 2).alias("part"))
    return t.filter("ts_code <> ''").select("ts_code", F.col("part").cast("int").alias("part"), F.col("value").alias("body"))


def klines(answers: DataFrame) -> DataFrame:
    """Bars of (ts_code, part, body): adjusted bars where the answer has them, else plain ones; the
    parts of a stock in their order, of a date the first to come. The previous close is the row
    before's (the own open in the first row). Answers that are no JSON, or lack the stock, give none."""
    one = F.try_element_at(F.from_json("body", ANSWER)["data"], symbol(F.col("ts_code")))
    a = answers.withColumn("_one", one)
    a = a.select("ts_code", "part", F.posexplode(F.coalesce("_one.hfqday", "_one.day")).alias("at", "row"))
    w = Window.partitionBy("ts_code", "trade_date").orderBy("part", "at")
    a = a.withColumn("trade_date", F.replace(F.col("row")[0], F.lit("-"), F.lit(""))).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    # rows follow each other as they came, which is by date unless the service says otherwise
    num = {c: F.get("row", F.lit(i)).cast("double") for i, c in enumerate(("open", "close", "high", "low", "vol"), 1)}
    a = a.withColumns(num)
    pre = F.coalesce(F.lag("close").over(Window.partitionBy("ts_code").orderBy("part", "at")), "open")
    amount = F.rint(F.col("vol") * ((F.col("open") + F.col("close")) / 2) * 100 * 100) / 100
    return a.select("ts_code", "trade_date", "open", "high", "low", "close", pre.alias("pre_close"), "vol", amount.alias("amount"), F.lit(1.0).alias("adj_factor"), F.col("close").alias("adj_close"))


def constituents(listed: DataFrame, n: int, pages: DataFrame | None = None) -> DataFrame:
    """listed: at (place in the list), code, name, exchange. The first n as stocks: padded code with
    its exchange, industry by name, page or the catch-all, a fixed listing date, special treatment
    and board. pages: ts_code, html."""
    first = listed.orderBy("at").limit(n)
    s = first.select(
        exchange_code(F.col("code").cast("string"), F.col("exchange")).alias("ts_code"), "name", F.lit(LIST_DATE).alias("list_date"),
        F.coalesce(F.contains("name", F.lit("ST")), F.lit(False)).cast("int").alias("is_st"), board(F.col("code").cast("string"), F.col("exchange")).alias("market_board"),
    )
    scraped = None if pages is None else pages.select("ts_code", industries.scraped(F.col("html")).alias("sub_industry"))
    return industries.resolve(s, scraped).select("ts_code", "name", "industry", "list_date", "is_st", "market_board")
