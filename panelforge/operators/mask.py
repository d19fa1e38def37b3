"""Tradability on T with execution locks on T+1, for all pairs of dates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day

REASONS = (("is_st", "ST"), ("is_new", "NewStock"), ("is_suspended_t", "Suspended_T"), ("is_limit_up_next", "LimitUp_BuyBlocked"), ("is_limit_down_next", "LimitDown_SellBlocked"))
COLUMNS = ["ts_code", "trade_date", "industry", "is_tradable", "can_buy", "can_sell", "is_st", "is_new", "is_suspended_t", "is_limit_up_next", "is_limit_down_next", "filter_reason"]


def tradable(dates: DataFrame, basic: DataFrame, bars: DataFrame, min_list_days: int = 120) -> DataFrame:
    """dates: trade_date, next_date (null: no checks on T+1). One row per date and stock."""
    grid = dates.select("trade_date", "next_date").crossJoin(F.broadcast(basic))  # the result's own rows: every date with every stock
    t = bars.select("ts_code", "trade_date", F.col("vol").alias("_vt"))
    n = bars.select("ts_code", F.col("trade_date").alias("next_date"), F.col("vol").alias("_vn"), "open", "high", "low", "pre_close")
    g = grid.join(t, ["ts_code", "trade_date"], "left").join(n, ["ts_code", "next_date"], "left")
    threshold = F.when(F.col("market_board").isin("ChiNext", "STAR"), 0.198).otherwise(0.098)
    idle = lambda v: F.coalesce(F.col(v) <= 0, F.lit(True))
    next_idle = F.col("next_date").isNotNull() & idle("_vn")
    move = F.when(F.col("pre_close") > 0, (F.col("open") - F.col("pre_close")) / F.col("pre_close"))
    open_ = F.col("next_date").isNotNull() & ~next_idle
    no = F.lit(False)
    g = g.withColumns({
        "is_st": F.coalesce(F.col("is_st") != 0, no) | F.coalesce(F.contains("name", F.lit("ST")), no),
        "is_new": F.coalesce(F.datediff(day(F.col("trade_date")), day(F.col("list_date"))) < min_list_days, no),
        "is_suspended_t": idle("_vt"),
        "_idle": next_idle,
        "is_limit_up_next": open_ & F.coalesce((F.col("open") == F.col("high")) & (move >= threshold), no),
        "is_limit_down_next": open_ & F.coalesce((F.col("open") == F.col("low")) & (move <= -threshold), no),
    })
    g = g.withColumn("is_tradable", ~F.col("is_st") & ~F.col("is_new") & ~F.col("is_suspended_t"))
    g = g.withColumns({
        "can_buy": F.col("is_tradable") & ~F.col("_idle") & ~F.col("is_limit_up_next"),
        "can_sell": ~F.col("_idle") & ~F.col("is_limit_down_next"),
        "filter_reason": F.coalesce(F.nullif(F.concat_ws(";", *[F.when(F.col(c), F.lit(r)) for c, r in REASONS]), F.lit("")), F.lit("OK")),
    })
    return g.select(*COLUMNS)
