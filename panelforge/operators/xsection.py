"""Robust statistics of a cross-section, as windows over its keys: one shuffle for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.industries import OTHER

KEYS = ["trade_date", "factor_name"]


def winsorize_mad(df: DataFrame, col: str, out: str, keys: list[str] = KEYS, n: float = 3.0) -> DataFrame:
    """Clip to the median plus or minus n * 1.4826 * MAD; unchanged where the MAD vanishes."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_med", F.median(col).over(w)).withColumn("_mad", F.median(F.abs(F.col(col) - F.col("_med"))).over(w))
    span = F.lit(n * 1.4826) * F.col("_mad")
    x = F.when(F.col("_mad") < 1e-12, F.col(col)).otherwise(F.least(F.greatest(F.col(col), F.col("_med") - span), F.col("_med") + span))
    return df.withColumn(out, x).drop("_med", "_mad")


def zscore(df: DataFrame, col: str, out: str, keys: list[str] = KEYS) -> DataFrame:
    """Population z-score; zero where the deviation vanishes."""
    w = Window.partitionBy(*keys)
    s = F.stddev_pop(col).over(w)
    return df.withColumns({"_m": F.avg(col).over(w), "_s": s}).withColumn(out, F.when(F.col("_s") < 1e-12, 0.0).otherwise(F.try_divide(F.col(col) - F.col("_m"), F.col("_s")))).drop("_m", "_s")


def neutralize(df: DataFrame, col: str, out: str, keys: list[str] = KEYS, industries: tuple | None = None, min_n: int = 5) -> DataFrame:
    """Residual of a regression on industry dummies and log market value, without intercept.

    By the Frisch-Waugh-Lovell theorem the dummies drop out once both sides are demeaned within the
    industry, so one slope by cross-section is left: windows, no matrix. Industries outside the list
    count as the catch-all. Fewer than min_n rows are left as they are."""
    ind = F.col("industry") if industries is None else F.when(F.col("industry").isin(*industries), F.col("industry")).otherwise(OTHER)
    df = df.withColumns({"_ind": ind, "_lm": F.ln(F.greatest(F.col("total_mv"), F.lit(1.0)))})
    wi, w = Window.partitionBy(*keys, "_ind"), Window.partitionBy(*keys)
    df = df.withColumns({"_y": F.col(col) - F.avg(col).over(wi), "_x": F.col("_lm") - F.avg("_lm").over(wi)})
    df = df.withColumns({"_xx": F.sum(F.col("_x") * F.col("_x")).over(w), "_xy": F.sum(F.col("_x") * F.col("_y")).over(w), "_ll": F.sum(F.col("_lm") * F.col("_lm")).over(w), "_n": F.count("*").over(w)})
    b = F.when(F.col("_xx") > F.lit(1e-18) * F.col("_ll"), F.try_divide(F.col("_xy"), F.col("_xx"))).otherwise(0.0)
    return df.withColumn(out, F.when(F.col("_n") < min_n, F.col(col)).otherwise(F.col("_y") - b * F.col("_x"))).drop("_ind", "_lm", "_y", "_x", "_xx", "_xy", "_ll", "_n")


def clean(df: DataFrame, keys: list[str] = KEYS, industries: tuple | None = None) -> DataFrame:
    """raw_val -> clean_val: winsorise, z-score, neutralise, z-score. Rows without a value, an
    industry or a market value go; cross-sections of fewer than five keep raw_val."""
    df = df.filter("raw_val is not null and not isnan(raw_val) and industry is not null and total_mv is not null and not isnan(total_mv)")
    w = Window.partitionBy(*keys)
    df = zscore(winsorize_mad(df, "raw_val", "_w", keys), "_w", "_z", keys)
    df = neutralize(df, "_z", "_r", keys, industries).withColumns({"_n": F.count("*").over(w), "_sd": F.stddev_pop("_r").over(w)})
    df = zscore(df, "_r", "_rz", keys)
    return df.withColumn("clean_val", F.when(F.col("_n") < 5, F.col("raw_val")).when(F.col("_sd") > 1e-4, F.col("_rz")).otherwise(F.col("_z"))).drop("_w", "_z", "_r", "_n", "_sd", "_rz")


def average_rank(df: DataFrame, col: str, out: str, keys: list[str]) -> DataFrame:
    """Ranks from 1, ties sharing the mean of theirs."""
    r = F.rank().over(Window.partitionBy(*keys).orderBy(col))
    return df.withColumn(out, r + (F.count("*").over(Window.partitionBy(*keys, col)) - 1) / 2)


def spearman(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """keys, n, corr: Pearson's correlation of average ranks, null for a constant side."""
    r = average_rank(average_rank(df, a, "_ra", keys), b, "_rb", keys)
    corr = F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb"))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), corr.alias("corr"))
