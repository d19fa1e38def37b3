"""Holdings, exposures and the HTML report."""

from __future__ import annotations

import base64
import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.features import NAMES


def latest_holdings(factor: DataFrame, basic: DataFrame, masks: DataFrame) -> DataFrame:
    """The last date's factor values with names and tradability; no mask row counts as tradable."""
    last = factor.agg(F.max("trade_date").alias("trade_date"))
    f = factor.join(F.broadcast(last), "trade_date").join(F.broadcast(basic.select("ts_code", "name", "industry")), "ts_code")
    m = masks.select("ts_code", "trade_date", "is_tradable", "filter_reason")
    return f.join(m, ["ts_code", "trade_date"], "left").withColumns({"is_tradable": F.coalesce("is_tradable", F.lit(True)), "filter_reason": F.coalesce("filter_reason", F.lit("OK"))})


def top_bottom(holdings: DataFrame, n_groups: int) -> DataFrame:
    """side (top, bottom), rank within it: floor(n / n_groups) names at either end; none if that is 0."""
    h = holdings.withColumns({
        "lo": F.row_number().over(Window.orderBy("factor_val", "ts_code")), "hi": F.row_number().over(Window.orderBy(F.desc("factor_val"), F.desc("ts_code"))), "n": F.count("*").over(Window.partitionBy()),
    })
    g = F.floor(F.col("n") / n_groups)
    h = h.withColumn("side", F.explode(F.array(F.lit("top"), F.lit("bottom")))).withColumn("rank", F.when(F.col("side") == "top", F.col("hi")).otherwise(F.col("lo")))
    return h.filter(F.col("rank") <= g).drop("lo", "hi", "n")


def exposure(holdings: DataFrame) -> DataFrame:
    return holdings.filter("industry is not null").groupBy("industry").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "industry")


#: Labels of the columns that tables show.
LABELS = {
    "portfolio": "Portfolio", "annual_return": "Annual return %", "annual_volatility": "Annual volatility %", "sharpe_ratio": "Sharpe", "max_drawdown": "Max drawdown %",
    "calmar_ratio": "Calmar", "annual_turnover": "Annual turnover", "final_nav": "Final value", "ts_code": "Code", "name": "Name", "industry": "Industry", "factor_val": "Factor value", "filter_reason": "Tradability",
}


def labelled(df: DataFrame) -> DataFrame:
    """The columns that have a label, under it."""
    return df.select(*[F.col(c).alias(LABELS[c]) for c in df.columns if c in LABELS])


def metrics_table(metrics: DataFrame) -> DataFrame:
    """Metrics as shown, groups in order of their number and the long-short portfolio last."""
    number = F.coalesce(F.expr("try_cast(substring_index(portfolio, '_', -1) as int)"), F.lit(1 << 30))
    return labelled(metrics.orderBy(number))


def available(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(factor_name, the five defaults if the table is empty; trade_date) that the table has."""
    names = metrics.select("factor_name").distinct()
    default = metrics.sparkSession.createDataFrame([(n,) for n in NAMES], "factor_name string")
    none = names.agg(F.count("*").alias("_n")).filter("_n = 0")
    return names.unionByName(default.crossJoin(none).drop("_n")), metrics.select("trade_date").distinct()  # one row or none


def html_report(metrics: DataFrame, factor_name: str, title: str = "Factor report") -> str:
    """A table of the top group, the bottom group and the long-short portfolio: a handful of rows."""
    rows = {r["portfolio"]: r for r in metrics.collect()}
    groups = sorted((int(k.split("_")[1]) for k in rows if k.startswith("Group_")))
    shown = [("Top", rows.get(f"Group_{groups[-1]}")), ("Bottom", rows.get(f"Group_{groups[0]}")), ("Long-short", rows.get("Long_Short"))] if groups else []
    lines = [("Annual return %", "annual_return"), ("Sharpe", "sharpe_ratio"), ("Max drawdown %", "max_drawdown"), ("Final value", "final_nav")]
    head = "".join(f"<th>{n}</th>" for n, _ in shown)
    body = "".join(f"<tr><td>{label}</td>" + "".join(f"<td>{r[c] if r else ''}</td>" for _, r in shown) + "</tr>" for label, c in lines)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}: {html.escape(factor_name)}</h1><table><tr><th></th>{head}</tr>{body}</table></body></html>"


def data_link(page: str, name: str = "report.html") -> str:
    return f'<a download="{html.escape(name)}" href="data:text/html;base64,{base64.b64encode(page.encode()).decode()}">{html.escape(name)}</a>'
