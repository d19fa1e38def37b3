"""Quantile backtest with carried positions, turnover, fees and path metrics.

Everything is set-based but the weights: a position that can't be sold keeps its weight, and what
is left for new positions depends on it, a recursion over periods. Groups are independent, so each
folds its periods in one JVM expression: its arrays hold the codes of one group in every period, so
a group's history is bounded by listed stocks / groups x rebalance periods.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quantise
from ..sources.scratch import written
from . import calendar, mask
from .features import scan
from .xsection import spearman


def members(factor: DataFrame, sched: DataFrame, masks: DataFrame, n_groups: int) -> DataFrame:
    """period, grp, ts_code, can_buy. Groups are equal counts of the tradable names in order of the
    factor (ties by code), the remainder in the last; periods with fewer names than groups go and
    the others are numbered anew."""
    m = masks.filter("is_tradable").select("trade_date", "ts_code", "can_buy")
    v = factor.filter("factor_val is not null").join(F.broadcast(sched), "trade_date").join(m, ["trade_date", "ts_code"])
    w = Window.partitionBy("period")
    v = v.withColumns({"rn": F.row_number().over(w.orderBy("factor_val", "ts_code")), "n": F.count("*").over(w)}).filter(F.col("n") >= n_groups)
    g = F.least(F.floor((F.col("rn") - 1) / F.floor(F.col("n") / n_groups)) + 1, F.lit(n_groups)).cast("int")
    return v.withColumn("grp", g).select("period", "trade_date", "entry_date", "exit_date", "grp", "ts_code", "can_buy")


def renumber(mem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(periods: p, period, dates; members with p)."""
    p = mem.select("period", "trade_date", "entry_date", "exit_date").distinct()
    p = p.withColumn("p", F.row_number().over(Window.orderBy("period")))
    return p, mem.join(F.broadcast(p.select("period", "p")), "period")


_STEP = """aggregate(ps,
  named_struct('w', cast(map() as map<string,double>), 'h', cast(array() as array<struct<p:int,w:map<string,double>>>)),
  (acc, e) -> transform(array(map_filter(acc.w, (k, v) -> not array_contains(e.codes, k) and array_contains(e.blocked, k))),
    car -> transform(array(greatest(0D, 1D - aggregate(map_values(car), 0D, (a, x) -> a + x))),
      rem -> transform(array(
        case when size(e.buy) > 0 and rem > 0 then map_concat(car, map_from_arrays(e.buy, transform(e.buy, c -> rem / size(e.buy))))
             when size(car) = 0 then map_from_arrays(e.codes, transform(e.codes, c -> 1D / size(e.codes)))
             else car end),
        nw -> named_struct('w', nw, 'h', concat(acc.h, array(named_struct('p', e.p, 'w', nw)))))[0])[0])[0],
  acc -> acc.h)"""


def weights(mem: DataFrame, masks: DataFrame, periods: DataFrame) -> DataFrame:
    """p, grp, ts_code, weight after each rebalance."""
    t = mem.groupBy("grp", "p").agg(F.sort_array(F.collect_list("ts_code")).alias("codes"), F.sort_array(F.collect_list(F.when(F.col("can_buy"), F.col("ts_code")))).alias("buy"))
    b = masks.filter("not can_sell").join(F.broadcast(periods.select("trade_date", "p")), "trade_date").groupBy("p").agg(F.sort_array(F.collect_list("ts_code")).alias("blocked"))
    t = t.join(b, "p", "left").withColumn("blocked", F.coalesce("blocked", F.array().cast("array<string>")))
    f = t.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("p", "codes", "buy", "blocked"))).alias("ps"))
    h = f.select("grp", F.explode(F.expr(_STEP)).alias("h"))
    return h.select(F.col("h.p").alias("p"), "grp", F.explode("h.w").alias("ts_code", "weight"))


def turnover(w: DataFrame, mem: DataFrame) -> DataFrame:
    """p, grp, turnover: half the sum of absolute changes; the first period starts from nothing."""
    old = w.select((F.col("p") + 1).alias("p"), "grp", "ts_code", F.col("weight").alias("old"))
    j = w.join(old, ["p", "grp", "ts_code"], "full_outer")
    s = j.groupBy("p", "grp").agg((0.5 * F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).alias("turnover"))
    return mem.select("p", "grp").distinct().join(s, ["p", "grp"])


def asset_returns(w: DataFrame, periods: DataFrame, bars: DataFrame) -> DataFrame:
    """p, grp, ts_code, weight, ret of the holdings that have both prices."""
    px = bars.select("ts_code", "trade_date", "adj_close")
    a = px.select("ts_code", F.col("trade_date").alias("entry_date"), F.col("adj_close").alias("p0"))
    b = px.select("ts_code", F.col("trade_date").alias("exit_date"), F.col("adj_close").alias("p1"))
    j = w.join(F.broadcast(periods.select("p", "entry_date", "exit_date")), "p").join(a, ["ts_code", "entry_date"]).join(b, ["ts_code", "exit_date"])
    return j.filter("p0 > 0 and p1 is not null").select("p", "grp", "ts_code", "weight", ((F.col("p1") - F.col("p0")) / F.col("p0")).alias("ret"))


def period_returns(rets: DataFrame, turns: DataFrame, periods: DataFrame, fee: float) -> DataFrame:
    """p, grp, exit_date, gross, turnover, net."""
    g = rets.groupBy("p", "grp").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"))
    r = turns.join(g, ["p", "grp"], "left").withColumn("gross", F.coalesce("gross", F.lit(0.0)))
    r = r.withColumn("net", F.col("gross") - F.lit(fee) * F.col("turnover"))
    return r.join(F.broadcast(periods.select("p", "exit_date")), "p").select("p", "grp", "exit_date", "gross", "turnover", "net")


def nav(returns: DataFrame) -> DataFrame:
    """p, grp, exit_date, nav; period 0 is 1.0 with a null date."""
    w = Window.partitionBy("grp").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    n = returns.withColumn("nav", F.product(1 + F.col("net")).over(w)).select("p", "grp", "exit_date", "nav")
    zero = returns.select(F.lit(0).alias("p"), "grp", F.lit(None).cast("string").alias("exit_date"), F.lit(1.0).alias("nav")).distinct()
    return zero.unionByName(n)


def benchmark(rets: DataFrame, periods: DataFrame) -> DataFrame:
    """p, exit_date, bench_ret, bench_nav: mean return over all holdings of all groups."""
    b = periods.select("p", "exit_date").join(rets.groupBy("p").agg(F.avg("ret").alias("bench_ret")), "p", "left").withColumn("bench_ret", F.coalesce("bench_ret", F.lit(0.0)))
    return b.withColumn("bench_nav", F.product(1 + F.col("bench_ret")).over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))


def long_short(navs: DataFrame, n_groups: int) -> DataFrame:
    """p, exit_date, nav (top over bottom), ret."""
    top = navs.filter(F.col("grp") == n_groups).select("p", "exit_date", F.col("nav").alias("t"))
    low = navs.filter("grp = 1").select("p", F.col("nav").alias("b"))
    j = top.join(low, "p").select("p", "exit_date", (F.col("t") / F.col("b")).alias("nav"))
    return j.withColumn("ret", F.col("nav") / F.lag("nav").over(Window.orderBy("p")) - 1)


def metrics(navs: DataFrame, turns: DataFrame, ls: DataFrame, interval: int, risk_free: float = 0.02) -> DataFrame:
    """portfolio, annual_return, annual_volatility, sharpe_ratio, max_drawdown, calmar_ratio,
    annual_turnover (null for Long_Short), final_nav."""
    af = 252.0 / interval
    label = F.concat(F.lit("Group_"), F.col("grp").cast("string"))
    both = navs.select(label.alias("portfolio"), "p", "nav").unionByName(ls.select(F.lit("Long_Short").alias("portfolio"), "p", "nav"))
    w = Window.partitionBy("portfolio").orderBy("p")
    top = F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"r": F.col("nav") / F.lag("nav").over(w) - 1, "dd": (F.col("nav") - top) / top})
    s = both.groupBy("portfolio").agg(F.max_by("nav", "p").alias("nav"), F.count("r").alias("n"), F.stddev_pop("r").alias("sd"), F.min("dd").alias("dd"))
    t = turns.groupBy(label.alias("portfolio")).agg((F.avg("turnover") * af).alias("turn"))
    s = s.join(t, "portfolio", "left").withColumns({
        "ret": F.when(F.col("n") > 0, F.pow(F.col("nav"), F.lit(af) / F.greatest(F.col("n"), F.lit(1))) - 1).otherwise(0.0),
        "vol": F.coalesce(F.col("sd") * F.sqrt(F.lit(af)), F.lit(0.0)), "mdd": quantise(F.col("dd"), 4),
    })
    excess = F.col("ret") - F.when(F.col("portfolio") == "Long_Short", 0.0).otherwise(risk_free)
    return s.select(
        "portfolio", quantise(F.col("ret") * 100, 2).alias("annual_return"), quantise(F.col("vol") * 100, 2).alias("annual_volatility"),
        F.when(F.col("vol") > 1e-6, quantise(F.try_divide(excess, F.col("vol")), 3)).otherwise(0.0).alias("sharpe_ratio"), quantise(F.col("mdd") * 100, 2).alias("max_drawdown"),
        F.when(F.abs("mdd") > 1e-6, quantise(F.abs(F.try_divide(F.col("ret"), F.col("mdd"))), 3)).otherwise(0.0).alias("calmar_ratio"),
        quantise(F.col("turn"), 2).alias("annual_turnover"), quantise(F.col("nav"), 4).alias("final_nav"),
    )


def monotonicity(navs: DataFrame) -> DataFrame:
    """One row: rank correlation of the group numbers and their final values to four places."""
    f = navs.groupBy("grp").agg(quantise(F.max_by("nav", "p"), 4).alias("final_nav")).withColumn("k", F.lit(1))
    return spearman(f, "grp", "final_nav", ["k"]).select(quantise(F.col("corr"), 3).alias("monotonicity"))


def heatmap(ls: DataFrame) -> DataFrame:
    """year, month, ret: compounded long-short returns in percent, by exit date."""
    h = ls.filter("ret is not null").groupBy(F.substring("exit_date", 1, 4).alias("year"), F.substring("exit_date", 5, 2).alias("month"))
    return h.agg(quantise((F.product(1 + F.col("ret")) - 1) * 100, 2).alias("ret"))


class Backtest:
    """The stages of one run. Each is computed when it is first used; those that several others read
    (a row per period, per period and member, per period and holding) are written once to the shared
    folder, so the plans of the others stay as small as they look.

    factor: trade_date, ts_code, factor_val, as ``features.scan`` gives it."""

    def __init__(self, factor: DataFrame, bars: DataFrame, basic: DataFrame, n_groups: int = 10, interval: int = 5, fee: float = 0.001) -> None:
        self.bars, self.basic = bars, basic
        self.n_groups, self.interval, self.fee = n_groups, interval, fee
        self._factor = factor

    @classmethod
    def of_factor(cls, metrics: DataFrame, bars: DataFrame, basic: DataFrame, name: str, start: str | None = None, end: str | None = None, use_clean: bool = True, **how) -> Backtest:
        """Of a stored factor between two dates, by its clean or raw values; all prices count."""
        return cls(scan(metrics, name, start, end, use_clean), bars, basic, **how)

    @cached_property
    def factor(self) -> DataFrame:
        return written(self._factor.select("trade_date", "ts_code", "factor_val"), "bt_factor")

    @cached_property
    def schedule(self) -> DataFrame:
        return written(calendar.schedule(self.factor, calendar.index(self.bars), self.interval), "bt_schedule")

    @cached_property
    def masks(self) -> DataFrame:
        dates = self.schedule.select("trade_date", F.col("entry_date").alias("next_date"))
        return written(mask.tradable(dates, self.basic, self.bars).select("trade_date", "ts_code", "is_tradable", "can_buy", "can_sell"), "bt_masks")

    @cached_property
    def _numbered(self) -> tuple[DataFrame, DataFrame]:
        mem = written(members(self.factor, self.schedule, self.masks, self.n_groups), "bt_members")
        periods, mem = renumber(mem)
        return written(periods, "bt_periods"), mem

    @property
    def periods(self) -> DataFrame:
        return self._numbered[0]

    @cached_property
    def members(self) -> DataFrame:
        self.periods  # noqa: B018  the numbers come from the table just written
        return written(self._numbered[1], "bt_numbered")

    @cached_property
    def weights(self) -> DataFrame:
        return written(weights(self.members, self.masks, self.periods), "bt_weights")

    @cached_property
    def turnover(self) -> DataFrame:
        return written(turnover(self.weights, self.members), "bt_turnover")

    @cached_property
    def asset_returns(self) -> DataFrame:
        return written(asset_returns(self.weights, self.periods, self.bars), "bt_asset_returns")

    @cached_property
    def returns(self) -> DataFrame:
        return written(period_returns(self.asset_returns, self.turnover, self.periods, self.fee), "bt_returns")

    @cached_property
    def nav(self) -> DataFrame:
        return nav(self.returns)

    @property
    def benchmark(self) -> DataFrame:
        return benchmark(self.asset_returns, self.periods)

    @cached_property
    def long_short(self) -> DataFrame:
        return long_short(self.nav, self.n_groups)

    @property
    def metrics(self) -> DataFrame:
        return metrics(self.nav, self.turnover, self.long_short, self.interval)

    @property
    def monotonicity(self) -> DataFrame:
        return monotonicity(self.nav)

    @property
    def heatmap(self) -> DataFrame:
        return heatmap(self.long_short)
