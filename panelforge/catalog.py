"""Registered queries and the independent SQL they are held against."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import industries, scalars
from .functions.scalars import quantise as q
from .operators import backtest, calendar, features, ic, mask, pit, xsection
from .oracles import sql
from .plans import report, sync
from .sources import fixtures, landed, scratch, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LAGS = (1, 5)
_SAMPLES = ("招商银行", "中信证券", "贵州茅台", "宁德时代", "比亚迪", "北京文化", "中国建筑", "顺丰控股", "未知公司", "三一重工")
GROUPS, INTERVAL, FEE = 5, 3, 0.001


def query(oracle: str | None = None, **more: str):
    """Register a function under its name, with its SQL; more: named expressions of the SQL that
    differ from the common ones."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, **more)
        return f

    return add


def _q(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: q(F.col(c), places) for c in cols})


def _bars(s, d):
    return fixtures.bar_m(s, d)


def _factors(s, d, names=features.NAMES) -> DataFrame:
    return features.factor_metrics(fixtures.bar_m(s, d), fixtures.basic(s, d), fixtures.pit_q(s, d), names)


def _mom(s, d) -> DataFrame:
    f = _factors(s, d, ("MOM_20D",))
    return f.select("trade_date", "ts_code", q(F.col("clean_val")).alias("factor_val"))


def _backtest(s, d) -> backtest.Backtest:
    return backtest.Backtest(_mom(s, d), fixtures.bar_m(s, d), fixtures.basic(s, d), GROUPS, INTERVAL, FEE)


# --- scans, counts, watermarks -------------------------------------------------------------------


@query("select ts_code, trade_date, q6(open) as open, q6(high) as high, q6(low) as low, q6(close) as close, q6(pre_close) as pre_close, vol, q6(amount) as amount, q6(adj_close) as adj_close from bar_m")
def bar_panel(s, d):
    return _q(_bars(s, d), "open", "high", "low", "close", "pre_close", "amount", "adj_close").drop("adj_factor")


@query("select max(trade_date) as trade_date from bar_m")
def scan_latest_date(s, d):
    return _bars(s, d).agg(F.max("trade_date").alias("trade_date"))


@query("select min(trade_date) as trade_date from bar_m")
def scan_earliest_date(s, d):
    return _bars(s, d).agg(F.min("trade_date").alias("trade_date"))


@query("select max(ann_date) as ann_date from pit_q")
def max_ann_date(s, d):
    return fixtures.pit_q(s, d).agg(F.max("ann_date").alias("ann_date"))


@query("select count(*) as n_rows, max(trade_date) as latest from factors")
def factor_state(s, d):
    return _factors(s, d).agg(F.count("*").alias("n_rows"), F.max("trade_date").alias("latest"))


@query("select 'daily_bar' as table_name, count(*) as n_rows from bar_m union all select 'financial_pit', count(*) from pit_q union all select 'stock_basic', count(*) from basic")
def table_counts(s, d):
    return tables.count_rows({"daily_bar": _bars(s, d), "financial_pit": fixtures.pit_q(s, d), "stock_basic": fixtures.basic(s, d)})


@query("select ts_code, max(trade_date) as trade_date, q6(coalesce(nullif(arg_max(close, trade_date), 0), 10.0)) as close, coalesce(nullif(arg_max(adj_factor, trade_date), 0), 1.0) as adj_factor from bar_m group by ts_code")
def stock_latest_state(s, d):
    return _q(sync.latest_states(_bars(s, d)), "close")


@query("select ts_code, trade_date, q6(adj_close) as adj_close from bar_m where trade_date >= (select min(trade_date) from (select distinct trade_date from bar_m where trade_date <= '19991201' order by 1 desc limit 30)) and trade_date <= '19991201'")
def historical_bars_lookback(s, d):
    b = _bars(s, d).filter(F.col("trade_date") <= "19991201")
    first = b.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(30).agg(F.min("trade_date").alias("first"))
    return _q(b.crossJoin(F.broadcast(first)).filter("trade_date >= first").select("ts_code", "trade_date", "adj_close"), "adj_close")  # one row: the first date


@query("select ts_code, count(*) as n from bar_d group by ts_code having count(*) > 25")
def having_count(s, d):
    return fixtures.bar_d(s, d).groupBy("ts_code").agg(F.count("*").alias("n")).filter("n > 25")


@query("select b.ts_code from (select distinct ts_code from bar_d) b where not exists (select 1 from bar_d x where x.ts_code = b.ts_code group by x.ts_code having count(*) > 25)")
def pending_anti_join(s, d):
    b = fixtures.bar_d(s, d)
    return b.select("ts_code").distinct().join(having_count(s, d), "ts_code", "left_anti")


@query("select trade_date, idx, next_date from cal")
def calendar_index(s, d):
    return calendar.index(_bars(s, d))


@query("select strftime(d, '%Y%m%d') as trade_date from generate_series(date '2022-01-01', date '2024-12-31', interval 1 day) t(d) where isodow(d) < 6")
def weekday_calendar(s, d):
    return calendar.weekdays(s, "20220101", "20241231")


# --- disclosures ---------------------------------------------------------------------------------


@query("select ts_code, ann_date, end_date, q6(ttm_net_profit) as ttm_net_profit, q6(roe_ttm) as roe_ttm from pit_q where ann_date <= '19980801' qualify row_number() over (partition by ts_code order by ann_date desc, end_date desc) = 1")
def pit_snapshot(s, d):
    return _q(pit.snapshot(fixtures.pit_q(s, d), "19980801").select("ts_code", "ann_date", "end_date", "ttm_net_profit", "roe_ttm"), "ttm_net_profit", "roe_ttm")


@query("select ts_code, trade_date, ann_date, end_date, q6(ttm_net_profit) as ttm_net_profit, q6(roe_ttm) as roe_ttm from known")
def pit_asof_all(s, d):
    j = pit.as_of(_bars(s, d).select("ts_code", "trade_date"), fixtures.pit_q(s, d), ["end_date", "ttm_net_profit", "roe_ttm"])
    return _q(j, "ttm_net_profit", "roe_ttm")


@query("select ts_code, end_date, q6(sum(net_profit) over (partition by ts_code, left(end_date, 4) order by qi)) as ytd_profit from pit_q")
def pit_ytd_cumulative(s, d):
    w = Window.partitionBy("ts_code", F.substring("end_date", 1, 4)).orderBy("qi")
    return fixtures.pit_q(s, d).select("ts_code", "end_date", q(F.sum("net_profit").over(w)).alias("ytd_profit"))


@query("select ts_code, end_date, q6(sum(net_profit) over (partition by ts_code order by qi rows 3 preceding)) as ttm, q6(roe_ttm) as roe_ttm from pit_q")
def pit_ttm(s, d):
    return fixtures.pit_q(s, d).select("ts_code", "end_date", q(F.col("ttm_net_profit")).alias("ttm"), q(F.col("roe_ttm")).alias("roe_ttm"))


# --- tradability ---------------------------------------------------------------------------------


def _masks(s, d) -> DataFrame:
    cal = calendar.index(_bars(s, d)).filter("next_date is not null")
    return mask.tradable(cal, fixtures.basic(s, d), _bars(s, d))


@query("select ts_code, trade_date, industry, is_tradable, can_buy, can_sell, is_st, is_new, is_suspended_t, is_limit_up_next, is_limit_down_next, filter_reason from mask")
def tradable_mask(s, d):
    return _masks(s, d)


@query("select filter_reason, count(*) as n from mask group by filter_reason")
def mask_reason_counts(s, d):
    return _masks(s, d).groupBy("filter_reason").agg(F.count("*").alias("n"))


# --- factors -------------------------------------------------------------------------------------


@query("select ts_code, trade_date, q6(daily_ret) as daily_ret from feat")
def daily_returns(s, d):
    return _q(features.price_features(_bars(s, d)).select("ts_code", "trade_date", "daily_ret"), "daily_ret")


@query("select ts_code, trade_date, q6(mom_20) as mom_20 from feat where mom_20 is not null")
def mom_20(s, d):
    return _q(features.price_features(_bars(s, d)).filter("mom_20 is not null").select("ts_code", "trade_date", "mom_20"), "mom_20")


@query("select ts_code, trade_date, q6(rev_5) as rev_5 from feat where rev_5 is not null")
def rev_5(s, d):
    return _q(features.price_features(_bars(s, d)).filter("rev_5 is not null").select("ts_code", "trade_date", "rev_5"), "rev_5")


@query("select ts_code, trade_date, q6(adj_close / lag(adj_close, 4) over (partition by ts_code order by trade_date) - 1) as rev_5 from bar_d qualify rev_5 is not null and count(*) over (partition by ts_code order by idx_d range between 29 preceding and current row) >= 5")
def rev_5_daily(s, d):
    return _q(features.price_features(fixtures.bar_d(s, d)).filter("rev_5 is not null").select("ts_code", "trade_date", "rev_5"), "rev_5")


@query("select ts_code, trade_date, q6(vol_20) as vol_20 from feat where vol_20 is not null")
def vol_20(s, d):
    return _q(features.price_features(_bars(s, d)).filter("vol_20 is not null").select("ts_code", "trade_date", "vol_20"), "vol_20")


@query("select ts_code, trade_date, round_even(raw_val * 1e12, 0) / 1e12 as ep_ttm from raw where factor_name = 'EP_TTM'")
def ep_ttm(s, d):
    f = features.raw_factors(_bars(s, d), fixtures.basic(s, d), fixtures.pit_q(s, d)).filter("factor_name = 'EP_TTM'")
    return f.select("ts_code", "trade_date", q(F.col("raw_val"), 12).alias("ep_ttm"))


@query("select ts_code, trade_date, q6(raw_val) as roe_ttm from raw where factor_name = 'ROE_TTM'")
def roe_ttm(s, d):
    f = features.raw_factors(_bars(s, d), fixtures.basic(s, d), fixtures.pit_q(s, d)).filter("factor_name = 'ROE_TTM'")
    return f.select("ts_code", "trade_date", q(F.col("raw_val")).alias("roe_ttm"))


@query("select ts_code, trade_date, floor(total_mv + 0.5) as total_mv from feat")
def total_mv(s, d):
    return features.price_features(_bars(s, d)).select("ts_code", "trade_date", F.floor(F.col("total_mv") + 0.5).cast("double").alias("total_mv"))


@query("select trade_date, ts_code, factor_name, q6(raw_val) as raw_val, industry, floor(total_mv + 0.5) as total_mv from raw")
def factors_long(s, d):
    f = features.raw_factors(_bars(s, d), fixtures.basic(s, d), fixtures.pit_q(s, d))
    return _q(f, "raw_val").withColumn("total_mv", F.floor(F.col("total_mv") + 0.5).cast("double"))


# --- cross-sections ------------------------------------------------------------------------------


def _raw(s, d):
    return features.raw_factors(_bars(s, d), fixtures.basic(s, d), fixtures.pit_q(s, d)).filter("factor_name = 'MOM_20D' and industry is not null")


@query("select trade_date, ts_code, q6(w) as w from wins where factor_name = 'MOM_20D'")
def winsorize_mad(s, d):
    return _q(xsection.winsorize_mad(_raw(s, d), "raw_val", "w").select("trade_date", "ts_code", "w"), "w")


@query("select trade_date, ts_code, q6(z) as z from zs where factor_name = 'MOM_20D'")
def zscore(s, d):
    return _q(xsection.zscore(xsection.winsorize_mad(_raw(s, d), "raw_val", "w"), "w", "z").select("trade_date", "ts_code", "z"), "z")


@query("select trade_date, ts_code, q6(r) as r from neut where factor_name = 'MOM_20D'")
def neutralize(s, d):
    z = xsection.zscore(xsection.winsorize_mad(_raw(s, d), "raw_val", "w"), "w", "z")
    return _q(xsection.neutralize(z, "z", "r").select("trade_date", "ts_code", "r"), "r")


@query("select trade_date, ts_code, factor_name, q6(clean_val) as clean_val from factors")
def clean_factor(s, d):
    return _q(_factors(s, d).select("trade_date", "ts_code", "factor_name", "clean_val"), "clean_val")


@query("select trade_date, ts_code, rank() over (partition by trade_date order by factor_val) + (count(*) over (partition by trade_date, factor_val) - 1) / 2 as rnk from mom")
def avg_rank(s, d):
    return xsection.average_rank(_mom(s, d), "factor_val", "rnk", ["trade_date"]).select("trade_date", "ts_code", "rnk")


# --- information coefficients --------------------------------------------------------------------


@query("select trade_date, ts_code, lag, q6(fwd_ret) as fwd_ret from fwd")
def forward_returns(s, d):
    return _q(ic.forward_returns(_bars(s, d), LAGS), "fwd_ret")


def _ic(s, d) -> DataFrame:
    return ic.rank_ic(_mom(s, d), _bars(s, d), LAGS)


@query("select lag, trade_date, n, q6(ic) as ic from ic")
def rank_ic(s, d):
    return _q(_ic(s, d), "ic")


@query("select lag, q6(avg(ic)) as mean_ic, q6(stddev_pop(ic)) as std_ic, q6(case when stddev_pop(ic) > 1e-6 then avg(ic) / stddev_pop(ic) else 0 end * sqrt(252.0 / lag)) as ir, q6(avg(case when ic > 0 then 1.0 else 0.0 end) * 100) as positive_ratio, count(*) as n_dates, q6(sum(ic)) as cum_ic from ic group by lag")
def rank_ic_summary(s, d):
    return _q(ic.summary(_ic(s, d)), "mean_ic", "std_ic", "ir", "positive_ratio", "cum_ic")


_RANGE = ("19970101", "19981231")
_RAW = f"select trade_date, ts_code, raw_val as factor_val from factors where factor_name = 'REV_5D' and trade_date between '{_RANGE[0]}' and '{_RANGE[1]}'"


@query("select trade_date, ts_code, q6(factor_val) as factor_val from mom", mom=_RAW)
def factor_scan_raw_range(s, d):
    return _q(features.scan(_factors(s, d, ("REV_5D",)), "REV_5D", *_RANGE, use_clean=False), "factor_val")


@query("select lag, trade_date, n, q6(ic) as ic from ic", mom=_RAW)
def rank_ic_raw_range(s, d):
    return _q(ic.of_factor(_factors(s, d, ("REV_5D",)), _bars(s, d), "REV_5D", LAGS, *_RANGE, use_clean=False), "ic")


@query("select lag, round_even(avg(ic) * 1e4, 0) / 1e4 as mean_ic, round_even(stddev_pop(ic) * 1e4, 0) / 1e4 as std_ic, round_even(case when stddev_pop(ic) > 1e-6 then avg(ic) / stddev_pop(ic) else 0 end * sqrt(252.0 / lag) * 1e3, 0) / 1e3 as ir, round_even(avg(case when ic > 0 then 1.0 else 0.0 end) * 1e4, 0) / 1e2 as positive_ratio, count(*) as n_dates, q6(sum(ic)) as cum_ic from ic group by lag")
def rank_ic_published(s, d):
    return _q(ic.published(ic.summary(_ic(s, d))), "cum_ic")


@query("select lag, trade_date, q6(sum(ic) over (partition by lag order by trade_date)) as cum_ic from ic")
def cum_ic(s, d):
    return _q(ic.cumulative(_ic(s, d)).select("lag", "trade_date", "cum_ic"), "cum_ic")


@query("select l.lag, q6(coalesce(avg(ic), 0)) as mean_ic, q6(coalesce(case when stddev_pop(ic) > 1e-6 then avg(ic) / stddev_pop(ic) else 0 end * sqrt(252.0 / l.lag), 0)) as ir from (select unnest([1, 5, 500]) as lag) l left join ic on ic.lag = l.lag group by l.lag")
def ic_decay(s, d):
    return _q(ic.decay(_ic(s, d), (1, 5, 500)), "mean_ic", "ir")


@query("select trade_date, n, q6(ic) as ic from ic_daily")
def rank_ic_daily_reversal(s, d):
    b = fixtures.bar_d(s, d)
    f = features.price_features(b).filter("rev_5 is not null").select("trade_date", "ts_code", q(F.col("rev_5")).alias("factor_val"))
    return _q(ic.rank_ic(f, b, (1,)).drop("lag"), "ic")


# --- backtest ------------------------------------------------------------------------------------


@query("select period, trade_date, entry_date, exit_date from sched")
def rebalance_schedule(s, d):
    return calendar.schedule(_mom(s, d), calendar.index(_bars(s, d)), INTERVAL)


@query("select p, grp, ts_code, can_buy from members")
def quantile_groups(s, d):
    return _backtest(s, d).members.select("p", "grp", "ts_code", "can_buy")


@query("select p, grp, ts_code, q6(weight) as weight from weights")
def bt_weights(s, d):
    return _q(_backtest(s, d).weights, "weight")


@query("select p, grp, q6(turnover) as turnover from turns")
def bt_turnover(s, d):
    return _q(_backtest(s, d).turnover, "turnover")


@query("select p, grp, exit_date, q6(gross) as gross, q6(net) as net from rets")
def bt_period_returns(s, d):
    return _q(_backtest(s, d).returns.select("p", "grp", "exit_date", "gross", "net"), "gross", "net")


@query("select p, grp, exit_date, q6(nav) as nav from nav")
def bt_nav(s, d):
    return _q(_backtest(s, d).nav, "nav")


@query("select p, grp, exit_date, q6(nav) as nav from nav", mom=_RAW)
def bt_nav_raw_range(s, d):
    return _q(backtest.Backtest.of_factor(_factors(s, d, ("REV_5D",)), _bars(s, d), fixtures.basic(s, d), "REV_5D", *_RANGE, use_clean=False, n_groups=GROUPS, interval=INTERVAL, fee=FEE).nav, "nav")


@query("select period, trade_date, entry_date, exit_date from sched", fd="select trade_date, row_number() over (order by trade_date) - 1 as rn, count(*) over () as n from (select distinct trade_date from mom order by 1 limit 5)")
def rebalance_schedule_short(s, d):
    few = _mom(s, d).select("trade_date").distinct().orderBy("trade_date").limit(5)
    return calendar.schedule(few, calendar.index(_bars(s, d)), INTERVAL)


@query("select p, exit_date, q6(bench_ret) as bench_ret, q6(product(1 + bench_ret) over (order by p)) as bench_nav from bench")
def bt_benchmark(s, d):
    return _q(_backtest(s, d).benchmark, "bench_ret", "bench_nav")


@query("select p, exit_date, q6(nav) as nav, q6(ret) as ret from ls")
def bt_long_short(s, d):
    return _q(_backtest(s, d).long_short, "nav", "ret")


@query("select portfolio, annual_return, annual_volatility, sharpe_ratio, max_drawdown, calmar_ratio, annual_turnover, final_nav from metrics")
def bt_metrics(s, d):
    return _backtest(s, d).metrics


@query("select round_even(corr(ra, rb) * 1e3, 0) / 1e3 as monotonicity from (select rank() over (order by grp) as ra, rank() over (order by f) + (count(*) over (partition by f) - 1) / 2 as rb from (select grp, round_even(arg_max(nav, p) * 1e4, 0) / 1e4 as f from nav group by grp))")
def bt_monotonicity(s, d):
    return _backtest(s, d).monotonicity


@query("select left(exit_date, 4) as year, substr(exit_date, 5, 2) as month, round_even((product(1 + ret) - 1) * 1e4, 0) / 1e2 as ret from ls where ret is not null group by 1, 2")
def bt_heatmap(s, d):
    return _backtest(s, d).heatmap


# --- reports -------------------------------------------------------------------------------------


def _holdings(s, d) -> DataFrame:
    f = _mom(s, d)
    last = f.agg(F.max("trade_date").alias("trade_date")).withColumn("next_date", F.lit(None).cast("string"))
    return report.latest_holdings(f, fixtures.basic(s, d), mask.tradable(last, fixtures.basic(s, d), _bars(s, d)))


@query("select ts_code, trade_date, factor_val, name, industry, is_tradable, filter_reason from holdings")
def latest_holdings(s, d):
    return _holdings(s, d)


@query("select ts_code, side, rank, factor_val from topbottom")
def top_bottom_k(s, d):
    return report.top_bottom(_holdings(s, d), GROUPS).select("ts_code", "side", "rank", "factor_val")


@query("select industry, count(*) as n from topbottom where side = 'top' and industry is not null group by industry")
def industry_exposure(s, d):
    return report.exposure(report.top_bottom(_holdings(s, d), GROUPS).filter("side = 'top'"))


@query("select distinct factor_name from factors")
def available_factors(s, d):
    return _factors(s, d).select("factor_name").distinct()


@query("select unnest(['MOM_20D', 'REV_5D', 'VOL_20D', 'EP_TTM', 'ROE_TTM']) as factor_name")
def available_factors_default(s, d):
    return report.available(s.createDataFrame([], tables.SCHEMAS["factor_metrics"]))[0]


# --- the warehouse -------------------------------------------------------------------------------


def _warehouse(s) -> tables.Warehouse:
    root = f"{scratch.shared_dir(s)}/panelforge-{uuid.uuid4().hex}"
    atexit.register(scratch.drop, s, root)
    w = tables.Warehouse(s, root)
    w.init()
    return w


@query("select ts_code, trade_date, q6(case when trade_date >= '19970601' then close + 1 else close end) as close from bar_m")
def warehouse_upsert(s, d):
    w, b = _warehouse(s), _bars(s, d)
    w.insert("daily_bar", b.filter("trade_date < '19970901'"))
    w.upsert("daily_bar", b.filter("trade_date >= '19970601'").withColumn("close", F.col("close") + 1))
    return _q(w.read("daily_bar").select("ts_code", "trade_date", "close"), "close")


@query("select ts_code, trade_date, q6(close) as close from bar_m where trade_date between '19970201' and '19970501'")
def warehouse_range(s, d):
    w = _warehouse(s)
    w.insert("daily_bar", _bars(s, d))
    return _q(w.read("daily_bar", "19970201", "19970501").select("ts_code", "trade_date", "close"), "close")


@query("select trade_date, ts_code, factor_name, q6(clean_val) as clean_val from factors where trade_date in ('19970601', '19980301') or trade_date > '20000101'")
def factor_backfill(s, d):
    """Chosen dates first, then one of 2000, then whatever lags behind the bars."""
    w = _warehouse(s)
    for name, df in (("daily_bar", _bars(s, d)), ("stock_basic", fixtures.basic(s, d)), ("financial_pit", fixtures.pit_q(s, d))):
        w.insert(name, df)
    sync.populate(w, s.createDataFrame([("19970601",), ("19980301",), ("20000201",)], "trade_date string"))
    sync.catch_up(w)
    return _q(w.read("factor_metrics").select("trade_date", "ts_code", "factor_name", "clean_val"), "clean_val")


# --- landed responses ----------------------------------------------------------------------------


@query("select ts_code, trade_date, q6(open) as open, q6(high) as high, q6(low) as low, q6(close) as close, q6(coalesce(lag(close) over (partition by ts_code order by trade_date), open)) as pre_close, vol, round_even(vol * ((open + close) / 2) * 1e4, 0) / 1e2 as amount, 1.0::double as adj_factor, q6(close) as adj_close from bar_m")
def landed_klines(s, d):
    """Two answers a stock whose ranges overlap, each third one without adjusted bars."""
    b = _bars(s, d).withColumn("third", F.substring("ts_code", 1, 6).cast("int") % 3 == 0)
    day = F.concat_ws("-", F.substring("trade_date", 1, 4), F.substring("trade_date", 5, 2), F.substring("trade_date", 7, 2))
    row = F.array(day, *[F.col(c).cast("string") for c in ("open", "close", "high", "low", "vol")])
    parts = b.withColumn("part", F.explode(F.array(F.lit(1), F.lit(2)))).filter("(part = 1 and trade_date < '19970101') or (part = 2 and trade_date >= '19961001')")
    rows = parts.groupBy("ts_code", "part", "third").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    junk = F.array(F.array(*[F.lit("1990-01-01")] + [F.lit("0")] * 5))
    answer = F.struct(F.when(~F.col("third"), F.col("rows")).alias("hfqday"), F.when(F.col("third"), F.col("rows")).otherwise(junk).alias("day"))
    body = F.to_json(F.struct(F.create_map(landed.symbol(F.col("ts_code")), answer).alias("data")))
    return _q(landed.klines(rows.select("ts_code", "part", body.alias("body"))), "open", "high", "low", "close", "pre_close", "adj_close")


_SUBS = ("白酒", "未列行业", "电池")


def _listed_sql() -> str:
    names, subs = (", ".join(f"'{x}'" for x in xs) for xs in (_SAMPLES, _SUBS))
    return f"""select ts_code, name, case when hit <> '综合' then hit when k % 4 <> 0 then '综合' when sub = '白酒' then '食品饮料' when sub = '电池' then '电力设备' else sub end as industry, '20100101' as list_date, (k % 7 = 0)::int as is_st, market_board
      from (select k, code || case when sh then '.SH' else '.SZ' end as ts_code, name, {_rules_case()} as hit, sub, case when sh and code like '688%' then 'STAR' when not sh and code like '300%' then 'ChiNext' else 'Main' end as market_board
        from (select s_suppkey as k, lpad(((s_suppkey * 7919) % 1000000)::varchar, 6, '0') as code, s_suppkey % 2 = 0 or code like '6%' as sh, case when s_suppkey % 7 = 0 then 'ST' else '' end || [{names}][s_suppkey % {len(_SAMPLES)} + 1] as name, [{subs}][s_suppkey % 3 + 1] as sub
          from supplier order by s_suppkey limit 60))"""


def _rules_case() -> str:
    pat = "|".join
    cases = [f"when regexp_matches(name, '{pat(industries.BANK_HINTS)}') and regexp_matches(name, '{pat(industries.BANK_WORDS)}') then '银行'"]
    cases += [f"when regexp_matches(name, '{pat(w)}') then '{i}'" for i, w in industries.RULES]
    return f"case {' '.join(cases)} else '综合' end"


@query(_listed_sql())
def landed_constituents(s, d):
    """The first sixty of a list, some with a page that names a sub-industry."""
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 7 == 0, "ST").otherwise(""), F.element_at(F.array(*map(F.lit, _SAMPLES)), (k % len(_SAMPLES) + 1).cast("int")))
    code, exchange = ((k * 7919) % 1000000).cast("string"), F.when(k % 2 == 0, "上海证券交易所").otherwise("深圳证券交易所")
    listed = fixtures.table(s, d, "supplier").select(k.alias("at"), code.alias("code"), name.alias("name"), exchange.alias("exchange"))
    sub = F.element_at(F.array(*map(F.lit, _SUBS)), (k % 3 + 1).cast("int"))
    html = F.concat(F.lit("<html><table><td>other</td><td>x</td></table>\n<TABLE class='t'><tr><td> <b>所属行业板块</b> </td><td>&nbsp;</td>\n<td>  <a href='#'>"), sub, F.lit("</a>\n</td><td>last</td></tr></TABLE></html>"))
    pages = fixtures.table(s, d, "supplier").filter(k % 4 == 0).select(scalars.exchange_code(code, exchange).alias("ts_code"), html.alias("html"))
    return landed.constituents(listed, 60, pages)


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'sh' else 'sz' end || lpad(s_suppkey::varchar, 6, '0') as symbol from supplier")
def service_symbol(s, d):
    k = F.col("s_suppkey")
    return fixtures.table(s, d, "supplier").select(k, landed.symbol(F.concat(F.lpad(k.cast("string"), 6, "0"), F.when(k % 3 == 0, ".SH").otherwise(".SZ"))).alias("symbol"))


# --- upserts, keys, samples ----------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_suppkey, l_extendedprice from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_suppkey desc, l_extendedprice desc) = 1")
def upsert_last_wins(s, d):
    li = fixtures.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    return tables.last_wins(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_suppkey", "l_extendedprice"]).drop("l_shipdate")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def pk_violations(s, d):
    return tables.violations(fixtures.table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("select l_suppkey, l_shipdate, l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_suppkey, l_shipdate order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) = 1")
def dedup_first_wins(s, d):
    li = fixtures.table(s, d, "lineitem")
    return tables.first_wins(li, ["l_suppkey", "l_shipdate"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]).select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")


@query("select ts_code, trade_date, q6(close) as close from bar_m where trade_date > '19980601'")
def incremental_new_rows(s, d):
    return _q(sync.after(_bars(s, d), "trade_date", "19980601").select("ts_code", "trade_date", "close"), "close")


@query("select distinct trade_date from bar_m where trade_date > coalesce((select max(trade_date) from factors where trade_date < '20000101'), '')")
def factor_lag_dates(s, d):
    mark = _factors(s, d).filter("trade_date < '20000101'").agg(F.coalesce(F.max("trade_date"), F.lit("")).alias("mark"))
    return _bars(s, d).select("trade_date").distinct().crossJoin(F.broadcast(mark)).filter("trade_date > mark").select("trade_date")  # one row: the mark


@query("select trade_date from cal where (idx >= 20 and (idx - 20) % 5 = 0) or idx > 20 + (select floor((max(idx) - 20) / 5) from cal) * 5")
def sample_every_k_with_tail(s, d):
    return calendar.every(_bars(s, d).select("trade_date").distinct(), 5, start=20, tail="rest")


@query("select trade_date from cal where idx % 5 = 0 or idx = (select max(idx) from cal)")
def sample_every_k_with_last(s, d):
    return calendar.every(_bars(s, d).select("trade_date").distinct(), 5, tail="last")


@query("select s_suppkey, case when sh and code like '688%' then 'STAR' when not sh and code like '300%' then 'ChiNext' else 'Main' end as board, code || case when sh then '.SH' else '.SZ' end as ts_code from (select s_suppkey, code, code like '6%' as sh from (select s_suppkey, lpad(((s_suppkey * 7919 + 300000 * (s_suppkey % 3)) % 1000000)::varchar, 6, '0') as code from supplier))")
def classify_board(s, d):
    k = F.col("s_suppkey")
    code = ((k * 7919 + 300000 * (k % 3)) % 1000000).cast("string")
    ex = F.lit("")
    return fixtures.table(s, d, "supplier").select("s_suppkey", scalars.board(code, ex).alias("board"), scalars.exchange_code(code, ex).alias("ts_code"))


@query("select s_suppkey, coalesce(nullif(regexp_replace(case when s_suppkey % 11 = 0 then 'none' else s_name end, '[^0-9]', '', 'g'), '')::bigint, 1) as digits from supplier")
def digits_to_int(s, d):
    name = F.when(F.col("s_suppkey") % 11 == 0, "none").otherwise(F.col("s_name"))
    return fixtures.table(s, d, "supplier").select("s_suppkey", scalars.digits_to_int(name).alias("digits"))


def _rules_sql() -> str:
    names = ", ".join(f"'{n}'" for n in _SAMPLES)
    return f"select s_suppkey, name, {_rules_case()} as industry from (select s_suppkey, [{names}][s_suppkey % {len(_SAMPLES)} + 1] as name from supplier)"


@query(_rules_sql())
def resolve_industry(s, d):
    name = F.element_at(F.array(*map(F.lit, _SAMPLES)), (F.col("s_suppkey") % len(_SAMPLES) + 1).cast("int"))
    return industries.resolve(fixtures.table(s, d, "supplier").select("s_suppkey", name.alias("name")))
