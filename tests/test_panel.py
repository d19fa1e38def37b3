"""Panel operators on small hand-made frames."""

import json
import math
from datetime import date, datetime

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge import catalog
from panelforge.__main__ import main
from panelforge.functions import industries, scalars
from panelforge.operators import backtest, calendar, features, ic, mask, pit, xsection
from panelforge.plans import report, sync
from panelforge.sources import fixtures, synthetic
from panelforge.sources.tables import SCHEMAS, ConcurrentWrite, Warehouse

STOCKS = [
    ("610001.SH", "Alder", "电子", "20050303", 0, "Main"),
    ("020002.SZ", "Birch", "汽车", "20050303", 0, "Main"),
    ("020003.SZ", "STCedar", "传媒", "20050303", 1, "Main"),
    ("310004.SZ", "Elm", "通信", "20230901", 0, "ChiNext"),
    ("310005.SZ", "Fir", "通信", "20050303", 0, "ChiNext"),
]
REPORTS = [
    ("610001.SH", "20230811", "20230630", 3.25, 7.0e8, 3.0e9, 1.3e9, 6.5),
    ("610001.SH", "20231117", "20230930", 4.75, 1.1e9, 4.4e9, 1.5e9, 7.5),
]
DAYS = [
    ("610001.SH", "20231113", 31.0, 31.6, 30.7, 31.4, 31.0, 8200.0, 255840.0, 1.5, 47.1),
    ("610001.SH", "20231114", 31.4, 32.0, 31.1, 31.8, 31.4, 7100.0, 224360.0, 1.5, 47.7),
    ("020002.SZ", "20231113", 5.0, 5.1, 4.9, 5.0, 5.0, 4400.0, 22000.0, 1.0, 5.0),
    ("020002.SZ", "20231114", 5.5, 5.5, 5.5, 5.5, 5.0, 300.0, 1650.0, 1.0, 5.5),
    ("020003.SZ", "20231113", 2.4, 2.4, 2.4, 2.4, 2.4, 0.0, 0.0, 1.0, 2.4),
    ("310005.SZ", "20231113", 20.0, 20.5, 19.5, 20.0, 20.0, 900.0, 18000.0, 1.0, 20.0),
    ("310005.SZ", "20231114", 16.0, 16.8, 16.0, 16.2, 20.0, 900.0, 14500.0, 1.0, 16.2),
]


@pytest.fixture(scope="module")
def small(spark):
    return {n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in (("stock_basic", STOCKS), ("financial_pit", REPORTS), ("daily_bar", DAYS))}


def test_no_lookahead(spark, small):
    def at(d):
        return pit.snapshot(small["financial_pit"], d).first()

    assert at("20230810") is None
    assert (at("20231116")["end_date"], at("20231116")["net_profit"]) == ("20230630", 7.0e8)
    assert (at("20231117")["end_date"], at("20231117")["net_profit"]) == ("20230930", 1.1e9)
    left = spark.createDataFrame([("610001.SH", d) for d in ("20230810", "20231116", "20231117", "20240105")] + [("020002.SZ", "20240105")], "ts_code string, trade_date string")
    got = {(r["ts_code"], r["trade_date"]): r["end_date"] for r in pit.as_of(left, small["financial_pit"], ["end_date"]).collect()}
    assert got == {("610001.SH", "20230810"): None, ("610001.SH", "20231116"): "20230630", ("610001.SH", "20231117"): "20230930", ("610001.SH", "20240105"): "20230930", ("020002.SZ", "20240105"): None}


def test_as_of_takes_the_latest_period_of_a_day(spark):
    p = spark.createDataFrame([("a", "20240110", "20231231", 2.0), ("a", "20240110", "20230930", 1.0), ("a", "20240401", "20240331", 3.0)], "ts_code string, ann_date string, end_date string, x double")
    left = spark.createDataFrame([("a", "20240110", 7), ("a", "20240110", 8), ("a", "20240331", 9), (None, "20240331", 1)], "ts_code string, trade_date string, n int")
    got = sorted((r["n"], r["end_date"], r["x"]) for r in pit.as_of(left, p, ["end_date", "x"]).collect() if r["ts_code"])
    assert got == [(7, "20231231", 2.0), (8, "20231231", 2.0), (9, "20231231", 2.0)] and pit.as_of(left, p, ["x"]).count() == 4


def test_mask(spark, small):
    d = spark.createDataFrame([("20231113", "20231114")], "trade_date string, next_date string")
    m = {r["ts_code"]: r for r in mask.tradable(d, small["stock_basic"], small["daily_bar"]).collect()}
    assert m["610001.SH"]["is_tradable"] and m["610001.SH"]["can_buy"] and m["610001.SH"]["can_sell"]
    assert m["020003.SZ"]["is_st"] and m["020003.SZ"]["is_suspended_t"] and not m["020003.SZ"]["is_tradable"]
    assert m["020002.SZ"]["is_limit_up_next"] and m["020002.SZ"]["is_tradable"] and not m["020002.SZ"]["can_buy"]
    assert m["310005.SZ"]["is_limit_down_next"] and m["310005.SZ"]["can_buy"] and not m["310005.SZ"]["can_sell"]
    assert m["310004.SZ"]["is_new"] and not m["310004.SZ"]["is_tradable"] and not m["310004.SZ"]["can_sell"]
    assert m["020003.SZ"]["filter_reason"] == "ST;Suspended_T" and m["610001.SH"]["filter_reason"] == "OK"


def test_winsorize(spark):
    x = [1.0, 1.1, 0.9, 1.0, 1.2, 0.95, 100.0, -100.0]
    df = spark.createDataFrame([("d", "f", v) for v in x], "trade_date string, factor_name string, x double")
    w = [r["w"] for r in xsection.winsorize_mad(df, "x", "w").collect()]
    assert max(w) < 10 and min(w) > -10


def test_neutralize_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    n, k = 400, 31
    ind, mv = rng.integers(0, k, n), rng.uniform(1e9, 1e11, n)
    y = rng.normal(size=n) + ind * 0.1 + 0.5 * np.log(mv)
    x = np.column_stack([(ind[:, None] == np.arange(k)).astype(float), np.log(mv)])
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    rows = [("d", "f", i, industries.INDUSTRIES[j], float(m), float(v)) for i, (j, m, v) in enumerate(zip(ind, mv, y, strict=True))]
    df = spark.createDataFrame(rows, "trade_date string, factor_name string, i int, industry string, total_mv double, y double")
    got = xsection.neutralize(df, "y", "r", industries=industries.INDUSTRIES).orderBy("i").toPandas()["r"].to_numpy()
    assert np.abs(got - want).max() < 1e-8
    for j in range(x.shape[1]):
        assert x[:, j].std() == 0 or abs(np.corrcoef(got, x[:, j])[0, 1]) < 1e-5


def test_clean_isolates_nulls(spark):
    rows = [("d", "f", str(i), 0.1 * i, "银行", 1e9 + i) for i in range(6)]
    rows[1] = ("d", "f", "1", None, "银行", 1e9)
    rows[2] = ("d", "f", "2", 0.2, None, 1e9)
    rows[3] = ("d", "f", "3", 0.3, "银行", None)
    df = spark.createDataFrame(rows, "trade_date string, factor_name string, ts_code string, raw_val double, industry string, total_mv double")
    out = xsection.clean(df).collect()
    assert len(out) == 3 and all(r["clean_val"] == r["raw_val"] for r in out)


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 8, 60), rng.integers(0, 8, 60)
    df = spark.createDataFrame([("k", int(x), int(y)) for x, y in zip(a, b, strict=True)] + [("c", 1, i) for i in range(5)], "k string, a int, b int")
    got = {r["k"]: r["corr"] for r in xsection.spearman(df, "a", "b", ["k"]).collect()}
    want = pd.Series(a).rank().corr(pd.Series(b).rank())
    assert abs(got["k"] - want) < 1e-12 and got["c"] is None


def test_truncating_the_future_changes_nothing(spark):
    stocks, days = synthetic.universe(spark, 12), calendar.weekdays(spark, "20240101", "20240331")
    bars = synthetic.bars(stocks, days).cache()
    full = {(r["ts_code"], r["trade_date"]): r["mom_20"] for r in features.price_features(bars).filter("trade_date <= '20240301'").collect()}
    cut = {(r["ts_code"], r["trade_date"]): r["mom_20"] for r in features.price_features(bars.filter("trade_date <= '20240301'")).collect()}
    assert full == cut and any(v is not None for v in full.values())


def test_carried_positions(spark):
    """Two periods, one group: a name that can't be sold keeps its weight, the rest is shared."""
    mem = spark.createDataFrame(
        [(1, "d1", "e1", "x1", 1, "A", True), (1, "d1", "e1", "x1", 1, "B", True), (2, "d2", "e2", "x2", 1, "C", True), (2, "d2", "e2", "x2", 1, "D", False)],
        "period int, trade_date string, entry_date string, exit_date string, grp int, ts_code string, can_buy boolean",
    )
    masks = spark.createDataFrame([("d1", "A", True), ("d2", "A", False), ("d2", "B", True), ("d2", "C", True)], "trade_date string, ts_code string, can_sell boolean")
    periods, m = backtest.renumber(mem)
    w = backtest.weights(m, masks, periods)
    got = {(r["p"], r["ts_code"]): r["weight"] for r in w.collect()}
    assert got == {(1, "A"): 0.5, (1, "B"): 0.5, (2, "A"): 0.5, (2, "C"): 0.5}
    t = {r["p"]: r["turnover"] for r in backtest.turnover(w, m).collect()}
    assert t == {1: 0.5, 2: 0.5}


def _bar(code, day, close):
    return (code, day, close, close, close, close, close, 700.0, 700.0 * close, 1.0, close)


def _names(spark, path):
    fs, p = Warehouse(spark, "")._fs(path)
    return {s.getPath().getName() for s in fs.listStatus(p)}


def test_warehouse(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.init()
    assert set(w.tables()) == set(SCHEMAS) and w.read("daily_bar").count() == 0
    bars = spark.createDataFrame([_bar("610001.SH", f"2023{m:02d}{d:02d}", m + d / 100) for m in (1, 2, 3) for d in (5, 6)], SCHEMAS["daily_bar"])
    assert w.insert("daily_bar", bars) == 6 and w.insert("daily_bar", bars.limit(0)) == 0
    for again in (bars.limit(1), spark.createDataFrame([_bar("610001.SH", "20230405", 1.0)] * 2, SCHEMAS["daily_bar"])):
        with pytest.raises(ValueError):
            w.insert("daily_bar", again)
    before = w._state("daily_bar")[1]
    new = spark.createDataFrame([_bar("610001.SH", "20230206", 9.0), _bar("610001.SH", "20230206", 8.0), _bar("020002.SZ", "20230207", 7.0)], SCHEMAS["daily_bar"])
    assert w.upsert("daily_bar", new) == 3
    after = w._state("daily_bar")[1]
    assert {p for p in after if after[p] != before.get(p)} == {"202302"}  # only the month that changed
    got = {(r["ts_code"], r["trade_date"]): r["close"] for r in w.read("daily_bar").collect()}
    assert len(got) == 7 and got["610001.SH", "20230206"] == 9.0 and got["020002.SZ", "20230207"] == 7.0
    w.upsert("daily_bar", new, order=[F.col("close")])  # the smallest close last
    assert [r["close"] for r in w.read("daily_bar", "20230206", "20230206").collect()] == [8.0]
    assert all("_part=p202303" in f for f in w.read("daily_bar", "20230301").inputFiles())  # no other part is opened
    assert w.vacuum() == 2 and w.vacuum() == 0 and w.read("daily_bar").count() == 7


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = (Warehouse(spark, str(tmp_path / "w")) for _ in "ab")
    a.init()
    old = b._state("daily_bar")
    a.insert("daily_bar", spark.createDataFrame([_bar("610001.SH", "20230105", 1.0)], SCHEMAS["daily_bar"]))
    with pytest.raises(ConcurrentWrite):
        b._commit("daily_bar", old[0] + 1, {})
    stale, real = [old], b._state
    b._state = lambda name: stale.pop() if stale else real(name)
    b.insert("daily_bar", spark.createDataFrame([_bar("020002.SZ", "20230105", 2.0)], SCHEMAS["daily_bar"]))
    assert {r["ts_code"] for r in a.read("daily_bar").collect()} == {"610001.SH", "020002.SZ"}


def test_archive(spark, tmp_path, small):
    w, v = Warehouse(spark, str(tmp_path / "w")), Warehouse(spark, str(tmp_path / "v"))
    assert not v.restore(str(tmp_path / "none"))
    w.init()
    for name, df in small.items():
        w.insert(name, df)
    w.archive(str(tmp_path / "w.gz"))
    assert any(f.endswith(".json.gz") for f in _names(spark, str(tmp_path / "w.gz" / "daily_bar")))
    assert v.restore(str(tmp_path / "w.gz")) and not v.restore(str(tmp_path / "w.gz"))
    for name, df in small.items():
        assert sorted(map(tuple, v.read(name).collect())) == sorted(map(tuple, df.collect()))


def test_sync(spark, tmp_path):
    """Full load, up to date, forward, head backfill, lagging factors: the whole state machine."""
    w = Warehouse(spark, str(tmp_path / "w"))
    first = sync.on_startup(spark, w, as_of=date(2023, 3, 31))
    days = [r[0] for r in w.read("daily_bar").select("trade_date").distinct().orderBy("trade_date").collect()]
    assert first["status"] == "full_sync" and w.read("stock_basic").count() == 60 and (days[0], days[-1]) == ("20210331", "20230331")
    have = {r[0] for r in w.read("factor_metrics").select("trade_date").distinct().collect()}
    want = days[20::5] + [d for d in days if d > days[20::5][-1]]
    assert have == set(want) and first["new_factor_dates"] == len(want)
    assert sync.on_startup(spark, w, as_of=date(2023, 3, 31))["status"] == "up_to_date"

    last = {r["ts_code"]: r for r in sync.latest_states(w.read("daily_bar")).collect()}
    got = sync.sync(spark, w, years=2, as_of=date(2023, 4, 21))
    new = [r[0] for r in w.read("daily_bar", "20230401").select("trade_date").distinct().orderBy("trade_date").collect()]
    assert got["status"] == "updated" and got["new_bars"] == 60 * len(new) and len(new) == 15
    for r in w.read("daily_bar", new[0], new[0]).collect():  # goes on from the last state
        if was := last.get(r["ts_code"]):  # others were listed since
            assert r["pre_close"] == round(was["close"], 2) and r["adj_factor"] == was["adj_factor"]
    now = {r[0] for r in w.read("factor_metrics", "20230401").select("trade_date").distinct().collect()}
    assert now == set(new[::5]) | {new[-1]} and got["new_factor_dates"] == len(now)

    rows = w.read("factor_metrics").count()
    got = sync.sync(spark, w, years=2.2, as_of=date(2023, 4, 21), factors=False)  # the head only
    assert got["status"] == "updated" and got["new_factor_dates"] == 0 and w.read("factor_metrics").count() == rows
    assert w.read("daily_bar").agg(F.min("trade_date")).first()[0] < "20210331"

    got = sync.sync(spark, w, years=2, as_of=date(2023, 4, 27), factors=False)  # factors lag and are caught up all the same
    assert got["new_factor_dates"] == 4 and w.read("factor_metrics").agg(F.max("trade_date")).first()[0] == "20230427"


def test_populate_equals_all_dates_at_once(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    sync.sample_load(spark, w, 40, "20230102", "20230428")
    dates = spark.createDataFrame([("20230315",), ("20230417",)], "trade_date string")
    n = sync.populate(w, dates)
    every = features.factor_metrics(w.read("daily_bar"), w.read("stock_basic"), w.read("financial_pit")).join(dates, "trade_date")
    want = {(r["trade_date"], r["ts_code"], r["factor_name"]): (r["raw_val"], r["clean_val"]) for r in every.collect()}
    got = {(r["trade_date"], r["ts_code"], r["factor_name"]): (r["raw_val"], r["clean_val"]) for r in w.read("factor_metrics").collect()}
    assert n == len(want) == len(got) and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in want)


def test_landed_load_and_command_line(spark, tmp_path):
    listed = [(i, str(600 + i) if i % 2 else f"68800{i}", f"Name{i}", "上海证券交易所") for i in range(1, 7)]
    landed_at = tmp_path / "landed"
    (landed_at / "bars").mkdir(parents=True)
    (landed_at / "constituents.json").write_text("\n".join(json.dumps({"at": a, "code": c, "name": n, "exchange": e}) for a, c, n, e in listed))
    days = [r[0] for r in calendar.weekdays(spark, "20230102", "20230331").collect()]
    for _, code, _, _ in listed[:4]:
        ts = f"{code.zfill(6)}.SH"
        for part, some in ((1, days[:40]), (2, days[35:])):
            rows = [[f"{d[:4]}-{d[4:6]}-{d[6:]}", "10.0", str(10 + part), "12", "9", "5", {"note": 1}] for d in some]
            (landed_at / "bars" / f"{ts}_{part}.json").write_text(json.dumps({"code": 0, "data": {"sh" + code.zfill(6): {"hfqday": rows, "qt": {}}}}))
    (landed_at / "bars" / "000603.SH_3.json").write_text("no json")
    out = main(["--landed", str(landed_at), "--stocks", "4", "--db", str(tmp_path / "db")], spark)
    assert out["rows"]["stock_basic"] == 4 and out["rows"]["daily_bar"] == 4 * len(days)
    w = Warehouse(spark, str(tmp_path / "db"))
    b = {r["trade_date"]: r for r in w.read("daily_bar").filter("ts_code = '000601.SH'").collect()}
    assert (b[days[0]]["pre_close"], b[days[0]]["close"], b[days[0]]["amount"]) == (10.0, 11.0, 5250.0)
    assert (b[days[39]]["close"], b[days[40]]["close"], b[days[41]]["pre_close"]) == (11.0, 12.0, 12.0)  # the first answer's row wins
    assert {r["market_board"] for r in w.read("stock_basic").collect()} == {"Main", "STAR"}
    assert main(["--status", "--db", str(tmp_path / "db")], spark)["rows"] == out["rows"]


def test_synthetic_bars(spark):
    stocks = synthetic.universe(spark, 50)
    assert stocks.groupBy("market_board").count().count() == 3 and stocks.filter("is_st = 1").count() == 2
    rows = [tuple(r) for r in synthetic.bars(stocks, calendar.weekdays(spark, "20240101", "20251231")).collect()]
    assert rows == [tuple(r) for r in synthetic.bars(stocks, calendar.weekdays(spark, "20240101", "20251231")).collect()]
    df = pd.DataFrame(rows, columns=SCHEMAS["daily_bar"].names)
    assert (df.high >= df[["open", "close", "low"]].max(axis=1) - 1e-9).all() and (df.low <= df[["open", "close"]].min(axis=1) + 1e-9).all()
    assert (df.amount - (df.vol * (df.open + df.close) / 2 * 100).round(2)).abs().max() < 1 and (df.adj_close - df.close * df.adj_factor).abs().max() < 1e-4
    first = df.sort_values("trade_date").groupby("ts_code").adj_factor
    assert (first.first() == 1).all() and (first.last() > 1).all() and 0.005 < (df.vol == 0).mean() < 0.03
    rep = synthetic.disclosures(stocks, 2020, 2021)
    assert rep.count() == 50 * 8 and rep.filter("ann_date <= end_date").count() == 0


def test_scraped_pages(spark):
    t = lambda *cells: "<table>" + "".join(f"<td class=x>{c}</td>" for c in cells) + "</table>"
    pages = [t("a", "b"), t("所属行业板块", " "), t("所属行业板块", "", "<b> 白酒 </b>", "z"), t("所属行业板块") + t("所属行业板块", "电池"), "", None]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    assert [r[0] for r in df.orderBy("i").select(industries.scraped(F.col("html"))).collect()] == [None, None, "白酒", "电池", None, None]


def test_available_factors(spark):
    none = spark.createDataFrame([], SCHEMAS["factor_metrics"])
    names, dates = report.available(none)
    assert {r[0] for r in names.collect()} == set(features.NAMES) and dates.count() == 0
    names, dates = report.available(spark.createDataFrame([("20240102", "a", "X", 1.0, 1.0)], SCHEMAS["factor_metrics"]))
    assert [r[0] for r in names.collect()] == ["X"] and dates.count() == 1


def test_quantise_is_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (-0.125,), (1e300,), (2.5e50,)], "x double")
    assert [r[0] for r in df.select(scalars.quantise(F.col("x"), 2)).collect()] == [0.12, 0.38, -0.12, 1e300, 2.5e50]


def test_metrics_and_report(spark):
    navs = spark.createDataFrame([(0, g, None, 1.0) for g in (1, 2)] + [(1, 1, "20240102", 0.9), (1, 2, "20240102", 1.1), (2, 1, "20240202", 0.99), (2, 2, "20240202", 1.21)], "p int, grp int, exit_date string, nav double")
    turns = spark.createDataFrame([(1, 1, 0.5), (2, 1, 1.0), (1, 2, 0.5), (2, 2, 1.0)], "p int, grp int, turnover double")
    ls = backtest.long_short(navs, 2)
    m = {r["portfolio"]: r for r in backtest.metrics(navs, turns, ls, 126).collect()}
    assert m["Group_1"]["max_drawdown"] == -10.0 and m["Group_2"]["annual_return"] == 21.0 and m["Group_1"]["annual_turnover"] == 1.5
    assert math.isclose(m["Long_Short"]["final_nav"], round(1.21 / 0.99, 4))
    page = report.html_report(backtest.metrics(navs, turns, ls, 126), "MOM")
    assert "<td>21.0</td>" in page and "base64," in report.data_link(page)
    assert backtest.monotonicity(navs).first()[0] == 1.0
    table = report.metrics_table(backtest.metrics(navs, turns, ls, 126))
    assert [r[0] for r in table.collect()] == ["Group_1", "Group_2", "Long_Short"] and "Sharpe" in table.columns


def _and_sql(spark, path, name, prices):
    """Sorted rows of a query and of its SQL, NaN as text; prices: by user and day, from user 0 and the first of March."""
    rows = [(9 * u + i, datetime(2024, 3, 1 + i, 12, u), u, x) for u, xs in enumerate(prices) for i, x in enumerate(xs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{path}/events.parquet/*.parquet')")
    want = c.execute(catalog.ORACLE_SQL[name])
    cols = [x[0] for x in want.description]
    return [sorted(tuple("NaN" if x != x else x for x in r) for r in rs) for rs in (catalog.QUERIES[name](spark, str(path)).select(*cols).collect(), want.fetchall())]


def test_daily_ic_ranks_returns_on_a_price_of_zero(spark, tmp_path):
    prices = np.random.default_rng(3).integers(1, 30, (11, 9)).astype(float).tolist()
    prices[3][1] = prices[4][1] = prices[4][5] = 0.0
    prices[5][1] = -0.0
    got, want = _and_sql(spark, tmp_path, "rank_ic_daily_reversal", prices)
    assert got == want and [r[:2] for r in got] == [("20240305", 10), ("20240306", 11), ("20240307", 11)]


def test_daily_reversal_keeps_returns_on_a_price_of_zero(spark, tmp_path):
    got, want = _and_sql(spark, tmp_path, "rev_5_daily", [[0.0, 2.0, -0.0, 4.0, 5.0, 3.0, 0.0]])
    code, inf = "000000.SH", math.inf
    assert got == want == [(code, "20240305", inf), (code, "20240306", 0.5), (code, "20240307", "NaN")]


def test_daily_bars_without_values(spark, tmp_path):
    """The last event with a value closes the day; a day without any has a bar, but no price."""
    at = [(d, h, x) for d in range(1, 9) for h, x in ((9, None), (10, float(d)), (16, None))]
    rows = [(i, datetime(2024, 3, d, h), 7, None if d == 3 else x) for i, (d, h, x) in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = [(r["trade_date"][-1], r["open"], r["close"], r["vol"]) for r in fixtures.bar_d(spark, str(tmp_path)).orderBy("trade_date").collect()]
    assert got == [(str(d), *[None if d == 3 else float(d)] * 2, 3.0) for d in range(1, 9)]
    rev = catalog.rev_5_daily(spark, str(tmp_path)).orderBy("trade_date").collect()
    assert [(r["trade_date"][-1], r["rev_5"]) for r in rev] == [("5", 4.0), ("6", 2.0), ("8", 1.0)]


def test_ic_decay_fills_missing_lags(spark):
    x = spark.createDataFrame([(1, "a", 10, 0.5), (1, "b", 10, 0.1)], "lag int, trade_date string, n int, ic double")
    got = {r["lag"]: r["mean_ic"] for r in ic.decay(x, (1, 7)).collect()}
    assert math.isclose(got[1], 0.3) and got[7] == 0.0


def test_industry_rules(spark):
    df = spark.createDataFrame([("a", "招商银行"), ("b", "北京文化"), ("c", "某公司")], "ts_code string, name string")
    landed = spark.createDataFrame([("b", "白酒"), ("c", "未列")], "ts_code string, sub_industry string")
    got = {r["ts_code"]: r["industry"] for r in industries.resolve(df, landed).collect()}
    assert got == {"a": "银行", "b": "食品饮料", "c": "未列"}
