"""The SQL side of the catalogue: common table expressions that rebuild the panel from the star
schema by other means than the operators use (native as-of join, regression slopes, a recursive
query for the weights)."""

from __future__ import annotations

import re

#: Written as q6(expression) below.
_PLACES = "1e6"

CTES: dict[str, str] = {
    "li": "select l_suppkey as sk, l_extendedprice / l_quantity as px, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as mi, (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 as qi, * from lineitem",
    "mon": "select sk, mi, arg_min(px, row(l_shipdate, l_orderkey, l_linenumber, px)) as open, max(px) as high, min(px) as low, arg_max(px, row(l_shipdate, l_orderkey, l_linenumber, px)) as close, sum(l_quantity) as qty, sum(l_extendedprice) as amount from li group by sk, mi",
    "bar_m": """select lpad(sk::varchar, 6, '0') || '.SH' as ts_code, strftime(make_date((1995 + mi // 12)::int, (mi % 12 + 1)::int, 1), '%Y%m%d') as trade_date, open, high, low, close,
      coalesce(lag(close) over (partition by sk order by mi), open) as pre_close, case when (sk * 7 + mi) % 67 = 0 then 0.0::double else qty end as vol, amount,
      1 + 0.05::double * (mi // 12) as adj_factor, close * (1 + 0.05::double * (mi // 12)) as adj_close from mon""",
    "evd": "select user_id, strftime(ts, '%Y%m%d') as trade_date, arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, row(ts, event_id)) as close, count(*)::double as vol from events group by 1, 2",
    "bar_d": "select lpad(user_id::varchar, 6, '0') || '.SH' as ts_code, trade_date, open, high, low, close, vol, close as adj_close, dense_rank() over (order by trade_date) - 1 as idx_d from evd",
    "qtr": "select sk, qi, sum(l_extendedprice * (0.1::double - l_discount + l_tax)) as net_profit, sum(l_extendedprice * (1 - l_discount)) as revenue from li group by sk, qi",
    "pit_q": """select lpad(sk::varchar, 6, '0') || '.SH' as ts_code, strftime(last_day(date '1995-01-01' + to_months((aq * 3 + 2)::int)) + to_days((20 + (sk * 13 + aq * 7) % 70)::int), '%Y%m%d') as ann_date,
      strftime(last_day(date '1995-01-01' + to_months((qi * 3 + 2)::int)), '%Y%m%d') as end_date, net_profit / eq * 100 as roe, net_profit, revenue, ttm as ttm_net_profit, ttm / eq * 100 as roe_ttm, qi
      from (select qtr.*, abs(s_acctbal) + 1000 as eq, case when qi % 8 = 3 then qi + 1 else qi end as aq, sum(net_profit) over (partition by sk order by qi rows 3 preceding) as ttm from qtr join supplier on s_suppkey = sk)""",
    "basic": """select lpad(s_suppkey::varchar, 6, '0') || '.SH' as ts_code, case when s_suppkey % 17 = 0 then '*ST' || s_name else s_name end as name,
      case when s_suppkey % 41 <> 0 then 'IND_' || s_nationkey end as industry, case when s_suppkey % 5 = 0 then '19961115' else '19900101' end as list_date,
      case when s_suppkey % 19 = 0 then 1 else 0 end as is_st, case when s_suppkey % 10 <= 6 then 'Main' when s_suppkey % 10 <= 8 then 'ChiNext' else 'STAR' end as market_board from supplier""",
    "cal": "select trade_date, (row_number() over (order by trade_date) - 1)::int as idx, lead(trade_date) over (order by trade_date) as next_date from (select distinct trade_date from bar_m)",
    "pit1": "select * from pit_q qualify row_number() over (partition by ts_code, ann_date order by end_date desc) = 1",
    "known": "select b.ts_code, b.trade_date, p.ann_date, p.end_date, p.ttm_net_profit, p.roe_ttm from bar_m b asof left join pit1 p on b.ts_code = p.ts_code and b.trade_date >= p.ann_date",
    "mask_for": "select trade_date, next_date from cal where next_date is not null",
    "mask": "{mask:mask_for}",
    "feat0": """select b.ts_code, b.trade_date, close, adj_close, close * (1e8 + (coalesce(nullif(regexp_replace(b.ts_code, '[^0-9]', '', 'g'), '')::bigint, 1) % 50) * 1e7) as total_mv, count(*) over near as n_bars,
      adj_close / lag(adj_close) over w - 1 as daily_ret, lag(adj_close, 19) over w as m, lag(adj_close, 4) over w as r, list(adj_close) over near as a
      from bar_m b join cal using (trade_date) window w as (partition by b.ts_code order by idx), near as (partition by b.ts_code order by idx range between 29 preceding and current row)""",
    "feat": """select *, case when n_bars >= 20 then adj_close / m - 1 end as mom_20, case when n_bars >= 5 then adj_close / r - 1 end as rev_5,
      case when n_bars >= 16 then list_aggregate(list_transform(range(greatest(2, n_bars - 19), n_bars + 1), lambda i: a[i] / a[i - 1] - 1), 'stddev_pop') end as vol_20 from feat0""",
    "wide": "select f.*, case when b.ts_code is null then '综合' else b.industry end as industry, x.ttm_net_profit / f.total_mv as ep_ttm, x.roe_ttm from feat f left join basic b using (ts_code) left join known x on x.ts_code = f.ts_code and x.trade_date = f.trade_date where n_bars >= 5",
    "raw": """select * from (
        select trade_date, ts_code, 'MOM_20D' as factor_name, mom_20 as raw_val, industry, total_mv from wide union all select trade_date, ts_code, 'REV_5D', rev_5, industry, total_mv from wide
        union all select trade_date, ts_code, 'VOL_20D', vol_20, industry, total_mv from wide union all select trade_date, ts_code, 'EP_TTM', ep_ttm, industry, total_mv from wide
        union all select trade_date, ts_code, 'ROE_TTM', roe_ttm, industry, total_mv from wide) where raw_val is not null qualify count(*) over (partition by trade_date, factor_name) >= 10""",
    "med": "select *, quantile_cont(raw_val, 0.5) over k as md from raw where industry is not null and total_mv is not null window k as (partition by trade_date, factor_name)",
    "mad": "select *, quantile_cont(abs(raw_val - md), 0.5) over (partition by trade_date, factor_name) as mad from med",
    "wins": "select *, case when mad < 1e-12 then raw_val else greatest(least(raw_val, md + 3 * 1.4826::double * mad), md - 3 * 1.4826::double * mad) end as w from mad",
    "zs": "select *, case when stddev_pop(w) over k < 1e-12 then 0 else (w - avg(w) over k) / stddev_pop(w) over k end as z from wins window k as (partition by trade_date, factor_name)",
    "dem": "select *, z - avg(z) over (partition by trade_date, factor_name, industry) as yd, ln(greatest(total_mv, 1)) as lm, lm - avg(lm) over (partition by trade_date, factor_name, industry) as xd from zs",
    "neut": "select *, case when count(*) over k < 5 then z else yd - case when sum(xd * xd) over k > 1e-18 * sum(lm * lm) over k then coalesce(regr_slope(yd, xd) over k, 0) else 0 end * xd end as r from dem window k as (partition by trade_date, factor_name)",
    "neut2": "select *, count(*) over k as cn, stddev_pop(r) over k as sdr, avg(r) over k as avr from neut window k as (partition by trade_date, factor_name)",
    "factors": "select trade_date, ts_code, factor_name, raw_val, case when cn < 5 then raw_val when sdr > 1e-4 then (r - avr) / sdr else z end as clean_val from neut2",
    "mom": "select trade_date, ts_code, q6(clean_val) as factor_val from factors where factor_name = 'MOM_20D'",
    "px": "select ts_code, trade_date, idx, adj_close from bar_m join cal using (trade_date)",
    "fwd": "select c.trade_date, a.ts_code, l.lag, b.adj_close / a.adj_close - 1 as fwd_ret from (select unnest([1, 5]) as lag) l, px a join cal c on c.idx = a.idx - 1 join px b on b.ts_code = a.ts_code and b.idx = a.idx + l.lag where a.adj_close > 0 and b.adj_close <> 0",
    "prs": "select fwd.lag, trade_date, rank() over (partition by lag, trade_date order by factor_val) + (count(*) over (partition by lag, trade_date, factor_val) - 1) / 2 as ra, rank() over (partition by lag, trade_date order by fwd_ret) + (count(*) over (partition by lag, trade_date, fwd_ret) - 1) / 2 as rb from mom join fwd using (trade_date, ts_code)",
    "ic": "select lag, trade_date, count(*) as n, corr(ra, rb) as ic from prs group by lag, trade_date having count(*) >= 10 and stddev_pop(ra) > 0 and stddev_pop(rb) > 0",
    "revd": "select ts_code, trade_date, idx_d, adj_close, q6(adj_close / lag(adj_close, 4) over (partition by ts_code order by trade_date) - 1) as v from bar_d qualify v is not null and count(*) over (partition by ts_code order by idx_d range between 29 preceding and current row) >= 5",
    "prd": "select r.trade_date, r.v, b.adj_close / a.adj_close - 1 as f from revd r join bar_d a on a.ts_code = r.ts_code and a.idx_d = r.idx_d + 1 join bar_d b on b.ts_code = r.ts_code and b.idx_d = r.idx_d + 2 where a.adj_close > 0 and b.adj_close <> 0",
    "prd2": "select trade_date, rank() over (partition by trade_date order by v) + (count(*) over (partition by trade_date, v) - 1) / 2 as ra, rank() over (partition by trade_date order by f) + (count(*) over (partition by trade_date, f) - 1) / 2 as rb from prd",
    "ic_daily": "select trade_date, count(*) as n, corr(ra, rb) as ic from prd2 group by trade_date having count(*) >= 10 and stddev_pop(ra) > 0 and stddev_pop(rb) > 0",
    "fd": "select trade_date, row_number() over (order by trade_date) - 1 as rn, count(*) over () as n from (select distinct trade_date from mom)",
    "sched0": "select row_number() over (order by trade_date)::int as period, trade_date, lead(trade_date) over (order by trade_date) as next_t from fd where ceil(n / 3) < 3 or rn % 3 = 0",
    "sched": "select period, s.trade_date, a.next_date as entry_date, b.next_date as exit_date from sched0 s join cal a on a.trade_date = s.trade_date join cal b on b.trade_date = s.next_t where a.next_date is not null and b.next_date is not null",
    "smask_for": "select trade_date, entry_date as next_date from sched",
    "smask": "{mask:smask_for}",
    "mem0": "select period, s.trade_date, entry_date, exit_date, ts_code, can_buy, row_number() over (partition by period order by factor_val, ts_code) as rn, count(*) over (partition by period) as n from mom join sched s using (trade_date) join smask k using (trade_date, ts_code) where is_tradable",
    "members": "select *, dense_rank() over (order by period)::int as p, least((rn - 1) // (n // 5) + 1, 5)::int as grp from mem0 where n >= 5",
    "periods": "select distinct p, trade_date, entry_date, exit_date from members",
    "tgt": "select grp, p, list(ts_code order by ts_code) as codes, coalesce(list(ts_code order by ts_code) filter (can_buy), []) as buy from members group by grp, p",
    "blk": "select p, list(ts_code order by ts_code) as blocked from smask join periods using (trade_date) where not can_sell group by p",
    "state": """select 0 as p, grp, []::struct(c varchar, w double)[] as m from (select distinct grp from members)
      union all
      select t.p, s.grp, case
          when len(t.buy) > 0 and greatest(0, 1 - coalesce(list_sum(list_transform(s.car, lambda x: x.w)), 0)) > 0
            then list_concat(s.car, list_transform(t.buy, lambda y: {{'c': y, 'w': greatest(0, 1 - coalesce(list_sum(list_transform(s.car, lambda x: x.w)), 0)) / len(t.buy)}}))
          when len(s.car) = 0 then list_transform(t.codes, lambda y: {{'c': y, 'w': 1.0::double / len(t.codes)}}) else s.car end
      from (select state.p, state.grp, list_filter(state.m, lambda x: not list_contains(t2.codes, x.c) and list_contains(coalesce(b.blocked, []), x.c)) as car
            from state join tgt t2 on t2.p = state.p + 1 and t2.grp = state.grp left join blk b on b.p = state.p + 1) s join tgt t on t.p = s.p + 1 and t.grp = s.grp""",
    "weights": "select p, grp, x.c as ts_code, x.w as weight from (select p, grp, unnest(m) as x from state)",
    "chg": "select p, grp, ts_code, sum(v) as v from (select p, grp, ts_code, weight as v from weights union all select p + 1, grp, ts_code, -weight from weights) group by all",
    "turns": "select t.p, t.grp, 0.5 * coalesce(sum(abs(v)), 0) as turnover from tgt t left join chg on chg.p = t.p and chg.grp = t.grp group by all",
    "aret": "select w.p, w.grp, weight, b.adj_close / a.adj_close - 1 as ret from weights w join periods d on d.p = w.p join bar_m a on a.ts_code = w.ts_code and a.trade_date = d.entry_date join bar_m b on b.ts_code = w.ts_code and b.trade_date = d.exit_date where a.adj_close > 0",
    "gr": "select p, grp, sum(weight * ret) as gross from aret group by p, grp",
    "rets": "select t.p, t.grp, d.exit_date, coalesce(gross, 0) as gross, coalesce(gross, 0) - 0.001::double * turnover as net from turns t left join gr on gr.p = t.p and gr.grp = t.grp join periods d on d.p = t.p",
    "nav": "select p, grp, exit_date, product(1 + net) over (partition by grp order by p) as nav from rets union all select distinct 0, grp, null, 1.0 from rets",
    "bench": "select d.p, d.exit_date, coalesce(avg(ret), 0) as bench_ret from periods d left join aret on aret.p = d.p group by all",
    "ls": "select a.p, a.exit_date, a.nav / b.nav as nav, (a.nav / b.nav) / lag(a.nav / b.nav) over (order by a.p) - 1 as ret from nav a join nav b on a.p = b.p and a.grp = 5 and b.grp = 1",
    "port": "select 'Group_' || grp as portfolio, p, nav from nav union all select 'Long_Short', p, nav from ls",
    "path": "select *, nav / lag(nav) over (partition by portfolio order by p) - 1 as r, nav / max(nav) over (partition by portfolio order by p) - 1 as dd from port",
    "stat": """select portfolio, arg_max(nav, p) as f, pow(f, 84.0 / greatest(count(r), 1)) - 1 as ret, coalesce(stddev_pop(r), 0) * sqrt(84.0) as vol, round_even(min(dd) * 1e4, 0) / 1e4 as mdd from path group by portfolio""",
    "metrics": """select s.portfolio, round_even(ret * 1e4, 0) / 1e2 as annual_return, round_even(vol * 1e4, 0) / 1e2 as annual_volatility,
      case when vol > 1e-6 then round_even((ret - case when s.portfolio = 'Long_Short' then 0 else 0.02 end) / vol * 1e3, 0) / 1e3 else 0 end as sharpe_ratio, round_even(mdd * 1e4, 0) / 1e2 as max_drawdown,
      case when abs(mdd) > 1e-6 then round_even(abs(ret / mdd) * 1e3, 0) / 1e3 else 0 end as calmar_ratio, round_even(t.turn * 1e2, 0) / 1e2 as annual_turnover, round_even(f * 1e4, 0) / 1e4 as final_nav
      from stat s left join (select 'Group_' || grp as portfolio, avg(turnover) * 84.0 as turn from turns group by grp) t using (portfolio)""",
    "hmask_for": "select max(trade_date) as trade_date, null::varchar as next_date from mom",
    "hmask": "{mask:hmask_for}",
    "holdings": "select m.ts_code, m.trade_date, factor_val, name, b.industry, coalesce(is_tradable, true) as is_tradable, coalesce(filter_reason, 'OK') as filter_reason from mom m join basic b using (ts_code) left join hmask h on h.ts_code = m.ts_code and h.trade_date = m.trade_date where m.trade_date = (select max(trade_date) from mom)",
    "ranked": "select *, (row_number() over (order by factor_val, ts_code))::int as lo, (row_number() over (order by factor_val desc, ts_code desc))::int as hi, count(*) over () as n from holdings",
    "topbottom": "select *, 'top' as side, hi as rank from ranked where hi <= n // 5 union all select *, 'bottom', lo from ranked where lo <= n // 5",
}

_MASK = """select ts_code, trade_date, industry, not st and not nw and not su as is_tradable, not st and not nw and not su and not idle and not up as can_buy, not idle and not dn as can_sell,
  st as is_st, nw as is_new, su as is_suspended_t, up as is_limit_up_next, dn as is_limit_down_next,
  coalesce(nullif(concat_ws(';', case when st then 'ST' end, case when nw then 'NewStock' end, case when su then 'Suspended_T' end, case when up then 'LimitUp_BuyBlocked' end, case when dn then 'LimitDown_SellBlocked' end), ''), 'OK') as filter_reason
  from (select b.ts_code, d.trade_date, b.industry, b.is_st <> 0 or contains(b.name, 'ST') as st,
      date_diff('day', strptime(b.list_date, '%Y%m%d'), strptime(d.trade_date, '%Y%m%d')) < 120 as nw, coalesce(t.vol <= 0, true) as su, d.next_date is not null and coalesce(x.vol <= 0, true) as idle,
      coalesce(x.vol > 0 and x.pre_close > 0 and x.open = x.high and (x.open - x.pre_close) / x.pre_close >= case when b.market_board in ('ChiNext', 'STAR') then 0.198::double else 0.098::double end, false) as up,
      coalesce(x.vol > 0 and x.pre_close > 0 and x.open = x.low and (x.open - x.pre_close) / x.pre_close <= -case when b.market_board in ('ChiNext', 'STAR') then 0.198::double else 0.098::double end, false) as dn
    from {0} d cross join basic b left join bar_m t on t.ts_code = b.ts_code and t.trade_date = d.trade_date left join bar_m x on x.ts_code = b.ts_code and x.trade_date = d.next_date)"""


def _expand(text: str) -> str:
    text = re.sub(r"^\{mask:(\w+)\}$", lambda m: _MASK.format(m[1]), text.strip()).replace("{{", "{").replace("}}", "}")
    while m := re.search(r"\bq6\(", text):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        text = f"{text[: m.start()]}(round_even(({text[m.end() : i - 1]}) * {_PLACES}, 0) / {_PLACES}){text[i:]}"
    return text


def sql(final: str, **other: str) -> str:
    """The query with the expressions it needs, in order; other: expressions to use in place of those
    of the same name."""
    final, bodies, need = _expand(final), {k: _expand(v) for k, v in (CTES | other).items()}, set()

    def visit(text: str, own: str = "") -> None:
        for name in set(re.findall(r"\b(?:from|join)\s+(\w+)|,\s*(\w+)\s+[a-z]\b", text)):
            for n in name:
                if n in bodies and n != own and n not in need:
                    need.add(n)
                    visit(bodies[n], n)

    visit(final)
    if not need:
        return final
    return f"with recursive {', '.join(f'{k} as ({v})' for k, v in bodies.items() if k in need)} {final}"
