"""Event studies: calendars, abnormal and cumulative returns, portfolios.

A firm is a supplier. Its daily return comes from its lines of the day, the factors from all lines
of the day, and an event is an order, of the first supplier among its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import portfolios
from tidemark.operators.quantiles import hfl, with_quantiles
from tidemark.operators.returns import (
    abnormal_returns, drop_sentinels, forward_compound, forward_sums, trailing_moments, winsorized,
)
from tidemark.operators.trading import asof_position, positions, shift_after_close
from tidemark.plans.known import day_text
from tidemark.sources import read_table, stored

FACTORS = ("mktrf", "smb", "hml", "umd")
HORIZONS = (32, 63, 126, 189, 252)
RF = 0.0001


def daily_returns(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("permno"), F.to_date("l_shipdate").alias("dt")).agg((F.avg("l_discount") - F.avg("l_tax")).alias("ret"))


def factors(spark: SparkSession, folder: str) -> DataFrame:
    """One row per day."""
    lines = read_table(spark, folder, "lineitem")
    side = lambda c: F.avg(F.when(c, F.col("l_discount"))) - F.avg(F.when(~c, F.col("l_discount")))
    return lines.groupBy(F.to_date("l_shipdate").alias("dt")).agg(
        (F.avg("l_discount") - F.avg("l_tax")).alias("mktrf"),
        side(F.col("l_quantity") > 25).alias("smb"),
        side(F.col("l_returnflag") == "R").alias("hml"),
        side(F.col("l_linestatus") == "O").alias("umd"),
    )


def order_events(spark: SparkSession, folder: str) -> DataFrame:
    first = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("permno"))
    orders = read_table(spark, folder, "orders")
    before = F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False)
    return orders.join(first, orders.o_orderkey == first.l_orderkey).select(
        F.col("o_orderkey").alias("event_id"), "permno", F.to_date("o_orderdate").alias("call_date"), before.alias("is_before_close")
    )


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Firm-days that have factors, with positions."""
    daily = daily_returns(spark, folder).join(factors(spark, folder), "dt")
    return stored(positions(daily.withColumn("exret", F.col("ret") - RF)))


def _matched(events: DataFrame, days: DataFrame, shift: bool = False) -> DataFrame:
    """events at their trading row, with its columns."""
    placed = asof_position(events, days, "call_date").where("pos is not null")
    if shift:
        sizes = days.groupBy("permno").agg(F.count("*").alias("n_days"))
        placed = placed.join(sizes, "permno").withColumn("pos", shift_after_close(F.col("is_before_close"), F.col("pos"), F.col("n_days"))).drop("n_days")
    return placed.join(days, ["permno", "pos"])


def event_timing_shift(spark: SparkSession, folder: str) -> DataFrame:
    return _matched(order_events(spark, folder), calendar(spark, folder), True).select("event_id", "permno", day_text("dt").alias("event_date"), "pos")


def asof_forward(spark: SparkSession, folder: str) -> DataFrame:
    events = order_events(spark, folder)
    days = calendar(spark, folder)
    placed = asof_position(events, days, "call_date", "forward").where("pos is not null")
    return placed.join(days.select("permno", "pos", "dt"), ["permno", "pos"]).select("event_id", "permno", day_text("dt").alias("event_date"))


def _modelled(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    days = trailing_moments(calendar(spark, folder), "exret", names).where("n_days >= 100")
    matched = _matched(order_events(spark, folder), days)
    return abnormal_returns(matched.select("event_id", "permno", "dt", "exret", *names, "m", "n_obs"), "exret", names)


def ar_one_factor(spark: SparkSession, folder: str) -> DataFrame:
    return winsorized(_modelled(spark, folder, ("mktrf",)), "ar").select("event_id", "permno", F.round("ar", 8).alias("ar"))


def ar_four_factor(spark: SparkSession, folder: str) -> DataFrame:
    return winsorized(_modelled(spark, folder, FACTORS), "ar").select("event_id", "permno", F.round("ar", 7).alias("ar"))


def market_car(spark: SparkSession, folder: str) -> DataFrame:
    """event_study_slice: abnormal return and forward 63-row market-adjusted sum."""
    days = trailing_moments(calendar(spark, folder), "exret", ("mktrf",))
    days = forward_sums(days, {"car": (F.col("exret") - F.col("mktrf"), 63)}).where("n_days >= 100")
    matched = _matched(order_events(spark, folder), days)
    fitted = abnormal_returns(matched.select("event_id", "permno", "exret", "mktrf", "car", "m", "n_obs"), "exret", ("mktrf",))
    return winsorized(fitted, "ar").select("event_id", "permno", F.round("ar", 8).alias("ar"), F.round("car", 8).alias("car_63"))


def firm_years(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("permno"), F.year("l_shipdate").alias("year")).agg(
        F.sum("l_extendedprice").alias("me"), F.sum(F.col("l_quantity") * 1000).alias("be")
    )
    listed = read_table(spark, folder, "supplier").select(F.col("s_suppkey").alias("permno"), (F.col("s_nationkey") < 12).alias("nyse"))
    return lines.join(listed, "permno").withColumn("bm", F.col("be") / F.col("me"))


def ff6_breakpoints(spark: SparkSession, folder: str) -> DataFrame:
    b = portfolios.breakpoints(stored(firm_years(spark, folder).where("bm > 0")))
    return b.select("year", *[F.round(c, 6).alias(c) for c in ("me_median", "bm_30", "bm_70")])


def ff6_assign(spark: SparkSession, folder: str) -> DataFrame:
    return portfolios.assigned(firm_years(spark, folder)).select("permno", "year", "portfolio")


def portfolio_returns(daily: DataFrame, assigned: DataFrame) -> DataFrame:
    """The six portfolios' mean return, one row per day."""
    held = assigned.withColumn("year", F.col("year") + 1)
    return daily.withColumn("year", F.year("dt")).join(held, ["permno", "year"]).groupBy("dt").agg(*[F.avg(F.when(F.col("portfolio") == c, F.col("ret"))).alias(c) for c in portfolios.CODES])


def event_portfolio(spark: SparkSession, folder: str) -> DataFrame:
    events = order_events(spark, folder).withColumn("form_year", portfolios.assign_year(F.col("call_date")))
    return portfolios.portfolio_of(events, ff6_assign(spark, folder), "form_year").select("event_id", "permno", "form_year", "portfolio")


def _cars(spark: SparkSession, folder: str) -> DataFrame:
    """Forward sums of return minus the event's own portfolio. A frame of rows is the same for all
    events of a firm, so the six differences are summed once per firm-day and each event picks its
    column."""
    daily, held = stored(daily_returns(spark, folder)), stored(ff6_assign(spark, folder))
    days = positions(daily.join(portfolio_returns(daily, held), "dt", "left"))
    sums = {f"c{h}_{c}": (F.col("ret") - F.col(c), h) for h in HORIZONS for c in portfolios.CODES}
    days = forward_sums(days, sums).where("n_days >= 50").drop("ret", "dt", "n_days", *portfolios.CODES)
    events = order_events(spark, folder).withColumn("form_year", portfolios.assign_year(F.col("call_date")))
    events = portfolios.portfolio_of(events, held, "form_year")
    placed = asof_position(events, positions(daily), "call_date", "forward").where("pos is not null")

    def own(h: int) -> Column:
        chosen = F.col(f"c{h}_{portfolios.DEFAULT}")
        for c in portfolios.CODES:
            chosen = F.when(F.col("portfolio") == c, F.col(f"c{h}_{c}")).otherwise(chosen)
        return F.round(chosen, 8).alias(f"car_{h}d")

    return placed.join(days, ["permno", "pos"]).select("event_id", "permno", *[own(h) for h in HORIZONS])


def car_summed(spark: SparkSession, folder: str) -> DataFrame:
    return _cars(spark, folder)


def car_compounded(spark: SparkSession, folder: str) -> DataFrame:
    days = calendar(spark, folder).withColumn("x", F.col("ret") - (F.col("mktrf") + RF))
    days = days.withColumns({"car_63": forward_compound(F.col("x"), 63), "bhar_63": forward_compound(F.col("ret"), 63)})
    placed = _matched(order_events(spark, folder), days.select("permno", "pos", "dt", "car_63", "bhar_63"))
    return placed.select("event_id", "permno", *[F.round(c, 8).alias(c) for c in ("car_63", "bhar_63")])


def sentinel_filter(spark: SparkSession, folder: str) -> DataFrame:
    return drop_sentinels(read_table(spark, folder, "abnormal_returns"), "ret").select("event_id", "permno", day_text("event_date").alias("event_date"), "ret")


def winsorize(spark: SparkSession, folder: str) -> DataFrame:
    clipped = winsorized(drop_sentinels(read_table(spark, folder, "abnormal_returns"), "ret"), "abnormal_return")
    return clipped.select("event_id", "permno", F.round("abnormal_return", 9).alias("abnormal_return"))


def hfl_category_global(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "abnormal_returns")
    cut = with_quantiles(events, [], F.abs("abnormal_return"), [1 / 3], "cut")
    return cut.select("event_id", "permno", hfl(F.col("abnormal_return"), F.col("cut")[0]).alias("category"))


_DAILY = "daily as (select l_suppkey permno, cast(l_shipdate as date) dt, avg(l_discount) - avg(l_tax) ret from lineitem group by 1, 2)"
_FACTORS = """factors as (select cast(l_shipdate as date) dt, avg(l_discount) - avg(l_tax) mktrf,
 avg(case when l_quantity > 25 then l_discount end) - avg(case when l_quantity <= 25 then l_discount end) smb,
 avg(case when l_returnflag = 'R' then l_discount end) - avg(case when l_returnflag <> 'R' then l_discount end) hml,
 avg(case when l_linestatus = 'O' then l_discount end) - avg(case when l_linestatus <> 'O' then l_discount end) umd from lineitem group by 1)"""
_EVENTS = """ev as (select o_orderkey event_id, min(l_suppkey) permno, any_value(cast(o_orderdate as date)) call_date,
 case o_orderkey % 3 when 0 then true when 1 then false end before_close from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey)"""
_CALENDAR = f"""with {_DAILY}, {_FACTORS}, {_EVENTS},
cal as (select permno, dt, ret, ret - 0.0001 exret, mktrf, smb, hml, umd, row_number() over w - 1 pos, count(*) over (partition by permno) n_days
 from daily join factors using (dt) window w as (partition by permno order by dt)),
m as (select ev.event_id, ev.permno, ev.before_close, c.pos, c.n_days, c.dt from ev asof join cal c on c.permno = ev.permno and c.dt <= ev.call_date)"""
TIMING_SQL = f"""{_CALENDAR}, s as (select event_id, permno, case when before_close = false and pos + 1 < n_days then pos + 1 else pos end pos from m)
select s.event_id, s.permno, strftime(c.dt, '%Y-%m-%d') event_date, s.pos from s join cal c using (permno, pos)"""
FORWARD_SQL = f"{_CALENDAR} select ev.event_id, ev.permno, strftime(c.dt, '%Y-%m-%d') event_date from ev asof join cal c on c.permno = ev.permno and c.dt >= ev.call_date"


def _ar_sql(names: tuple[str, ...], digits: int) -> str:
    """The event row and its window, residualised on one factor after the other."""
    complete = " and ".join(f"c.{f} is not null" for f in names)
    sql = f"""{_CALENDAR}, sl0 as (select m.event_id, m.permno, c.pos = m.pos ise, c.exret y, {', '.join(f'c.{f}' for f in names)} from m join cal c
 on c.permno = m.permno and (c.pos = m.pos or (c.pos between m.pos - 257 and m.pos - 6 and {complete} and c.exret is not null)) where m.n_days >= 100)"""
    for i, f in enumerate(names):
        rest = [*names[i + 1 :], "y"]
        w = "over (partition by event_id)"
        fit = lambda v: f"{v} - (regr_intercept(case when not ise then {v} end, {f}) {w}) - (regr_slope(case when not ise then {v} end, {f}) {w}) * {f} {v}"  # noqa: B023, E731
        sql += f", sl{i + 1} as (select event_id, permno, ise, {', '.join(fit(v) for v in rest)} from sl{i})"
    last = len(names)
    return sql + f""", n as (select event_id from sl0 where not ise group by 1 having count(*) >= 60),
a as (select event_id, permno, y ar from sl{last} where ise and event_id in (select event_id from n)),
q as (select quantile_cont(ar, 0.01) lo, quantile_cont(ar, 0.99) hi from a)
select event_id, permno, round(case when ar is not null then least(greatest(ar, lo), hi) end, {digits}) ar from a, q"""


SLICE_SQL = (
    _ar_sql(("mktrf",), 8)
    .replace("select event_id, permno, round(case", ", f as (select event_id, permno, round(case")
    .replace(" ar from a, q", """ ar from a, q),
fw as (select permno, pos, sum(exret - mktrf) over w s, count(exret - mktrf) over w n from cal window w as (partition by permno order by dt rows between 1 following and 63 following))
select f.event_id, f.permno, f.ar, round(case when fw.n >= 31.5 then fw.s end, 8) car_63 from f join m using (event_id) join fw on fw.permno = m.permno and fw.pos = m.pos""")
)
_YEARS = """fy as (select l_suppkey permno, year(l_shipdate) "year", sum(l_extendedprice) me, sum(l_quantity * 1000) / sum(l_extendedprice) bm, any_value(s_nationkey < 12) nyse
 from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
bp as (select "year", case when count(*) filter (nyse) < 10 then quantile_cont(me, 0.5) else quantile_cont(me, 0.5) filter (nyse) end me_median,
 case when count(*) filter (nyse) < 10 then quantile_cont(bm, 0.3) else quantile_cont(bm, 0.3) filter (nyse) end bm_30,
 case when count(*) filter (nyse) < 10 then quantile_cont(bm, 0.7) else quantile_cont(bm, 0.7) filter (nyse) end bm_70 from fy where bm > 0 group by 1),
pf as (select permno, "year", (case when me <= me_median then 'sm' else 'bi' end) || (case when bm <= bm_30 then 'lo' when bm <= bm_70 then 'me' else 'hi' end) portfolio
 from fy join bp using ("year") where bm > 0)"""
BREAKPOINTS_SQL = f'with {_YEARS} select "year", round(me_median, 6) me_median, round(bm_30, 6) bm_30, round(bm_70, 6) bm_70 from bp'
ASSIGN_SQL = f'with {_YEARS} select permno, "year", portfolio from pf'
_PORTFOLIO = """evp as (select ev.event_id, ev.permno, ev.call_date, case when month(call_date) >= 7 then year(call_date) else year(call_date) - 1 end form_year from ev)"""
PORTFOLIO_SQL = f"""with {_EVENTS}, {_YEARS}, {_PORTFOLIO} select event_id, e.permno, form_year, coalesce(a.portfolio, b.portfolio, 'smme') portfolio from evp e
left join pf a on a.permno = e.permno and a."year" = form_year left join pf b on b.permno = e.permno and b."year" = form_year - 1"""
_CODES = portfolios.CODES
CAR_SQL = f"""with {_DAILY}, {_EVENTS}, {_YEARS}, {_PORTFOLIO},
pr as (select dt, {', '.join(f"avg(ret) filter (portfolio = '{c}') {c}" for c in _CODES)} from daily join pf on pf.permno = daily.permno and pf."year" + 1 = year(dt) group by 1),
cal as (select d.*, row_number() over (partition by d.permno order by d.dt) pos, count(*) over (partition by d.permno) n_days, {', '.join(f"pr.{c}" for c in _CODES)} from daily d left join pr using (dt)),
e as (select x.event_id, x.permno, x.portfolio, c.pos from (select e.*, coalesce(a.portfolio, b.portfolio, 'smme') portfolio from evp e
 left join pf a on a.permno = e.permno and a."year" = form_year left join pf b on b.permno = e.permno and b."year" = form_year - 1) x
 asof join cal c on c.permno = x.permno and c.dt >= x.call_date where c.n_days >= 50),
d as (select e.event_id, e.permno, c.pos - e.pos k, c.ret - case e.portfolio {' '.join(f"when '{c}' then c.{c}" for c in _CODES)} end x
 from e join cal c on c.permno = e.permno and c.pos between e.pos + 1 and e.pos + 252)
select e.event_id, e.permno, {', '.join(f"round(case when count(x) filter (k <= {h}) >= {h} * 0.5 then sum(x) filter (k <= {h}) end, 8) car_{h}d" for h in HORIZONS)}
from e left join d using (event_id) group by 1, 2"""
COMPOUND_SQL = f"""{_CALENDAR}, fw as (select permno, pos, count(*) over w n, product(1 + ret - (mktrf + 0.0001)) over w - 1 c, product(1 + ret) over w - 1 b
 from cal window w as (partition by permno order by dt rows between 1 following and 63 following))
select event_id, m.permno, round(case when n > 0 then c end, 8) car_63, round(case when n > 0 then b end, 8) bhar_63 from m join fw using (permno, pos)"""
_SENTINEL = "ret is not null and not isnan(ret) and ret not in (-66, -77, -88, -99)"
SENTINEL_SQL = f"select event_id, permno, strftime(event_date, '%Y-%m-%d') event_date, ret from abnormal_returns where {_SENTINEL}"
WINSOR_SQL = f"""with a as (select * from abnormal_returns where {_SENTINEL}), q as (select quantile_cont(abnormal_return, 0.01) lo, quantile_cont(abnormal_return, 0.99) hi from a)
select event_id, permno, round(case when abnormal_return is not null then least(greatest(abnormal_return, lo), hi) end, 9) abnormal_return from a, q"""
HFL_SQL = """with q as (select quantile_cont(abs(abnormal_return), 1.0 / 3) cut from abnormal_returns)
select event_id, permno, case when abnormal_return > cut then 'H' when abnormal_return < -cut then 'L' else 'F' end category from abnormal_returns, q"""

QUERIES = {
    "event_study_slice": market_car, "ar_one_factor": ar_one_factor, "ar_four_factor": ar_four_factor, "event_timing_shift": event_timing_shift,
    "asof_forward": asof_forward, "car_summed": car_summed, "car_compounded": car_compounded, "sentinel_filter": sentinel_filter, "winsorize": winsorize,
    "hfl_category_global": hfl_category_global, "ff6_breakpoints": ff6_breakpoints, "ff6_assign": ff6_assign, "event_portfolio": event_portfolio,
}
ORACLES = {
    "event_study_slice": SLICE_SQL, "ar_one_factor": _ar_sql(("mktrf",), 8), "ar_four_factor": _ar_sql(FACTORS, 7), "event_timing_shift": TIMING_SQL,
    "asof_forward": FORWARD_SQL, "car_summed": CAR_SQL, "car_compounded": COMPOUND_SQL, "sentinel_filter": SENTINEL_SQL, "winsorize": WINSOR_SQL,
    "hfl_category_global": HFL_SQL, "ff6_breakpoints": BREAKPOINTS_SQL, "ff6_assign": ASSIGN_SQL, "event_portfolio": PORTFOLIO_SQL,
}
