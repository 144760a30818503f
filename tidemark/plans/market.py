"""Registered queries: scan, rolling features, as-of prices, labels, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import r6
from tidemark.functions.times import HOUR, micros
from tidemark.operators import cost as costs
from tidemark.operators.asof import asof_join
from tidemark.operators.labels import LabelConfig, labels as build_labels
from tidemark.operators.live import live_totals
from tidemark.operators.market import observations, spread_bps
from tidemark.operators.parity import differences, name_sets, out_of_order, report
from tidemark.operators.rolling import final_snapshot, frame_totals, rolling_features as build_features
from tidemark.plans.registry import query
from tidemark.plans.views import table, view, with_views
from tidemark.sources.market import column_mapping, normalise
from tidemark.streaming.live import live_features
from tidemark.streaming.runner import in_slices, slices_for

LOOKBACK = 21_600

_TRADE = "(record_type in ('trade','trades','tbbo_trade') or (price is not null and size is not null and bid_price is null and ask_price is null))"
_QUOTE = "(record_type in ('quote','bbo','mbp-1','tbbo','bbo-1s','bbo-1m') or (bid_price is not null and ask_price is not null))"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical records: the view through the scan's own normalisation."""
    raw = view(spark, sf, "market_records")
    mapping = column_mapping(source_event_time=None, local_receive_time=None, trace_id=None, midprice=None, spread=None)
    return normalise(raw, mapping, naive_zone="UTC", keep=("ingest_seq",))


@query("S1 S2 S3 S4 P1 P2", with_views("market_records") + f"""
select ingest_seq, epoch_us(event_time) as event_us, ticker, record_type, price, size, {_TRADE} as is_trade, {_QUOTE} as is_quote,
  round((bid_price + ask_price) / 2, 6) as mid, round(ask_price - bid_price, 6) as spread,
  round(case when (bid_price + ask_price) / 2 > 0 then (ask_price - bid_price) / ((bid_price + ask_price) / 2) * 10000 end, 6) as spread_bps,
  'historical_parquet' as source
from market_records""")
def market_scan(spark, sf):
    df = observations(records(spark, sf))
    return df.select("ingest_seq", micros("event_time").alias("event_us"), "ticker", "record_type", "price", "size",
                     "is_trade", "is_quote", r6(F.col("mid_obs")).alias("mid"), r6(F.col("spread_obs")).alias("spread"),
                     r6(spread_bps(F.col("spread_obs"), F.col("mid_obs"))).alias("spread_bps"), "source")


_OBS = f"""obs as (select *, {_TRADE} as tr, {_QUOTE} as qu, (bid_price + ask_price) / 2 as mid, ask_price - bid_price as sp,
  bid_price is not null and ask_price is not null as both_sides from market_records)"""
_W = "window w as (partition by ticker order by event_time range between interval 6 hours preceding and current row)"

_ROLLING = with_views("market_records") + f""", {_OBS},
f as (select ingest_seq, ticker, event_time, count(*) over w as n, count(*) filter (where tr) over w as nt, count(*) filter (where qu) over w as nq,
  last_value(case when tr then price end ignore nulls) over w as tp, last_value(case when tr then size end ignore nulls) over w as ts_,
  last_value(bid_price ignore nulls) over w as b, last_value(ask_price ignore nulls) over w as a,
  last_value(bid_size ignore nulls) over w as bs, last_value(ask_size ignore nulls) over w as as_,
  last_value(mid ignore nulls) over w as m, last_value(sp ignore nulls) over w as s,
  last_value(case when both_sides then bid_price >= ask_price end ignore nulls) over w as x,
  coalesce(sum(case when tr then size end) over w, 0) as v from obs {_W})
select ingest_seq, ticker, epoch_us(event_time) as event_us, n as record_count_window, nt as trade_count_window, nq as quote_count_window,
  coalesce(tp, m) as last_price, tp as last_trade_price, ts_ as last_trade_size, b as last_bid_price, a as last_ask_price,
  bs as last_bid_size, as_ as last_ask_size, round(m, 6) as midprice, round(s, 6) as spread,
  round(case when m > 0 then s / m * 10000 end, 6) as spread_bps, coalesce(x, false) as is_crossed_or_locked, v as volume_window
from f"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select("ingest_seq", "ticker", micros("event_time").alias("event_us"), "record_count_window", "trade_count_window",
                     "quote_count_window", "last_price", "last_trade_price", "last_trade_size", "last_bid_price", "last_ask_price",
                     "last_bid_size", "last_ask_size", r6(F.col("midprice")).alias("midprice"), r6(F.col("spread")).alias("spread"),
                     r6(F.col("spread_bps")).alias("spread_bps"), "is_crossed_or_locked", "volume_window")


@query("W1 W2 A9 P3", _ROLLING)
def rolling_features(spark, sf):
    return _flat(build_features(records(spark, sf), lookback_seconds=LOOKBACK))


@query("W3", with_views("market_records") + f""", {_OBS},
f as (select ingest_seq, ticker, list(case when tr then price end) filter (where tr and price is not null) over w as p,
  list(mid) filter (where mid is not null) over w as m from obs {_W}),
g as (select *, case when len(m) >= 2 then list_transform(list_filter(range(1, len(m)), lambda i: m[i] > 0), lambda i: m[i+1] / m[i] - 1) end as r from f)
select ingest_seq, ticker, round(case when len(p) >= 2 and p[1] > 0 then p[len(p)] / p[1] - 1 end, 6) as price_return_window,
  round(case when len(m) >= 2 and m[1] > 0 then m[len(m)] / m[1] - 1 end, 6) as midprice_return_window,
  round(case when len(m) >= 2 then m[len(m)] - m[len(m) - 1] end, 6) as midprice_change_from_previous,
  round(case when len(r) >= 2 then list_aggregate(r, 'stddev_pop') end, 6) as simple_volatility_window
from g""")
def rolling_returns(spark, sf):
    df = build_features(records(spark, sf), lookback_seconds=LOOKBACK)
    return df.select("ingest_seq", "ticker", *[r6(F.col(c)).alias(c) for c in (
        "price_return_window", "midprice_return_window", "midprice_change_from_previous", "simple_volatility_window")])


@query("T1 W1", _ROLLING + " qualify row_number() over (partition by ticker order by event_time desc, ingest_seq desc) = 1")
def final_features(spark, sf):
    return _flat(final_snapshot(build_features(records(spark, sf), lookback_seconds=LOOKBACK)))


@query("W1", with_views("fills") + """, f as (select *, concat('T', cast(o3 % 5 as string)) as tk, date_diff('day', date '1970-01-01', cast(fill_time as date)) as d from fills),
g as (select *, row_number() over (partition by tk order by d, o1, o2, o3, o4, o5, quantity) as rn,
  sum(quantity) over (partition by tk order by d, o1, o2, o3, o4, o5, quantity rows unbounded preceding) as rs,
  count(*) over old as cn, coalesce(sum(quantity) over old, 0) as cs from f
  window old as (partition by tk order by d range between unbounded preceding and 31 preceding))
select tk as ticker, d as day, o1, o2, o3, o4, o5, quantity, rn - cn as frame_rows, round(rs - cs, 6) as frame_sum from g""")
def tie_exact_window(spark, sf):
    f = view(spark, sf, "fills").select(
        F.concat(F.lit("T"), (F.col("o3") % 5).cast("string")).alias("ticker"),
        F.datediff(F.to_date("fill_time"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"),
        "o1", "o2", "o3", "o4", "o5", "quantity")
    out = frame_totals(f, key="ticker", at="day", order=["o1", "o2", "o3", "o4", "o5", "quantity"], value="quantity",
                       lookback=30)
    return out.withColumn("frame_sum", r6(F.col("frame_sum")))


_ARRIVAL = "(ingest_seq + (ingest_seq % 97) * 40) * 128 + ingest_seq % 97"


@query("X1 X2", with_views("market_records") + f""", r as (select ticker, epoch_us(event_time) as t, {_ARRIVAL} as arrival, size from market_records),
m as (select *, max(t) over (partition by ticker order by arrival rows unbounded preceding) as max_time from r)
select a.ticker, a.arrival, a.t, a.max_time, count(*) as live_rows, round(coalesce(sum(b.size), 0), 6) as live_volume
from m a join r b on a.ticker = b.ticker and b.arrival <= a.arrival and b.t >= a.max_time - {LOOKBACK}000000
group by 1, 2, 3, 4""")
def live_window(spark, sf):
    r = records(spark, sf).select("ticker", micros("event_time").alias("t"), F.expr(_ARRIVAL).alias("arrival"), "size")
    out = live_totals(r, key="ticker", at="t", arrival="arrival", values={"volume": "size"}, lookback=LOOKBACK * 1_000_000)
    return out.select("ticker", "arrival", "t", "max_time", "live_rows", r6(F.col("live_volume")).alias("live_volume"))


@query("W1", "select 'sliced_vs_plain' as pair, count(*) as compared, cast(0 as bigint) as differing from events")
def parity_diff(spark, sf):
    r = records(spark, sf)
    plain = build_features(r, lookback_seconds=LOOKBACK, sliced=False)
    cut = build_features(r, lookback_seconds=LOOKBACK, sliced=True)
    columns = [c for c in plain.columns if c not in ("ticker", "ingest_seq", "event_time")]
    bad = differences(plain, cut, ["ticker", "ingest_seq"], columns)
    both = plain.select(F.lit(1).alias("compared"), F.lit(0).alias("differing")).unionByName(
        bad.select(F.lit(0).alias("compared"), F.lit(1).alias("differing")))
    return both.groupBy(F.lit("sliced_vs_plain").alias("pair")).agg(
        F.sum("compared").cast("long").alias("compared"), F.sum("differing").cast("long").alias("differing"))


_SIDES = {
    "last_trade_price": "case when tr then price end", "last_trade_size": "case when tr then size end", "last_bid_price": "bid_price",
    "last_ask_price": "ask_price", "last_bid_size": "bid_size", "last_ask_size": "ask_size", "midprice": "mid", "spread": "sp"}
_COUNTS = {"record_count_window": "count(*)", "trade_count_window": "count(*) filter (where tr)", "quote_count_window": "count(*) filter (where qu)",
           "volume_window": "coalesce(sum(case when tr then size end), 0)"}


def _parity_sql() -> str:
    """Both sides from the records: last values by event time and by arrival, in the frame that ends at the newest event."""
    last = ", ".join(f"arg_max({v}, event_time) filter (where ({v}) is not null) as h_{n}, arg_max({v}, arrival) filter (where ({v}) is not null) as l_{n}"
                     for n, v in _SIDES.items())
    same = {n: f"(h_{n} is null and l_{n} is null) or coalesce(abs(h_{n} - l_{n}) <= 1e-12 * greatest(1, abs(h_{n}), abs(l_{n})), false)" for n in _SIDES}
    names = ", ".join(f"case when not ({same[n]}) then '{n}' end" for n in sorted(_SIDES))
    return with_views("market_records") + f""", {_OBS},
feeds as (select 'late' as feed, {_ARRIVAL} as arrival, * from obs union all select 'ordered', ingest_seq, * from obs),
o as (select *, max(event_time) over (partition by feed, ticker order by arrival rows between unbounded preceding and 1 preceding) as seen,
  max(event_time) over (partition by feed, ticker) as newest from feeds),
c as (select feed, ticker, count(*) filter (where event_time < seen) as out_of_order from o group by 1, 2),
w as (select feed, ticker, {last} from o where event_time >= newest - interval 6 hours group by 1, 2),
d as (select feed, ticker, list_filter([{names}], lambda x: x is not null) as names from w)
select feed, ticker, cast({len(_SIDES) + len(_COUNTS)} as bigint) as compared, len(names) as differing, array_to_string(names, ',') as names, out_of_order from d join c using (feed, ticker)"""


@query("X3 U2", _parity_sql())
def feature_parity(spark, sf):
    """Batch features by event time (prefix arrays) against the live state machine by arrival, for an ordered feed and a late one."""
    r = records(spark, sf)
    columns = [*_COUNTS, *_SIDES]
    batch = final_snapshot(build_features(r, lookback_seconds=LOOKBACK)).select("ticker", *columns)
    out = None
    for feed, arrival in (("ordered", "ingest_seq"), ("late", _ARRIVAL)):
        arriving = r.withColumn("arrival", F.expr(arrival))
        live = in_slices(arriving, "arrival", slices_for(arriving, ["ticker"], 5), lambda s: live_features(s, arrival="arrival", lookback_seconds=LOOKBACK), f"parity-{feed}")
        last = live.groupBy("ticker").agg(F.max_by(F.struct(*columns), "arrival").alias("_r")).select("ticker", "_r.*")
        wrong = out_of_order(arriving.withColumn("_t", micros("event_time")), key="ticker", at="_t", order=["arrival"]).groupBy("ticker").agg(
            F.count(F.lit(1)).alias("out_of_order"))
        one = report(batch, last, ["ticker"], columns).join(wrong, "ticker", "left").select(
            F.lit(feed).alias("feed"), "ticker", "compared", "differing", F.array_join("names", ",").alias("names"), F.coalesce("out_of_order", F.lit(0)).alias("out_of_order"))
        out = one if out is None else out.unionByName(one)
    return out


_NAMES = ["last_ask_price", "last_ask_size", "last_bid_price", "last_bid_size", "last_trade_price", "last_trade_size", "midprice", "spread"]


@query("U2", _ROLLING.rsplit("select ingest_seq, ticker, epoch_us", 1)[0] + """, k as (select ticker, list_filter([case when a is null then 'last_ask_price' end, case when as_ is null then 'last_ask_size' end,
  case when b is null then 'last_bid_price' end, case when bs is null then 'last_bid_size' end, case when tp is null then 'last_trade_price' end,
  case when ts_ is null then 'last_trade_size' end, case when m is null then 'midprice' end, case when s is null then 'spread' end], lambda x: x is not null) as missing from f)
select ticker, array_to_string(missing, ',') as missing, '' as unexpected, count(*) as rows from k group by 1, 2""")
def feature_name_sets(spark, sf):
    """Which features a snapshot lacks, for every set of names that occurs."""
    df = build_features(records(spark, sf), lookback_seconds=LOOKBACK).select("ticker", *_NAMES)
    return name_sets(df, _NAMES, ["ticker"]).select("ticker", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"), "rows")


@query("J1", with_views("market_records") + """, p as (select ingest_seq, ticker, event_time + interval 5 minutes as target from market_records where record_type = 'trade'),
o as (select ticker, event_time, (bid_price + ask_price) / 2 as mid from market_records where bid_price is not null)
select p.ingest_seq, p.ticker, epoch_us(p.target) as target_us, coalesce(epoch_us(o.event_time), -1) as forward_us, round(o.mid, 6) as forward_mid
from p asof left join o on p.ticker = o.ticker and p.target <= o.event_time""")
def forward_asof(spark, sf):
    obs = observations(records(spark, sf))
    probes = obs.filter(F.col("record_type") == "trade").select(
        "ingest_seq", "ticker", (micros("event_time") + F.lit(300_000_000)).alias("target_us"))
    quotes = obs.filter(F.col("mid_obs").isNotNull()).select(
        "ticker", micros("event_time").alias("forward_us"), r6(F.col("mid_obs")).alias("forward_mid"), F.col("ingest_seq").alias("quote_seq"))
    out = asof_join(probes, quotes, keys=["ticker"], left_at="target_us", right_at="forward_us", right_order=["quote_seq"],
                    right_cols=["forward_us", "forward_mid"], direction="forward")
    return out.na.fill(-1, ["forward_us"])


def _cost_sql(src: str, style: str, extra: str) -> str:
    """Cost columns over rows with mid, spread dollars, move, horizon, quantity."""
    return f"""c1 as (select *, coalesce(case when mid > 0 then spread / mid * 10000 end, 0) as given from {src}),
c2 as (select *, case when given = 0 then 1.0e0 else given end as sbps, 0.02e0 / mid * 10000 as slip,
  greatest(quantity - 100.0e0, 0) / 1000.0e0 * 0.25e0 as pen, case {style} when 'MARKET' then 0 else case horizon when '1m' then 0.3e0 when '5m' then 0.2e0 else 0.1e0 end end as prob from c1),
c3 as (select *, (case {style} when 'MARKET' then sbps else 0 end) + slip + pen as base from c2),
c4 as (select *, base + prob * greatest(move - base, 0) as total from c3)
select {extra}, round(sbps, 6) as cost_spread_bps, round(base, 6) as base_cost_bps, round(total, 6) as total_cost_bps,
  round(move - total, 6) as net_expected_edge_bps, move - total > 1.0e0 as profitable_after_costs, given = 0 as fallback_spread_applied from c4"""


def _cost_out(df: DataFrame, *first) -> DataFrame:
    return df.select(*first, *[r6(F.col(c)).alias(c) for c in (
        "cost_spread_bps", "base_cost_bps", "total_cost_bps", "net_expected_edge_bps")],
        "profitable_after_costs", "fallback_spread_applied")


@query("J3 P4 P6 P7 J1", with_views("market_records") + """, q as (select ingest_seq, ticker, event_time, (bid_price + ask_price) / 2 as mid, ask_price - bid_price as spread
  from market_records where bid_price is not null),
s as (select * from q where spread > 0), h as (select s.*, horizon, enforce, s.event_time + sec * interval 1 second as target from s,
  (values ('1m', 60), ('5m', 300), ('15m', 900)) v(horizon, sec), (values (true), (false)) e(enforce)),
n as (select *, cast(event_time - interval 5 hours as time) as lt, cast(target - interval 5 hours as time) as tt,
  date_trunc('day', target - interval 5 hours) + interval 21 hours as close_at from h),
a as (select n.*, q.event_time as ft, q.mid as fmid from n asof left join q on n.ticker = q.ticker and n.target <= q.event_time),
k as (select *, 1.0e0 as quantity from a where ft <= target + interval 6 hours and (not enforce or (lt between time '09:30:00' and time '16:00:00'
  and tt between time '09:30:00' and time '16:00:00' and ft <= close_at))),
l as (select *, case side when 'BUY' then (fmid / mid - 1) * 10000 else (mid / fmid - 1) * 10000 end as move from k, (values ('BUY'), ('SELL')) z(side)),
""" + _cost_sql("l", "'MARKET'", "ingest_seq, ticker, enforce, horizon, side, epoch_us(ft) as forward_us, round(move, 6) as move_bps"))
def labels(spark, sf):
    obs = observations(records(spark, sf)).filter(F.col("mid_obs") > 0)
    prices = obs.select("ticker", "event_time", F.col("mid_obs").alias("midprice"), "ingest_seq")
    snaps = obs.filter(F.col("spread_obs") > 0).select(
        F.col("ingest_seq").alias("snap_seq"), "ticker", F.col("event_time").alias("snapshot_time"),
        F.col("mid_obs").alias("midprice"), F.col("spread_obs").alias("spread"))
    out = []
    for enforce in (True, False):
        good, _ = build_labels(snaps, prices, LabelConfig(tolerance_seconds=21_600, enforce_session=enforce))
        out.append(_cost_out(good, F.col("snap_seq").alias("ingest_seq"), "ticker", F.lit(enforce).alias("enforce"), "horizon", "side",
                             micros("forward_event_time").alias("forward_us"), r6(F.col("expected_gross_move_bps")).alias("move_bps")))
    return out[0].unionByName(out[1])


@query("P5 P6", with_views("model_signals") + """, h as (select signal_id, signal as side, midprice as mid, spread, expected_gross_move_bps as move, quantity,
  case k % 3 when 0 then '1m' when 1 then '5m' else '15m' end as horizon, case k % 2 when 0 then 'MARKET' else 'LIMIT_AT_MID' end as style
  from model_signals where signal in ('BUY', 'SELL')),
""" + _cost_sql("h", "style", "signal_id, side, horizon, style as order_style"))
def cost_estimate(spark, sf):
    s = view(spark, sf, "model_signals").withColumns({
        "side": F.col("signal"), "horizon": F.expr("case k % 3 when 0 then '1m' when 1 then '5m' else '15m' end"),
        "order_style": F.expr("case k % 2 when 0 then 'MARKET' else 'LIMIT_AT_MID' end")})
    df = costs.estimate(s).filter(F.col("error").isNull())
    return _cost_out(df, "signal_id", "side", "horizon", "order_style")


@query("P7", with_views("bars") + """, b as (select symbol, bar_day, close + 1 as entry, lead(close + 1) over (partition by symbol order by bar_day) as leave from bars),
h as (select symbol, bar_day, side, entry as mid, cast(null as double) as spread, '5m' as horizon, 250.0e0 as quantity,
  case side when 'BUY' then (leave / entry - 1) * 10000 else (entry / leave - 1) * 10000 end as move
  from b, (values ('BUY'), ('SELL')) z(side) where leave is not null),
""" + _cost_sql("h", "'LIMIT'", "symbol, cast(bar_day as varchar) as bar_day, side, round(move, 6) as move_bps"))
def cost_mid_pair(spark, sf):
    b = view(spark, sf, "bars").select("symbol", "bar_day", (F.col("close") + 1).alias("entry_midprice"))
    nxt = asof_join(b.withColumn("_d", F.date_add("bar_day", 1)), b.select("symbol", "bar_day", "entry_midprice").withColumnsRenamed(
        {"bar_day": "_next", "entry_midprice": "exit_midprice"}), keys=["symbol"], left_at="_d", right_at="_next",
        right_cols=["exit_midprice"], direction="forward")
    rows = nxt.filter(F.col("exit_midprice").isNotNull()).withColumn("side", F.explode(F.array(F.lit("BUY"), F.lit("SELL")))).withColumns({
        "horizon": F.lit("5m"), "order_style": F.lit("LIMIT_AT_MID"), "quantity": F.lit(250.0), "spread": F.lit(None).cast("double")})
    df = costs.estimate_from_mids(rows).filter(F.col("error").isNull())
    return _cost_out(df, "symbol", F.col("bar_day").cast("string").alias("bar_day"), "side", r6(F.col("expected_gross_move_bps")).alias("move_bps"))
