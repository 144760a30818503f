"""Market-shaped views over the given tables, as SQL text both engines run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = "(select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e"

VIEWS: dict[str, str] = {
    "market_records": f"""select event_id as ingest_seq, ts as event_time, concat('T', cast(user_id % 10 as string)) as ticker,
  case event_type when 'purchase' then 'trade' when 'view' then 'quote' when 'click' then 'tbbo' else event_type end as record_type,
  case when event_type in ('purchase','error') then value + 1 end as price,
  case when event_type = 'purchase' then cast(k + 1 as double) end as size,
  case when event_type in ('view','click') then value + 1 end as bid_price,
  case when event_type in ('view','click') then value + 1 + (k % 7) / 100.0e0 end as ask_price,
  case when event_type in ('view','click') then cast(k as double) end as bid_size,
  case when event_type in ('view','click') then cast(k + 2 as double) end as ask_size
from {_K}""",
    "model_signals": f"""select event_id as seq, concat('S', cast(event_id as string)) as signal_id, ts as signal_time,
  concat('T', cast(user_id % 10 as string)) as ticker,
  case event_type when 'purchase' then 'BUY' when 'click' then 'SELL' when 'view' then 'HOLD' when 'signup' then 'EXIT' else 'DO_NOTHING' end as signal,
  k / 100.0e0 as confidence, value + 1 as midprice, case when k % 11 = 0 then null else (k % 9) / 100.0e0 end as spread,
  cast(k * 13 % 1500 as double) as latency_ms, cast(k % 8 as bigint) as data_age_seconds, (k % 40) - 10.0e0 as expected_gross_move_bps,
  cast(k * 5 + 1 as double) as quantity, k
from {_K}""",
    "fills": """select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as fill_id,
  concat('T', cast(l_partkey % 20 as string)) as ticker,
  case when l_returnflag = 'N' or (l_returnflag = 'R' and l_linestatus = 'O') then 'SELL' else 'BUY' end as side,
  l_quantity as quantity, l_extendedprice / l_quantity as fill_price, l_shipdate as fill_time, cast(l_orderkey as string) as order_id,
  l_orderkey as o1, l_linenumber as o2, l_partkey as o3, l_suppkey as o4, l_extendedprice as o5, l_discount as discount
from lineitem""",
    "evidence": f"""select concat('E', cast(event_id as string)) as evidence_id,
  case when k % 10 = 0 then null else ts end as available_at,
  case when k % 3 = 0 then null else ts + interval '6' hour end as valid_until,
  case when k % 4 = 3 then 'GLOBAL' else 'TICKER' end as scope,
  case when k % 4 = 3 then '*' else concat('T', cast(user_id % 10 as string)) end as scope_target,
  concat('FLAG_TYPE:K', cast(k % 5 as string)) as policy_match_key, k % 13 <> 0 as policy_eligible, k
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e""",
    "context_updates": f"""select event_id as arrival_seq,
  case user_id % 3 when 0 then 'GLOBAL' when 1 then 'TICKER' else 'SECTOR' end as scope,
  case when user_id % 3 = 0 then '*' when user_id % 3 = 1 then concat('T', cast(user_id % 10 as string)) else concat('G', cast(user_id % 4 as string)) end as target,
  concat('n', cast(k % 4 as string)) as name, ts - (k % 5) * interval '1' hour as updated_at,
  case when k % 2 = 0 then ts + interval '12' hour end as valid_until,
  case k % 5 when 0 then 'INFO' when 1 then 'LOW' when 2 then 'MEDIUM' when 3 then 'HIGH' else 'CRITICAL' end as severity,
  cast(k % 3 as string) as value,
  case k % 6 when 0 then 'macro_calendar_v1' when 1 then 'eia_wpsr_v1' when 2 then 'fred_rates_v1' when 3 then 'usaspending_awards_v1' when 4 then 'yfinance_dev_raw_v1' else 'other_feed' end as source
from {_K}""",
    "observations": """select case o_orderpriority when '1-URGENT' then 'SHORT' when '2-HIGH' then 'MID' else 'LONG' end as series,
  cast(o_orderdate as date) as observation_date, max(o_totalprice) / 100000.0e0 as value
from orders group by 1, 2""",
    "bars": """select concat('T', cast(user_id % 10 as string)) as symbol, cast(ts as date) as bar_day, max(value) as close, count(*) as n
from events group by 1, 2""",
    "health_events": """select event_id, ts as event_time,
  case user_id % 4 when 0 then 'feed' when 1 then 'risk' when 2 then 'ledger' else 'broker' end as component,
  case event_type when 'error' then 'ERROR' when 'click' then 'warning' when 'view' then 'Warning' else 'OK' end as status
from events""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of one scale directory (tables are bound by name, not registered)."""
    base = next(t for t in ("events", "lineitem", "orders") if f"from {t}" in VIEWS[name])
    return spark.sql(VIEWS[name].replace(f"from {base}", "from {base}"), base=table(spark, sf_dir, base))


def with_views(*names: str) -> str:
    """Opening of a SQL text: the views as common table expressions."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in names)
