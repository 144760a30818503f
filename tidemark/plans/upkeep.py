"""Registered queries: hydration, lineage, retries, bar preparation, next transitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import micros
from tidemark.operators import bars, calendar, classification, energy, evidence as ev, quality
from tidemark.plans.context import _DEC, decisions, evidence_rows
from tidemark.plans.registry import query
from tidemark.plans.views import table, view, with_views
from tidemark.session import shared_dir
from tidemark.sinks import ledger

_DAY = 86_400_000_000
#: Epoch micros of 2024-01-05 and 2024-01-25.
_RUN = ev.RunDefinition(tickers=tuple(f"T{i}" for i in range(7)), sources=("desk_flags",), start_us=1_704_412_800_000_000, end_us=1_706_140_800_000_000,
                        max_age_us=3 * _DAY)

_HYDRATED = with_views("model_signals", "evidence") + f""", {_DEC},
e as (select *, case when scope = 'TICKER' and k % 3 = 1 then 'G1' end as sec, case when k % 11 = 0 then 'eia_wpsr_v1' else 'desk_flags' end as src from evidence),
x as (select *, case when src <> 'desk_flags' or not (scope = 'GLOBAL' or sec is not null or scope_target in ('T0', 'T1', 'T2', 'T3', 'T4', 'T5', 'T6')) then 'SCOPE_MISMATCH'
  when available_at is null then 'MISSING_AVAILABILITY' when available_at > timestamp '2024-01-25' then 'FUTURE' when available_at < timestamp '2024-01-05' then 'OUTSIDE_LOOKBACK' end as reason from e)"""


def hydrated(spark, sf) -> tuple[DataFrame, DataFrame]:
    k = view(spark, sf, "evidence").select("evidence_id", "k")
    rows = evidence_rows(spark, sf).join(k, "evidence_id").withColumn("source", F.when(F.col("k") % 11 == 0, "eia_wpsr_v1").otherwise("desk_flags")).drop("k")
    return ev.hydrate(rows, _RUN)


@query("E3 E5", _HYDRATED + """ select coalesce(reason, 'ADMITTED') as outcome, count(*) as rows, cast(sum(cast(substr(evidence_id, 2) as bigint)) as bigint) as id_sum from x group by 1""")
def evidence_hydration(spark, sf):
    """What a run admits of the evidence, and why the rest stays out."""
    kept, out = hydrated(spark, sf)
    both = kept.select(F.lit("ADMITTED").alias("outcome"), "evidence_id").unionByName(out.select(F.col("reason").alias("outcome"), "evidence_id"))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.expr("cast(substring(evidence_id, 2) as bigint)")).alias("id_sum"))


@query("P32 E5", _HYDRATED + """, h as (select d.decision_id, count(*) as n, count(*) filter (where reason = 'MISSING_AVAILABILITY') as m
  from d join x on x.reason is not null and (x.scope = 'GLOBAL' or x.scope_target = d.ticker or coalesce(x.sec = d.sector, false))
    and (x.reason = 'MISSING_AVAILABILITY' or (x.available_at <= d.t and d.t - x.available_at <= interval '3' day)) group by 1)
select d.decision_id, d.t between timestamp '2024-01-08' and timestamp '2024-01-25' as covered, coalesce(n, 0) as n_concerned, coalesce(m, 0) as n_without_time from d left join h using (decision_id)""")
def hydration_exclusions(spark, sf):
    """Per decision the load-time exclusions in its scope and look-back, and whether the run covers it."""
    return ev.exclusion_hits(decisions(spark, sf), hydrated(spark, sf)[1], max_age_us=_RUN.max_age_us, run=_RUN)


@query("F19 J4", """with w as (select event_id, epoch_us(ts) - 900000000 as a, epoch_us(ts) + 2700000000 as z from events where event_type = 'purchase' and event_id % 3 = 0),
e as (select distinct unnest([a, z + 1]) as edge from w)
select p.event_id, coalesce(e.edge, -1) as next_us from events p asof left join e on epoch_us(p.ts) < e.edge""")
def release_transitions(spark, sf):
    """For every event the next instant at which a release window opens or has just closed."""
    events = table(spark, sf, "events")
    releases = events.where("event_type = 'purchase' and event_id % 3 = 0").select("event_id", F.col("ts").cast("timestamp").alias("release_at"))
    probes = events.select("event_id", F.col("ts").cast("timestamp").alias("evaluation_time"))
    out = energy.transitions(probes, energy.windows(releases, pre_minutes=15, post_minutes=45))
    return out.select("event_id", F.coalesce("next_transition", F.lit(-1)).alias("next_us"))


_SYMBOLS = [f"T{i}" for i in range(10)]
_BARS = with_views("bars") + """, o as (select symbol, bar_day, close, 0 as row_seq from bars),
r as (select * from o union all select symbol, bar_day, case when symbol = 'T3' and day(bar_day) = 10 then close + 1 when symbol = 'T5' then null else close end, 1 from o where day(bar_day) % 5 = 0),
bad as (select symbol, min(bar_day) as bar_day from (select symbol, bar_day from r where close > 0 group by 1, 2 having min(close) < max(close)) c group by 1),
k as (select * from r where row_seq = 0 and symbol not in (select symbol from bad))"""


@query("S11 W8 J25", _BARS + """ select 'kept' as outcome, symbol, bar_day, close from k where symbol not in ('T8', 'T9')
union all select 'unregistered', symbol, bar_day, close from k where symbol in ('T8', 'T9') union all select 'rejected', symbol, bar_day, null from bad
union all select 'missing', 'T77', null, null""")
def bar_preparation(spark, sf):
    """A wide table of closes made long, repeats resolved, conflicting symbols rejected, and the registry applied."""
    wide = view(spark, sf, "bars").groupBy("bar_day").pivot("symbol", _SYMBOLS).agg(F.first("close"))
    wide = wide.select("bar_day", *[F.col(s).alias(f"Close_{s}") for s in _SYMBOLS])
    again = wide.where(F.dayofmonth("bar_day") % 5 == 0).withColumns({
        "Close_T3": F.when(F.dayofmonth("bar_day") == 10, F.col("Close_T3") + 1).otherwise(F.col("Close_T3")), "Close_T5": F.when(F.col("Close_T5").isNotNull(), F.lit(float("nan")))})

    def long(df: DataFrame, seq: int) -> DataFrame:
        rows = bars.wide_to_long(df, [*_SYMBOLS, "T77"], time="bar_day").withColumnRenamed("bar_start", "_d")
        return rows.where("close is not null").select("symbol", F.col("_d").alias("bar_start"), "close", F.lit(seq).alias("row_seq"))

    both = long(wide, 0).unionByName(long(again, 1))
    kept, rejected = bars.prepare(both)
    registry = spark.createDataFrame([(s, "SECTOR", "OIL") for s in _SYMBOLS[:8]], "symbol string, scope string, sector string")
    listed, unknown = bars.with_registry(kept, registry)
    absent = bars.missing_symbols(both, spark.createDataFrame([(s,) for s in [*_SYMBOLS, "T77"]], "symbol string"))
    clash = both.groupBy("symbol", "bar_start").agg((F.min("close") < F.max("close")).alias("bad")).where("bad").groupBy("symbol").agg(F.min("bar_start").alias("bar_start"))
    none = F.lit(None).cast("double").alias("close")
    return (listed.select(F.lit("kept").alias("outcome"), "symbol", F.col("bar_start").alias("bar_day"), "close")
            .unionByName(unknown.select(F.lit("unregistered").alias("outcome"), "symbol", F.col("bar_start").alias("bar_day"), "close"))
            .unionByName(rejected.join(clash, "symbol").select(F.lit("rejected").alias("outcome"), "symbol", F.col("bar_start").alias("bar_day"), none))
            .unionByName(absent.select(F.lit("missing").alias("outcome"), "symbol", F.lit(None).cast("date").alias("bar_day"), none)))


_FIELDS = """select doc_id, 'A' || doc_id as classification_attempt_id, 'R' || doc_id as classification_request_id, lpad(cast(doc_id as varchar), 18, '0') as accession_number,
  sha256(text) as document_hash, case when doc_id % 23 = 3 then 'bad' else sha256(source || text) end as full_section_hash, source as ticker,
  case when doc_id % 13 = 5 then 'ABSTAINED' else 'VALID' end as status, doc_id % 29 <> 1 as classification_complete, case when doc_id % 17 = 2 then 'm0' else 'm1' end as model_version from documents"""
_IDENTITY = """sha256('{"accession_number":"' || s.accession_number || '","document_hash":"' || s.document_hash || '","full_section_hash":"' || s.full_section_hash
  || '","item_number":"2.02","official_document_identity":"doc-' || s.doc_id || '","source":"sec_edgar"}')"""


@query("J19 J23 P34 F22", f"""with s as ({_FIELDS}),
r as (select s.*, doc_id % 31 <> 0 as in_ledger, doc_id % 47 <> 0 as in_manifest from s),
b as (select *, case when not in_ledger then 'UNKNOWN_LEDGER_ROW' when not in_manifest then 'UNKNOWN_FILING' when doc_id % 19 = 6 then 'DOCUMENT_HASH' when doc_id % 23 = 3 then 'SECTION_HASH'
  when doc_id % 37 = 4 then 'REQUEST_ID' when doc_id % 53 = 9 then 'TICKER' when doc_id % 59 = 10 then 'FILING_METADATA' when doc_id % 17 = 2 then 'CLASSIFICATION_PROFILE_MISMATCH'
  when doc_id % 29 = 1 then 'NOT_COMPLETE' when doc_id % 13 = 5 or doc_id % 41 = 7 then 'NOT_VALID' when doc_id % 11 = 9 then 'NOT_VALIDATED' when doc_id % 43 = 8 then 'MISSING_AVAILABILITY' end as broken from r)
select classification_attempt_id, coalesce(broken, '') as broken, case when broken in ('CLASSIFICATION_PROFILE_MISMATCH', 'MISSING_AVAILABILITY') then broken
  when broken in ('NOT_COMPLETE', 'NOT_VALID', 'NOT_VALIDATED') then 'POLICY_INELIGIBLE' when broken is not null then 'MALFORMED' else '' end as reason,
  case when broken is null then {_IDENTITY} else '' end as section_identity from b s""")
def classification_lineage(spark, sf):
    """Saved results against ledger row, filing manifest and profile: the first rule that each breaks."""
    d = table(spark, sf, "documents").withColumn("document_hash", F.sha2("text", 256))

    def every(n: int, r: int):
        return F.col("doc_id") % n == r
    key = F.col("doc_id").cast("string")
    saved = d.select(
        "doc_id", F.concat(F.lit("A"), key).alias("classification_attempt_id"), F.concat(F.lit("R"), key).alias("classification_request_id"),
        F.lpad(key, 18, "0").alias("accession_number"), F.lit("2.02").alias("item_number"), "document_hash",
        F.when(every(23, 3), "bad").otherwise(F.sha2(F.concat("source", "text"), 256)).alias("full_section_hash"), F.col("source").alias("ticker"),
        F.when(every(13, 5), "ABSTAINED").otherwise("VALID").alias("status"), (~every(29, 1)).alias("classification_complete"),
        F.when(every(17, 2), "m0").otherwise("m1").alias("model_version"), F.lit("p1").alias("prompt_version"), F.lit("8-K").alias("form_type"))
    rows = d.where(~every(31, 0)).select(
        F.concat(F.lit("A"), key).alias("classification_attempt_id"), F.concat(F.when(every(37, 4), "X").otherwise("R"), key).alias("classification_request_id"),
        F.when(every(19, 6), "other").otherwise(F.col("document_hash")).alias("document_hash"), F.when(every(41, 7), "INVALID").otherwise("VALID").alias("status"),
        (~every(11, 9)).alias("validation_outcome"), F.when(~every(43, 8), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id"))).alias("available_at"))
    manifest = d.where(~every(47, 0)).select(
        F.lpad(key, 18, "0").alias("accession_number"), F.when(every(53, 9), "Q").otherwise(F.col("source")).alias("ticker"), "document_hash",
        F.concat(F.lit("doc-"), key).alias("official_document_identity"), F.when(every(59, 10), "8-K/A").when(~every(7, 0), "8-K").alias("form_type"))
    out = classification.lineage(saved, rows, manifest, {"model_version": "m1", "prompt_version": "p1"}, metadata=["form_type"])
    return out.select("classification_attempt_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("broken", "reason", "section_identity")))


@query("K7 K1", with_views("model_signals") + """ select cast(cast(signal_time as date) as varchar) as day, count(*) as rows, count(distinct signal_id) as ids,
  count(*) filter (where k % 4 = 0) as replayed from model_signals group by 1""")
def ledger_retry(spark, sf):
    """A half-finished write, replayed twice: the ledger ends with every row once."""
    root = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    s = view(spark, sf, "model_signals").withColumn("signal_time", F.col("signal_time").cast("timestamp"))
    rows = ledger.to_rows(s, "model_signals", run_id="r1")
    late = s.where("k % 4 = 0").select("signal_id")
    ledger.append(rows.join(late, "signal_id", "left_anti").select(rows.columns), "model_signals", root)
    # what the collector remembers: a quarter has failed, and of another quarter it does not know that it was written
    known = s.select("signal_id", F.lit(True).alias("classification_complete"), F.when(F.col("k") % 4 < 2, "FAILED").otherwise("WRITTEN").alias("ledger_write_status"))
    results = rows.join(known, "signal_id").select(*rows.columns, "classification_complete", "ledger_write_status")
    first = ledger.replay(results, "model_signals", root, key="signal_id")
    again = ledger.replay(results, "model_signals", root, key="signal_id")
    kept = ledger.read(spark, "model_signals", root)
    done = first.unionByName(again).select("signal_id", F.lit(1).alias("_r"))
    return kept.join(done, "signal_id", "left").groupBy(F.to_date("signal_time").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("signal_id").alias("ids"), F.count("_r").alias("replayed"))


_TYPES = ", ".join(f"'{t}'" for t in calendar.EVENT_TYPES)


@query("P42", f"""with e as (select o_orderkey as id, case when o_orderkey % 13 = 1 then 'EIA_STOCKS' when o_orderkey % 2 = 0 then 'CPI' else 'GDP' end as event_type,
  case when o_orderkey % 17 = 2 then null else 'TIER_' || (o_orderkey % 4) end as tier, case o_orderstatus when 'F' then 'CONFIRMED' when 'O' then 'TENTATIVE' else 'UNKNOWN' end as status,
  case when o_orderkey % 19 = 3 then null else o_orderdate end as scheduled_at, case when o_orderkey % 23 = 4 then o_orderdate + interval 2 day when o_orderkey % 5 = 0 then null else o_orderdate end as published_at,
  o_orderdate + interval 1 day as captured_at, case when o_orderkey % 29 = 5 then ' ' else 'r' || o_orderkey end as revision_id,
  case when o_orderkey % 31 = 6 then null when o_orderkey % 37 = 7 then 'petroleum desk' else 'agency' end as source_reference from orders),
p as (select list_filter([case when not event_type in ({_TYPES}) then 'event_type' end, case when tier is null or tier not in ('TIER_1', 'TIER_2', 'TIER_3') then 'tier' end,
  case when event_type like '%EIA%' or upper(coalesce(source_reference, '')) like '%PETROLEUM%' then 'forbidden_family' end, case when status = 'UNKNOWN' then 'status' end,
  case when published_at > captured_at then 'published_before_captured' end, case when scheduled_at is null then 'scheduled_at' end, case when trim(revision_id) = '' then 'revision_id' end,
  case when source_reference is null then 'source_reference' end], lambda x: x is not null) as broken from e)
select problem, count(*) as rows, cast(sum(n) as bigint) as problems_of_these from (select unnest(broken) as problem, len(broken) as n from p) q group by 1""")
def calendar_event_problems(spark, sf):
    """The constraints of a calendar event over events with planted faults: how often each is broken."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    events = table(spark, sf, "orders").select(
        F.when(key % 13 == 1, "EIA_STOCKS").when(key % 2 == 0, "CPI").otherwise("GDP").alias("event_type"),
        F.when(key % 17 != 2, F.concat(F.lit("TIER_"), (key % 4).cast("string"))).alias("tier"),
        F.when(F.col("o_orderstatus") == "F", "CONFIRMED").when(F.col("o_orderstatus") == "O", "TENTATIVE").otherwise("UNKNOWN").alias("status"),
        F.when(key % 19 != 3, day).alias("scheduled_at"), F.when(key % 23 == 4, day + F.expr("interval 2 days")).when(key % 5 != 0, day).alias("published_at"),
        (day + F.expr("interval 1 day")).alias("captured_at"), F.when(key % 29 == 5, " ").otherwise(F.concat(F.lit("r"), key.cast("string"))).alias("revision_id"),
        F.when(key % 37 == 7, F.when(key % 31 != 6, "petroleum desk")).when(key % 31 != 6, "agency").alias("source_reference"),
        F.concat(F.lit("occ"), key.cast("string")).alias("occurrence_id"))
    broken = quality.check(events, calendar.problems()).select(F.explode("violations").alias("problem"), F.size("violations").alias("n"))
    return broken.groupBy("problem").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("problems_of_these"))


@query("P43 P49 P50", with_views("market_records", "fills", "health_events") + """, b as (
  select 'market_record' as kind, 'price' as rule, 'T' || 0 as x from market_records where price is not null and ingest_seq % 50 = 3
  union all select 'market_record', 'source', '' from market_records where ingest_seq % 41 = 2
  union all select 'fill_event', 'quantity', '' from fills where o1 % 43 = 1 union all select 'fill_event', 'fill_id', '' from fills where o1 % 47 = 2
  union all select 'fill_event', 'side', '' from fills where o1 % 53 = 3
  union all select 'health_event', 'component', '' from health_events where event_id % 40 = 0 union all select 'health_event', 'status', '' from health_events where event_id % 37 = 1
  union all select 'risk_input', 'spread_bps', '' from events where event_id % 31 = 4 union all select 'risk_input', 'daily_loss_dollars', '' from events where event_id % 29 = 5
  union all select 'risk_input', 'open_positions', '' from events where event_id % 23 = 6
  union all select 'latency_metric', 'latency_ms', '' from events where event_id % 19 = 7 union all select 'trade_outcome', 'quantity', '' from events where event_id % 17 = 8)
select kind as source, rule as issue_type, count(*) as rows from b group by 1, 2""")
def record_contracts(spark, sf):
    """Issue rows of six record kinds with planted faults, counted by kind and rule."""
    e = table(spark, sf, "events")
    at, i = F.col("ts").cast("timestamp"), F.col("event_id")
    m, f, h = (view(spark, sf, name) for name in ("market_records", "fills", "health_events"))
    one = F.lit(1.0)
    kinds = {
        "market_record": (m.withColumns({"price": F.when(F.col("ingest_seq") % 50 == 3, F.when(F.col("price").isNotNull(), F.lit(float("nan")))).otherwise(F.col("price")),
                                         "source": F.when(F.col("ingest_seq") % 41 != 2, "desk")}), "ingest_seq"),
        "fill_event": (f.withColumns({"quantity": F.when(F.col("o1") % 43 == 1, -one).otherwise(F.col("quantity")),
                                      "fill_id": F.when(F.col("o1") % 47 == 2, " ").otherwise(F.col("fill_id")), "side": F.when(F.col("o1") % 53 == 3, "HOLD").otherwise(F.col("side"))}), "o1"),
        "health_event": (h.withColumns({"component": F.when(F.col("event_id") % 40 != 0, F.col("component")), "status": F.when(F.col("event_id") % 37 == 1, "").otherwise(F.col("status"))}), "event_id"),
        "risk_input": (e.select("event_id", F.lit(None).cast("double").alias("spread_dollars"), F.when(i % 31 == 4, -one).otherwise(one).alias("spread_bps"),
                                F.lit(None).cast("double").alias("latency_ms"), F.when(i % 29 != 5, one).alias("daily_loss_dollars"), F.lit(0).alias("consecutive_losses"),
                                F.when(i % 23 == 6, -1).otherwise(2).alias("open_positions")), "event_id"),
        "latency_metric": (e.select("event_id", at.alias("measured_time"), F.lit("feed").alias("component"), F.when(i % 19 == 7, F.lit(float("inf"))).otherwise(one).alias("latency_ms")), "event_id"),
        "trade_outcome": (e.select("event_id", at.alias("entry_time"), F.lit("T1").alias("ticker"), F.when(i % 17 == 8, 0 * one).otherwise(one).alias("quantity")), "event_id")}
    out = None
    for kind, (df, key) in kinds.items():
        broken = quality.check(df, quality.contract(kind)).withColumn("rule", F.explode("violations"))
        rows = quality.issues(broken, kind, F.col(key), F.col("rule"), F.concat(F.lit("rule is broken: "), F.col("rule")))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("source", "issue_type").agg(F.count(F.lit(1)).alias("rows"))
