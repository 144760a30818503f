"""Registered queries: state, decision context, evidence, policies, source facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import r6
from tidemark.functions.times import micros
from tidemark.operators import awards, bars, calendar, decision, energy, evidence as ev, rates, state
from tidemark.plans.registry import query
from tidemark.plans.views import table, view, with_views
from tidemark.session import stable

_UPD = with_views("context_updates")
_RANK = "case severity when 'INFO' then 0 when 'LOW' then 1 when 'MEDIUM' then 2 when 'HIGH' then 3 else 4 end"


def updates(spark, sf) -> DataFrame:
    df = view(spark, sf, "context_updates")
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("updated_at", "valid_until")})


# --- state ----------------------------------------------------------------------------------

_STATUS = _UPD.replace("with ", "with recursive ", 1) + """, n as (select *, row_number() over (partition by scope, target, name order by arrival_seq) as rn from context_updates),
s as (select *, 'WRITTEN' as st, updated_at as m, value as v0, severity as s0, source as c0, valid_until as u0 from n where rn = 1
  union all select n.*, case when n.updated_at < s.m then 'IGNORED_STALE' when n.updated_at = s.m and n.value = s.v0 and n.severity = s.s0 and n.source = s.c0 and n.valid_until is not distinct from s.u0 then 'IGNORED_DUPLICATE' else 'REPLACED' end,
    greatest(s.m, n.updated_at), case when n.updated_at < s.m then s.v0 else n.value end, case when n.updated_at < s.m then s.s0 else n.severity end,
    case when n.updated_at < s.m then s.c0 else n.source end, case when n.updated_at < s.m then s.u0 else n.valid_until end
  from s join n on n.scope = s.scope and n.target = s.target and n.name = s.name and n.rn = s.rn + 1)"""


@query("W9 K4", _STATUS + " select arrival_seq, scope, target, name, st as update_status from s")
def state_status(spark, sf):
    return state.update_status(updates(spark, sf)).select("arrival_seq", "scope", "target", "name", "update_status")


_LATEST = _UPD + """, m as (select *, max(updated_at) over (partition by scope, target, name) as mx from context_updates),
w as (select *, lag(struct_pack(a := value, b := severity, c := source, d := valid_until)) over (partition by scope, target, name order by arrival_seq) as prev from m where updated_at = mx),
l as (select * from w where prev is null or prev is distinct from struct_pack(a := value, b := severity, c := source, d := valid_until)
  qualify row_number() over (partition by scope, target, name order by arrival_seq desc) = 1)"""


@query("T8 W9", _LATEST + """ select scope, target, name, value, severity, epoch_us(updated_at) as updated_us, arrival_seq from l
  order by updated_at desc, scope desc, target desc, name desc limit 40""")
def state_latest(spark, sf):
    return state.evict(state.latest(updates(spark, sf)), max_entries=40).select(
        "scope", "target", "name", "value", "severity", micros("updated_at").alias("updated_us"), "arrival_seq")


_NOW = "timestamp '2024-01-30 12:00:00'"


@query("A13 A14", _LATEST + f""", t as (select concat('T', cast(i as string)) as ticker, case when i < 8 then concat('G', cast(i % 4 as string)) end as sector from range(0, 10) r(i)),
j as (select t.ticker, t.sector, l.*, coalesce({_NOW} > valid_until, false) as expired, {_RANK} as rk from t join l on scope = 'GLOBAL' or (scope = 'TICKER' and target = t.ticker) or (scope = 'SECTOR' and target = t.sector)),
a as (select ticker, sector, count(*) filter (where not expired) as fresh, count(*) filter (where expired) as old, max(rk) filter (where not expired) as mx,
  min(valid_until) filter (where not expired) as vu, coalesce(string_agg(distinct 'F' || name, ',' order by 'F' || name) filter (where not expired and value = '1'), '') as ids from j group by 1, 2),
b as (select *, case mx when 0 then 'INFO' when 1 then 'LOW' when 2 then 'MEDIUM' when 3 then 'HIGH' when 4 then 'CRITICAL' end as sev,
  case mx when 1 then 'LOW' when 2 then 'ELEVATED' when 3 then 'HIGH' when 4 then 'HIGH' end as lvl from a)
select ticker, sector, fresh as fresh_entry_count, old as expired_entry_count, case when old > 0 and (lvl is null or lvl = 'LOW') then 'EXPIRED' else sev end as highest_severity,
  case when old > 0 and (lvl is null or lvl = 'LOW') then 'ELEVATED' else lvl end as risk_level, coalesce(epoch_us(vu), -1) as valid_until_us, ids as flag_ids from b""")
def context_snapshot(spark, sf):
    now = F.expr(_NOW.replace("timestamp ", "timestamp_ltz "))
    latest = state.latest(updates(spark, sf)).withColumns({
        "flag_id": F.concat(F.lit("F"), "name"), "value": F.when(F.col("value") == "1", "true").otherwise(F.col("value"))})
    tickers = view(spark, sf, "market_records").select("ticker").distinct()
    n = F.substring("ticker", 2, 9).cast("int")
    subjects = tickers.select("ticker", F.when(n < 8, F.concat(F.lit("G"), (n % 4).cast("string"))).alias("sector"), now.alias("now"))
    out = state.snapshots(subjects, latest)
    return out.select("ticker", "sector", "fresh_entry_count", "expired_entry_count", "highest_severity", "risk_level",
                      micros("valid_until").alias("valid_until_us"), F.array_join("active_context_flag_ids", ",").alias("flag_ids")).na.fill(-1, ["valid_until_us"])


@query("A14", _LATEST + """ select scope, target, count(*) as entry_count, string_agg(name || '=' || value || '/' || severity, ',' order by name) as entries from l group by 1, 2""")
def state_documents(spark, sf):
    docs = state.documents(state.latest(updates(spark, sf)), ["value", "severity"])
    text = F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"], F.lit("/"), e["value"]["severity"]))
    return docs.select("scope", "target", "entry_count", F.array_join(F.array_sort(text), ",").alias("entries"))


@query("W16", _UPD + """, p as (select *, lag(value || severity) over w as pv from context_updates window w as (partition by scope, target, name order by arrival_seq)),
g as (select *, sum(case when pv is null or pv <> value || severity then 1 else 0 end) over (partition by scope, target, name order by arrival_seq) as isl from p)
select arrival_seq, epoch_us(first_value(updated_at) over (partition by scope, target, name, isl order by arrival_seq)) as first_us from g""")
def first_seen(spark, sf):
    out = state.first_seen(updates(spark, sf), key=list(state.KEY), order=["arrival_seq"], collected="updated_at", content=["value", "severity"])
    return out.select("arrival_seq", micros("first_collected_at").alias("first_us"))


_REFRESH = """r as (select event_id, ts as observed_at, case user_id % 5 when 0 then 'macro_calendar' when 1 then 'eia_wpsr' when 2 then 'fred' when 3 then 'usaspending' else 'yfinance_dev_only' end as source_id,
  case event_type when 'error' then 'FAILED' when 'purchase' then 'SUCCESS' when 'click' then 'PARTIAL' when 'view' then 'STALE' else 'NO_FRESH_DATA' end as status,
  event_type = 'error' as failed, event_type not in ('error', 'signup') as usable, event_type = 'purchase' as full_success, ts + (event_id % 3 - 1) * interval '1' minute as completed_at from events)"""


def refresh_log(spark, sf) -> DataFrame:
    df = spark.sql("select * from (with " + _REFRESH.replace("from events", "from {e}") + " select * from r)", e=table(spark, sf, "events"))
    ts = {c: F.col(c).cast("timestamp") for c in ("observed_at", "completed_at")}
    return df.withColumns(ts).withColumn("attempted_at", F.col("observed_at"))


@query("W13", "with " + _REFRESH + """, a as (select *, sum(case when not failed then 1 else 0 end) over w as i1, sum(case when usable then 1 else 0 end) over w as i2,
  last_value(case when not failed then completed_at end ignore nulls) over w as lc, last_value(case when usable then completed_at end ignore nulls) over w as lu,
  last_value(case when full_success then completed_at end ignore nulls) over w as lf from r window w as (partition by source_id order by observed_at, event_id rows unbounded preceding))
select event_id, source_id, sum(case when failed then 1 else 0 end) over (partition by source_id, i1 order by observed_at, event_id rows unbounded preceding)::bigint as failures,
  sum(case when not usable then 1 else 0 end) over (partition by source_id, i2 order by observed_at, event_id rows unbounded preceding)::bigint as non_usable,
  coalesce(epoch_us(lc), -1) as completed_us, coalesce(epoch_us(lu), -1) as usable_us, coalesce(epoch_us(lf), -1) as success_us from a""")
def refresh_fold(spark, sf):
    out = state.refresh_state(refresh_log(spark, sf), order=["observed_at", "event_id"])
    return out.select("event_id", "source_id", F.col("consecutive_failure_count").alias("failures"),
                      F.col("consecutive_non_usable_count").alias("non_usable"), micros("last_completed_at").alias("completed_us"),
                      micros("last_usable_at").alias("usable_us"), micros("last_full_success_at").alias("success_us")).na.fill(
        -1, ["completed_us", "usable_us", "success_us"])


@query("J21", "with " + _REFRESH + """, a as (select *, last_value(case when not failed then completed_at end ignore nulls) over w as lc, last_value(case when usable then completed_at end ignore nulls) over w as lu, last_value(case when full_success then completed_at end ignore nulls) over w as lf
  from r window w as (partition by source_id order by observed_at, event_id rows unbounded preceding)),
p as (select o_orderkey, o_orderdate, timestamp '2024-01-01' + (o_orderkey % 40000) * interval '1' minute as t, 'fred' as source_id from orders),
j as (select p.o_orderkey, p.o_orderdate, p.t, a.status, a.lc as completed_at, greatest(a.observed_at, a.lc, a.lu, a.lf) as newest from p asof left join a on p.source_id = a.source_id and p.t >= a.observed_at)
select o_orderkey, epoch_us(t) as t_us, case when status is not null and newest <= t then status else 'UNKNOWN_NOT_REFRESHED' end as refresh_status,
  round(case when status is not null and newest <= t then (epoch_us(t) - epoch_us(completed_at)) / 1e6 end, 6) as age from j""")
def source_readiness(spark, sf):
    log = state.refresh_state(refresh_log(spark, sf), order=["observed_at", "event_id"])
    p = table(spark, sf, "orders").select("o_orderkey", F.expr("timestamp_micros(1704067200000000L + (o_orderkey % 40000) * 60000000L)").alias("t"), F.lit("fred").alias("source_id"))
    out = state.readiness(p, log, at="t")
    return out.select("o_orderkey", micros("t").alias("t_us"), "refresh_status", r6(F.col("readiness_age_seconds")).alias("age"))


# --- decision context ------------------------------------------------------------------------

_DEC = """d as (select seq as decision_id, ticker, signal_time as t, case when k % 9 = 0 then 'G0' when cast(substring(ticker, 2) as int) < 8 then concat('G', cast(cast(substring(ticker, 2) as int) % 4 as string)) end as sector,
  case when k % 9 = 0 then 'EXPLICIT' when cast(substring(ticker, 2) as int) < 8 then 'INJECTED_MAPPING' else 'UNRESOLVED' end as sector_status from model_signals)"""


def decisions(spark, sf) -> DataFrame:
    s = view(spark, sf, "model_signals").select(F.col("seq").alias("decision_id"), "ticker", F.col("signal_time").cast("timestamp").alias("evaluation_time"),
                                                F.when(F.col("k") % 9 == 0, " g0 ").alias("given"))
    n = F.substring("ticker", 2, 9).cast("int")
    mapping = s.select("ticker").distinct().filter(n < 8).select("ticker", F.concat(F.lit("G"), (n % 4).cast("string")).alias("sector"))
    return decision.resolve_sector(s, mapping, explicit="given").drop("given")


@query("J10 J20 P30 T3 E4 F20 J21", with_views("model_signals", "context_updates") + f""", {_DEC},
u as (select *, lead(updated_at) over (partition by scope, target, name order by updated_at) as nxt from
  (select * from context_updates qualify row_number() over (partition by scope, target, name, updated_at order by arrival_seq desc) = 1) x),
v as (select *, least(coalesce(nxt - interval '1' microsecond, timestamp '2099-01-01'), coalesce(valid_until, timestamp '2099-01-01')) as upto,
  source || '|' || scope || '|' || case scope when 'GLOBAL' then '' else target end || '|' || name as ident from u),
k as (select decision_id, t, 'GLOBAL' as scope, '*' as target from d union all select decision_id, t, 'TICKER', ticker from d union all select decision_id, t, 'SECTOR', sector from d where sector is not null),
j as (select k.decision_id, v.* from k join v on k.scope = v.scope and k.target = v.target and k.t >= v.updated_at and k.t <= v.upto),
a as (select decision_id, count(*) as n, string_agg(ident, ',' order by case scope when 'GLOBAL' then 0 when 'SECTOR' then 1 else 2 end, target, name) as entries,
  count(*) filter (where source = 'fred_rates_v1' and scope = 'GLOBAL' and name = 'n2') as ok, count(*) filter (where source = 'yfinance_dev_raw_v1') as dev from j group by 1)
select d.decision_id, d.sector, d.sector_status, coalesce(n, 0) as n_entries, coalesce(entries, '') as entries, coalesce(ok, 0) as n_approved, coalesce(dev, 0) as n_development from d left join a using (decision_id)""")
def decision_context(spark, sf):
    d = decisions(spark, sf)
    policy = decision.approvals([("fred_rates_v1", "GLOBAL", "n2"), ("yfinance_dev_raw_v1", "GLOBAL", "n0")])
    entries = decision.visible_entries(d, updates(spark, sf), policy=policy)
    ctx = decision.assemble(d, entries)
    names = F.transform("structured_context", lambda e: e["entry_identity"])
    dev = F.filter("structured_context", lambda e: e["authority_class"] == "DEVELOPMENT_ONLY")
    return ctx.select("decision_id", "sector", "sector_status", F.size("structured_context").cast("long").alias("n_entries"),
                      F.array_join(names, ",").alias("entries"), F.size("approved_risk_context").cast("long").alias("n_approved"),
                      F.size(dev).cast("long").alias("n_development"))


@query("P27 P28 P29", with_views("evidence") + """, e as (select *, timestamp '2024-01-15' as t from evidence)
select evidence_id, case when k % 17 = 0 then 'MISSING_OR_MALFORMED' when policy_eligible and available_at is not null and available_at <= t then 'ASOF_ELIGIBLE' else 'ASOF_INELIGIBLE' end as provenance_state,
  coalesce(t >= available_at and t <= valid_until, false) as active, case when k % 10 = 0 then 'available_at' end as misaligned from e""")
def provenance_states(spark, sf):
    e = view(spark, sf, "evidence").withColumns({c: F.col(c).cast("timestamp") for c in ("available_at", "valid_until")})
    p = decision.provenance(available_at=F.col("available_at"), valid_until=F.col("valid_until"), effective_from=F.col("available_at"),
                            collected_at=F.when(F.col("k") % 17 != 0, F.lit("2024-02-01").cast("timestamp")), availability_basis=F.lit("feed"),
                            research_asof_eligible=F.col("policy_eligible"))
    t = F.lit("2024-01-15").cast("timestamp")
    claimed = F.when(F.col("k") % 10 == 0, t).otherwise(F.col("available_at"))
    df = e.withColumn("p", p)
    return df.select("evidence_id", decision.provenance_state(F.col("p"), t).alias("provenance_state"), decision.active_window(F.col("p"), t).alias("active"),
                     decision.provenance_misaligned(F.col("p"), F.lit(None).cast("timestamp"), F.col("valid_until"), claimed).alias("misaligned"))


# --- evidence -------------------------------------------------------------------------------

def evidence_rows(spark, sf) -> DataFrame:
    e = view(spark, sf, "evidence")
    return e.select("evidence_id", F.lit("FLAG").alias("category"), F.lit("desk_flags").alias("source"), F.col("evidence_id").alias("source_record_id"),
                    "policy_match_key", F.when(F.col("scope") == "TICKER", F.array("scope_target")).otherwise(F.array().cast("array<string>")).alias("tickers"),
                    F.when((F.col("scope") == "TICKER") & (F.col("k") % 3 == 1), "G1").alias("sector"), (F.col("scope") == "GLOBAL").alias("is_global"),
                    F.col("available_at").cast("timestamp").alias("available_at"), F.lit(None).cast("timestamp").alias("valid_from"),
                    F.col("valid_until").cast("timestamp").alias("valid_until"), "policy_eligible", F.lit(None).cast("string").alias("payload"))


_AGE = 3 * 86_400_000_000
_NUMBER = "cast(substring(evidence_id, 2) as bigint)"
_EV = with_views("model_signals", "evidence") + f""", {_DEC},
e as (select *, case when scope = 'TICKER' and k % 3 = 1 then 'G1' end as sec from evidence)"""
_REASON = f"""case when not e.policy_eligible then 'ineligible' when e.available_at is null then 'missing'
  when not (e.scope = 'GLOBAL' or e.scope_target = d.ticker or coalesce(e.sec = d.sector, false)) then 'scope' when e.available_at > d.t then 'future'
  when e.valid_until is not null and d.t > e.valid_until then 'expired' when e.valid_until is null and d.t - e.available_at > interval '3' day then 'outside' end"""


@query("J9 P31", _EV + f""", r as (select d.decision_id, {_REASON} as reason from d cross join e)
select decision_id, count(*) filter (where reason is null) as n_selected, count(*) filter (where reason = 'ineligible') as n_policy_ineligible, count(*) filter (where reason = 'missing') as n_missing_availability,
  count(*) filter (where reason = 'scope') as n_scope_mismatch, count(*) filter (where reason = 'future') as n_future, count(*) filter (where reason = 'expired') as n_expired,
  count(*) filter (where reason = 'outside') as n_outside_lookback from r group by 1""")
def evidence_select(spark, sf):
    return ev.exclusion_counts(decisions(spark, sf), evidence_rows(spark, sf), max_age_us=_AGE)


@query("J9 P31", _EV + f""" select d.decision_id, count(*) as n_selected, cast(sum(cast(substr(e.evidence_id, 2) as bigint)) as bigint) as id_sum from d join e on {_REASON} is null group by 1""")
def evidence_pairs(spark, sf):
    """The selection as a count and a sum of ids per decision: the pairs themselves grow with the square of the tables."""
    sums = ev.live_sums(decisions(spark, sf), evidence_rows(spark, sf), id="decision_id", at="evaluation_time", max_age_us=_AGE, value=F.expr(_NUMBER))
    return sums.select("decision_id", F.col("n").alias("n_selected"), F.col("total").alias("id_sum"))


_POLICY = ev.Policy((ev.Rule("halt", ("FLAG_TYPE:K3",), "BLOCK", "k3_seen"), ev.Rule("trim", ("FLAG_TYPE:K1", "FLAG_TYPE:K4"), "REDUCE_SIZE", "k1_k4", 0.25),
                     ev.Rule("note", ("FLAG_TYPE:K2",), "WARN_ONLY", "k2_seen")), "desk_v1")


@query("J22 E2", _EV + f""", s as (select d.decision_id, e.evidence_id, e.available_at, case e.policy_match_key when 'FLAG_TYPE:K3' then 0 when 'FLAG_TYPE:K1' then 1 when 'FLAG_TYPE:K4' then 1 when 'FLAG_TYPE:K2' then 2 end as o
  from d join e on {_REASON} is null and e.policy_match_key in ('FLAG_TYPE:K1', 'FLAG_TYPE:K2', 'FLAG_TYPE:K3', 'FLAG_TYPE:K4')),
w as (select decision_id, min(o) as o from s group by 1),
i as (select s.decision_id, s.o, count(*) as n, cast(sum(cast(substr(evidence_id, 2) as bigint)) as bigint) as total from s join w using (decision_id, o) group by 1, 2)
select d.decision_id, case o when 0 then 'BLOCK' when 1 then 'REDUCE_SIZE' when 2 then 'WARN_ONLY' else 'NO_CHANGE' end as hypothetical_action, case o when 1 then 0.25e0 end as proposed_size_factor,
  coalesce(case o when 0 then 'k3_seen' when 1 then 'k1_k4' when 2 then 'k2_seen' end, '') as reason_codes, coalesce(n, 0) as matched_rows, coalesce(total, 0) as matched_ids from d left join i using (decision_id)""")
def shadow_policy(spark, sf):
    out = ev.summarize(decisions(spark, sf), evidence_rows(spark, sf), _POLICY, max_age_us=_AGE, value=F.expr(_NUMBER))
    return out.select("decision_id", "hypothetical_action", "proposed_size_factor", F.array_join("reason_codes", ",").alias("reason_codes"),
                      "matched_rows", F.col("matched_total").alias("matched_ids"))


@query("A16 J18 U4", with_views("evidence") + """, e as (select *, 'R' || cast(k as string) as rec, case when k % 11 = 0 then 'eia_wpsr_v1' else 'desk_flags' end as src from evidence)
select 'duplicate_source_record' as problem, src || '|' || rec as key, count(*) as rows from e group by src, rec having count(*) > 1
union all select 'structured_source', src, count(*) from e where src = 'eia_wpsr_v1' group by 2
union all select 'source_not_admitted', src, count(*) from e where src <> 'desk_flags' group by 2
union all select 'outside_universe', scope_target, count(*) from e where scope = 'TICKER' and scope_target not in ('T0', 'T1', 'T2') group by 2""")
def evidence_checks(spark, sf):
    k = F.regexp_extract("evidence_id", r"(\d+)", 1)
    raw = view(spark, sf, "evidence").select("evidence_id", "k")
    e = evidence_rows(spark, sf).drop("source", "source_record_id").join(raw, "evidence_id").withColumns({
        "source": F.when(F.col("k") % 11 == 0, "eia_wpsr_v1").otherwise("desk_flags"), "source_record_id": F.concat(F.lit("R"), F.col("k").cast("string"))}).drop("k")
    run = ev.RunDefinition(("T0", "T1", "T2"), ("desk_flags",), 0, 1)
    structured = updates(spark, sf).select("source")
    return ev.conflicts(e, run, structured)


# --- source facts ---------------------------------------------------------------------------

def calendar_events(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("occ"), F.floor(F.col("o_custkey") / 2).cast("string")).alias("occurrence_id"), F.concat(F.lit("rev"), key.cast("string")).alias("revision_id"),
        F.lit("CPI").alias("event_type"), F.lit("desk").alias("provider"), F.col("o_orderdate").cast("timestamp").alias("scheduled_at"),
        F.timestamp_micros(micros("o_orderdate") - (key % 500) * 60_000_000).alias("captured_at"),
        F.expr("case o_orderkey % 4 when 0 then 'CANCELLED' when 1 then 'TENTATIVE' else 'CONFIRMED' end").alias("status"),
        F.when(key % 2 == 0, "short").otherwise("long").alias("profile_id"))


_CAL = """c as (select concat('occ', cast(cast(floor(o_custkey / 2.0) as bigint) as string)) as occ, concat('rev', cast(o_orderkey as string)) as rev, o_orderdate as sched, o_orderdate - (o_orderkey % 500) * interval '1' minute as cap,
  case o_orderkey % 4 when 0 then 'CANCELLED' when 1 then 'TENTATIVE' else 'CONFIRMED' end as status, case when o_orderkey % 2 = 0 then 30 else 2880 end as mins from orders),
l as (select * from c qualify row_number() over (partition by occ order by cap desc, rev desc) = 1)"""


@query("W4 T5 T4 J5", "with " + _CAL + """, p as (select event_id, timestamp '1994-01-01' + event_id * interval '1' hour as t from events)
select 'latest' as kind, occ as occurrence_id, rev as revision_id, cast(-1 as bigint) as probe from l
union all select 'between', occ, rev, -1 from l where sched >= timestamp '1995-03-01' and sched < timestamp '1995-04-01'
union all (select 'upcoming', occ, rev, -1 from l where status <> 'CANCELLED' and sched > timestamp '1996-01-01' order by sched, occ limit 7)
union all select 'active', occ, null, event_id from l join p on status <> 'CANCELLED' and t >= sched - mins * interval '1' minute and t <= sched + mins * interval '1' minute""")
def calendar_revisions(spark, sf):
    profiles = spark.createDataFrame([("short", 30, 30), ("long", 2880, 2880)], "profile_id string, pre_minutes int, post_minutes int")
    rev = stable(calendar.with_windows(calendar.latest_revisions(calendar_events(spark, sf)), profiles), "revisions")
    ts = lambda s: F.lit(s).cast("timestamp")
    none = F.lit(-1).cast("long").alias("probe")

    def kind(name, df):
        return df.select(F.lit(name).alias("kind"), "occurrence_id", "revision_id", none)

    probes = table(spark, sf, "events").select(F.col("event_id").alias("probe"), F.expr("timestamp_micros(757382400000000L + event_id * 3600000000L)").alias("evaluation_time"))
    active = calendar.active_at(probes, rev).select(F.lit("active").alias("kind"), "occurrence_id", F.lit(None).cast("string").alias("revision_id"), "probe")
    return (kind("latest", rev).unionByName(kind("between", calendar.between(rev, ts("1995-03-01"), ts("1995-04-01"))))
            .unionByName(kind("upcoming", calendar.upcoming(rev, ts("1996-01-01"), limit=7))).unionByName(active))


@query("W4", """with c as (select concat('occ', cast(cast(floor(o_custkey / 2.0) as bigint) as string)) as occ, o_orderkey, date_trunc('month', o_orderdate) as cap from orders)
select occ as occurrence_id, 'duplicate_captured_at' as problem from c group by 1 having count(distinct cap) < count(*)
union all select occ, 'duplicate_revision_id' from c group by 1 having count(distinct o_orderkey) < count(*)""")
def calendar_problems(spark, sf):
    monthly = calendar_events(spark, sf).withColumn("captured_at", F.date_trunc("month", "scheduled_at"))
    return calendar.revision_problems(monthly)


@query("P46", "with " + _CAL + """, n as (select timestamp '1995-06-15 12:00:00' as now), w as (select *, status <> 'CANCELLED' and now between sched - mins * interval '1' minute and sched + mins * interval '1' minute as act, 'macro_calendar:active:' || occ as name from l, n)
select name, 'true' as value, epoch_us(cap) as updated_us, epoch_us(sched + mins * interval '1' minute) as until_us, rev as revision_id from w where act
union all select name, 'false', epoch_us(cap), epoch_us(cap), rev from w where not act and cast(substring(occ, 4) as bigint) % 3 = 0""")
def calendar_state(spark, sf):
    profiles = spark.createDataFrame([("short", 30, 30), ("long", 2880, 2880)], "profile_id string, pre_minutes int, post_minutes int")
    rev = calendar.with_windows(calendar.latest_revisions(calendar_events(spark, sf)), profiles)
    held = rev.filter(F.substring("occurrence_id", 4, 20).cast("long") % 3 == 0).select(
        F.concat(F.lit("macro_calendar:active:"), "occurrence_id").alias("name"), F.lit("true").alias("value"), F.lit("rev0").alias("revision_id"))
    out = calendar.state_rows(rev, F.lit("1995-06-15 12:00:00").cast("timestamp"), held)
    return out.select("name", "value", micros("updated_at").alias("updated_us"), micros("valid_until").alias("until_us"), "revision_id")


@query("J4 W15", """with r as (select distinct date_trunc('week', o_orderdate) as release_at from orders), w as (select *, 'r' || cast(epoch_us(release_at) as varchar) as release_id,
  release_at - interval '90' minute as ws, release_at + interval '240' minute as we from r), t as (select distinct 'T' || cast(user_id % 10 as varchar) as ticker from events),
p as (select event_id, timestamp '1995-02-01' + event_id * interval '37' minute as t from events)
select p.event_id, w.release_id, t.ticker from p join w on p.t between w.ws and w.we cross join t""")
def release_windows(spark, sf):
    rel = table(spark, sf, "orders").select(F.date_trunc("week", F.col("o_orderdate").cast("timestamp")).alias("release_at")).distinct()
    rel = energy.windows(rel.withColumn("release_id", F.concat(F.lit("r"), micros("release_at").cast("string"))), pre_minutes=90, post_minutes=240)
    e = table(spark, sf, "events")
    p = e.select("event_id", F.expr("timestamp_micros(791596800000000L + event_id * 2220000000L)").alias("evaluation_time"))
    tickers = e.select(F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string")).alias("ticker")).distinct()
    return energy.release_flags(p, rel, tickers).select("event_id", "release_id", "ticker")


@query("W15", """with w as (select distinct date_trunc('week', o_orderdate) - interval '90' minute as ws, 'r' || cast(epoch_us(date_trunc('week', o_orderdate)) as varchar) as rid from orders),
p as (select event_id, timestamp '1990-01-01' + event_id * interval '7' hour as t from events)
select event_id, coalesce(rid, (select arg_min(rid, ws) from w)) as release_id from p asof left join w on p.t >= w.ws""")
def release_lookup(spark, sf):
    rel = table(spark, sf, "orders").select(F.date_trunc("week", F.col("o_orderdate").cast("timestamp")).alias("release_at")).distinct()
    rel = energy.windows(rel.withColumn("release_id", F.concat(F.lit("r"), micros("release_at").cast("string"))), pre_minutes=90, post_minutes=240)
    p = table(spark, sf, "events").select("event_id", F.expr("timestamp_micros(631152000000000L + event_id * 25200000000L)").alias("evaluation_time"))
    return energy.target_release(p, rel).select("event_id", "release_id")


@query("J6 A17", with_views("observations") + """, w as (select series, period, count(distinct v) > 1 as amb, min(v) as v from
  (select series, cast(date_trunc('week', observation_date) as date) as period, max(value) as v from observations group by 1, 2, series = 'MID' and extract('isodow' from observation_date) > 3) x group by 1, 2),
g as (select * from w where not amb), f as (select g.series, g.period, g.v, p.v as pv from g left join g p on p.series = g.series and p.period = g.period - 7)
select series, cast(period as varchar) as period, 'level' as kind, v as value from f union all select series, cast(period as varchar), 'change_wow', v - pv from f where pv is not null
union all select series, cast(period as varchar), 'EXPECTED_PRIOR_PERIOD_MISSING', null from f where pv is null union all select series, cast(period as varchar), 'CURRENT_PERIOD_INVALID', null from w where amb""")
def weekly_change(spark, sf):
    o = view(spark, sf, "observations")
    # one value a week, and two that may differ for one series
    second = (F.col("series") == "MID") & (F.weekday("observation_date") >= 3)
    weeks = o.groupBy("series", F.date_trunc("week", "observation_date").alias("week"), second.alias("second")).agg(F.max("value").alias("value"))
    rows = weeks.select(
        "series", F.date_format("week", "yyyy-MM-dd").alias("period"), F.col("value").cast("string").alias("value"),
        F.lit("MBBL").alias("units"), F.lit("MBBL").alias("expected_units"))
    facts, issues = energy.weekly_facts(energy.select_periods(rows))
    day = F.col("period").cast("string").alias("period")
    return facts.select("series", day, "kind", "value").unionByName(
        issues.select("series", day, F.col("issue_type").alias("kind"), F.lit(None).cast("double").alias("value")))


@query("W5 P44 P45 J7 U1 F13 F23", with_views("observations") + """, o as (select series, observation_date as d, value as v from observations where observation_date <= date '1997-05-20'),
r as (select *, row_number() over (partition by series order by d desc) as rn from o), x as (select a.series, a.d, a.v, b.v as pv from r a left join r b on a.series = b.series and b.rn = 2 where a.rn = 1),
c as (select * from x where date '1997-05-20' between d and d + 10),
m as (select max(case series when 'SHORT' then v end) as s, max(case series when 'MID' then v end) as m, max(case series when 'LONG' then v end) as l, min(d) as lo, max(d) as hi, count(*) as n from c)
select series as indicator, 'yield_level' as value_kind, cast(d as varchar) as observation_date, round(v, 6) as value, cast(null as varchar) as label from c
union all select series || '_change', 'yield_change', cast(d as varchar), round(v - pv, 6), null from c where pv is not null
union all select 'mid_minus_short', 'yield_spread', cast(lo as varchar), round(m - s, 6), null from m where n = 3 and lo = hi union all select 'long_minus_mid', 'yield_spread', cast(lo as varchar), round(l - m, 6), null from m where n = 3 and lo = hi
union all select 'rate_curve_regime_v1', 'categorical_regime', cast(lo as varchar), null, case when m - s < 0 then 'FRONT_INVERTED' else 'FRONT_POSITIVE' end || '__' || case when l - m < 0 then 'LONG_INVERTED' else 'LONG_POSITIVE' end from m where n = 3 and lo = hi""")
def rate_facts(spark, sf):
    raw = view(spark, sf, "observations").select("series", F.date_format("observation_date", "yyyy-MM-dd").alias("date"),
                                                 F.col("value").cast("string").alias("value"), F.lit(1).alias("row_seq"))
    day = F.lit("1997-05-20").cast("date")
    pairs = rates.latest_two(rates.valid_observations(raw, evaluation_date=day))
    facts, _ = rates.facts(pairs, evaluation_date=day, max_age_days=10, spreads={"mid_minus_short": ("MID", "SHORT"), "long_minus_mid": ("LONG", "MID")},
                           regime=("SHORT", "MID", "LONG"))
    return facts.select("indicator", "value_kind", F.col("observation_date").cast("string").alias("observation_date"), r6(F.col("value")).alias("value"), "label")


@query("W7 W8 J8 P47", with_views("bars") + """, b as (select symbol, bar_day, close + 1 as close from bars),
l as (select symbol, max(bar_day) as d from b where bar_day <= date '2024-01-28' group by 1 having max(bar_day) >= date '2024-01-27'), c as (select l.symbol, l.d, b.close from l join b on b.symbol = l.symbol and b.bar_day = l.d)
select symbol, 'latest_close' as indicator, round(close, 6) as value from c
union all select c.symbol, 'return_' || cast(n as varchar) || 'm', round(c.close / b.close - 1, 6) from c cross join (values (1440), (4320), (14400)) k(n) join b on b.symbol = c.symbol and b.bar_day = c.d - cast(n / 1440 as int)""")
def bar_indicators(spark, sf):
    b = view(spark, sf, "bars").select(
        "symbol", F.col("bar_day").cast("timestamp").alias("bar_start"), (F.col("close") + 1).alias("close"), F.lit(1).alias("row_seq"))
    good, _ = bars.prepare(b)
    rows, _ = bars.indicators(good, F.lit("2024-01-29 12:00:00").cast("timestamp"), bar_seconds=86_400, max_staleness_seconds=200_000,
                              lookbacks=(1440, 4320, 14400))
    return rows.select("symbol", "indicator", r6(F.col("value")).alias("value"))


# --- awards ---------------------------------------------------------------------------------

def search_rows(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.lpad((F.col("o_custkey") % 200).cast("string"), 12, "0").alias("uei"), F.concat(F.lit("L"), F.col("o_orderkey").cast("string")).alias("lookup_id"),
                    F.when(F.col("o_orderkey") % 6 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("last_modified_date"),
                    F.lit(None).cast("string").alias("base_obligation_date"), F.col("o_orderkey").cast("string").alias("award_id"), "o_orderkey", "o_totalprice", "o_orderdate")


def recipients(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 200).alias("n")).distinct().filter("n % 3 = 0")
    return c.select(F.lpad(F.col("n").cast("string"), 12, "0").alias("uei"), F.concat(F.lit("T"), (F.col("n") % 10).cast("string")).alias("ticker"), F.lit("v1").alias("mapping_version"))


_AW = """s as (select lpad(cast(o_custkey % 200 as varchar), 12, '0') as uei, 'L' || cast(o_orderkey as varchar) as lookup_id, case when o_orderkey % 6 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as lm, cast(o_orderkey as varchar) as award_id, o_orderkey, o_totalprice, o_orderdate from orders),
m as (select distinct lpad(cast(c_custkey % 200 as varchar), 12, '0') as uei, 'T' || cast(c_custkey % 200 % 10 as varchar) as ticker from customer where c_custkey % 200 % 3 = 0)"""


@query("T6 J15 J16", "with " + _AW + """, r as (select s.*, m.ticker, row_number() over (partition by s.uei order by coalesce(lm, '') desc, lookup_id desc) as rk from s join m using (uei)),
k as (select *, case when o_orderkey % 7 = 0 then 'DETAIL_MISSING' when o_orderkey % 11 = 0 then 'RECIPIENT_MISMATCH' when o_orderkey % 5 = 0 then 'FUNDING_MISSING' end as issue from r where rk <= 9)
select lookup_id, uei, coalesce(issue, 'COMPLETE') as outcome from k
union all select cast(count(*) as varchar), uei, 'CANDIDATE_CAP_REACHED' from r group by uei having count(*) > 9""")
def award_topk(spark, sf):
    s = search_rows(spark, sf)
    cands, _ = awards.candidates(s, recipients(spark, sf))
    top, over = awards.top_candidates(cands, 9)
    key = F.col("o_orderkey")
    details = s.filter(key % 7 != 0).select("lookup_id", F.when(key % 11 == 0, "X").otherwise(F.col("uei")).alias("uei"))
    funding = s.filter(key % 5 != 0).select("lookup_id", F.lit(1).alias("pages"))
    done, issues = awards.enrich(top, details, funding)
    return (done.select("lookup_id", "uei", F.lit("COMPLETE").alias("outcome")).unionByName(issues.select("lookup_id", "uei", F.col("issue_type").alias("outcome")))
            .unionByName(over.select(F.col("candidates").cast("string").alias("lookup_id"), "uei", F.col("issue_type").alias("outcome"))))


@query("P40 P41 J17 X9 F21", "with " + _AW + """, a as (select s.*, case o_orderkey % 6 when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'D' when 4 then 'IDV' else 'A' end as kind, case when o_orderkey % 4 = 0 then null else 'contract' end as cat,
  case when o_orderkey % 9 = 0 then null else cast(o_orderdate as date) end as bd, case when o_orderkey % 10 = 0 then 'NEW_AWARD_DISCOVERED' end as stored from s),
e as (select *, coalesce(stored, case when bd is not null and date '1998-07-01' - bd <= 900 then 'NEW_AWARD_DISCOVERED' else 'LATE_OR_BACKFILL_DISCOVERY' end) as cls from a where kind in ('A', 'B', 'C', 'D'))
select lookup_id, cls as classification, case when o_orderkey % 10 <> 0 then 'DISCOVERY' when o_orderkey % 20 = 0 then 'REVISION' else 'SEEN' end as event_kind, case when o_orderkey % 3 = 0 then 'TOUCHED' else 'INSERTED' end as merge_action from e
union all select lookup_id, null, null, 'UNCHANGED' from a where kind = 'IDV' and o_orderkey % 3 = 0""")
def award_classify(spark, sf):
    s, key = search_rows(spark, sf), F.col("o_orderkey")
    at = F.lit("1998-07-01 16:00:00").cast("timestamp")
    a = s.withColumns({"kind": F.expr("case o_orderkey % 6 when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'D' when 4 then 'IDV' else 'A' end"),
                       "category": F.when(key % 4 != 0, "contract"), "business_date": F.when(key % 9 != 0, F.to_date("o_orderdate"))})
    contracts = a.filter(awards.is_contract(F.col("category"), F.col("kind")))
    fp = contracts.withColumn("fingerprint", awards.identity(["uei", "award_id", "kind", "business_date"]))
    registry = contracts.filter(key % 10 == 0).select("award_id", F.when(key % 20 == 0, "old").otherwise(
        awards.identity(["uei", "award_id", "kind", "business_date"])).alias("fingerprint"), F.lit("NEW_AWARD_DISCOVERED").alias("classification"))
    known = awards.revisions(fp, registry)
    out = known.withColumn("classification", awards.classify(F.col("stored_classification"), F.col("business_date"), at, 900))
    seen = s.filter(key % 3 == 0).select(F.col("lookup_id").alias("fingerprint"), at.alias("first_observed"), at.alias("last_observed"))
    merged = awards.merge_seen(seen, out.select(F.col("lookup_id").alias("fingerprint"), at.alias("first_observed"), at.alias("last_observed")))
    return merged.select(F.col("fingerprint").alias("lookup_id"), "merge_action").join(
        out.select("lookup_id", "classification", "event_kind"), "lookup_id", "left").join(
        a.filter("kind = 'IDV'").select("lookup_id", F.lit(True).alias("idv")), "lookup_id", "left").drop("idv")


@query("K8 T7", """with g as (select o_orderkey, case when o_orderkey % 13 = 0 then null else o_orderdate end as fo, case when o_orderkey % 5 = 0 then null else o_orderdate + (o_orderkey % 50) * interval '1' day end as lc from orders),
n as (select timestamp '1998-08-01' as now)
select 'kept' as kind, cast(o_orderkey as varchar) as award_id from g, n where fo is null or fo >= now - interval '45' day
union all (select 'recheck', cast(o_orderkey as varchar) from g, n where fo >= now - interval '400' day order by lc nulls first, fo nulls first, cast(o_orderkey as varchar) limit 25)""")
def award_retention(spark, sf):
    key = F.col("o_orderkey")
    first = F.col("o_orderdate").cast("timestamp")
    g = table(spark, sf, "orders").select(key.cast("string").alias("award_id"), F.when(key % 13 != 0, first).alias("first_observed"),
                                          F.when(key % 5 != 0, F.timestamp_micros(micros(first) + (key % 50) * 86_400_000_000)).alias("last_checked"))
    now = F.lit("1998-08-01").cast("timestamp")
    kept = awards.prune(g, now, awards.SEEN_RETENTION_DAYS).select(F.lit("kept").alias("kind"), "award_id")
    return kept.unionByName(awards.recheck_queue(g, now, window_days=400, limit=25).select(F.lit("recheck").alias("kind"), "award_id"))


@query("A18", """with r as (select l_orderkey as k, l_linestatus = 'O' as nx, sha256('{"reporting_fiscal_year":"' || cast(l_linenumber as varchar) || '","transaction_obligated_amount":"' || cast(cast(l_extendedprice * 100 as bigint) as varchar) || '"}') as h from lineitem),
f as (select k, count(*) as n, bool_or(nx) as more, sum(('0x' || substring(h, 1, 15))::bigint) as a, sum(('0x' || substring(h, 16, 15))::bigint) as b, sum(('0x' || substring(h, 31, 15))::bigint) as c, sum(('0x' || substring(h, 46, 15))::bigint) as d from r group by 1)
select k as lookup_id, n as funding_records, sha256(cast(more as varchar) || '|' || cast(n as varchar) || '|' || cast(a as varchar) || '|' || cast(b as varchar) || '|' || cast(c as varchar) || '|' || cast(d as varchar)) as funding_fingerprint from f""")
def award_funding(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("lookup_id"), F.col("l_linenumber").alias("reporting_fiscal_year"),
                                             F.round(F.col("l_extendedprice") * 100).cast("long").alias("transaction_obligated_amount"), (F.col("l_linestatus") == "O").alias("has_next"))
    return awards.funding_evidence(li).select("lookup_id", "funding_records", "funding_fingerprint")


@query("A19 A22", """with s as (select user_id % 50 as source, count(*) filter (where event_type = 'error' and value > 400) as issues, count(*) filter (where event_type <> 'error') as good, max(cast(ts as date)) filter (where event_type = 'purchase') as d from events group by 1)
select source, case when good = 0 then 'FAILED' when issues > 0 or d is null then 'PARTIAL' when not (date '2024-01-31' - d between 0 and 1) then 'STALE' else 'SUCCESS' end as status, coalesce(date '2024-01-31' - d, -1) as age_days from s""")
def run_status(spark, sf):
    e = table(spark, sf, "events")
    s = e.groupBy((F.col("user_id") % 50).alias("source")).agg(
        F.count_if((F.col("event_type") == "error") & (F.col("value") > 400)).alias("issues"), F.count_if(F.col("event_type") != "error").alias("good"),
        F.max(F.when(F.col("event_type") == "purchase", F.to_date("ts"))).alias("d"))
    at = F.lit("2024-01-31 20:00:00").cast("timestamp")
    return s.select("source", awards.run_status(F.col("good") == 0, F.col("issues"), F.lit(True), awards.source_current(at, F.col("d"), 1)).alias("status"),
                    F.coalesce(awards.source_age_days(at, F.col("d")).cast("long"), F.lit(-1)).alias("age_days"))
