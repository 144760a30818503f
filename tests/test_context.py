import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import awards, bars, calendar, decision, energy, evidence as ev, rates, state

UTC = dt.timezone.utc
T0 = dt.datetime(2026, 5, 18, 14, 0, tzinfo=UTC)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# --- state ----------------------------------------------------------------------------------

LOG = "arrival_seq long, scope string, target string, name string, updated_at timestamp, valid_until timestamp, severity string, value string, source string"


def _log(n, seed):
    r = random.Random(seed)
    return [(i, "GLOBAL", "*", "hot" if r.random() < 0.8 else "n1", at(r.randint(0, 12)), None if r.random() < 0.5 else at(100), "LOW", str(r.randint(0, 1)), "s")
            for i in range(n)]


def _replay(rows):
    held, out = {}, {}
    for r in sorted(rows):
        k, content = r[1:4], r[5:]
        old = held.get(k)
        if old is None:
            out[r[0]] = "WRITTEN"
        elif r[4] < old[0]:
            out[r[0]] = "IGNORED_STALE"
            continue
        elif r[4] == old[0] and content == old[1]:
            out[r[0]] = "IGNORED_DUPLICATE"
            continue
        else:
            out[r[0]] = "REPLACED"
        held[k] = (r[4], content, r[0])
    return out, {k: v[2] for k, v in held.items()}


def test_status_and_latest_match_replay(spark, small_tasks):
    rows = _log(250, 3)
    df = spark.createDataFrame(rows, LOG)
    want, final = _replay(rows)
    for sliced in (False, True):
        assert {r.arrival_seq: r.update_status for r in state.update_status(df, sliced=sliced).collect()} == want
    assert {(r.scope, r.target, r.name): r.arrival_seq for r in state.latest(df).collect()} == final


def test_snapshot_levels(spark):
    rows = [(1, "GLOBAL", "*", "a", at(0), None, "MEDIUM", "true", "s"), (2, "TICKER", "X", "b", at(0), at(10), "CRITICAL", "true", "s"),
            (3, "SECTOR", "OIL", "c", at(0), at(99), "LOW", "1", "s"), (4, "TICKER", "Y", "d", at(0), at(5), "INFO", "1", "s")]
    log = spark.createDataFrame(rows, LOG).withColumn("flag_id", F.concat(F.lit(" f"), "name"))
    subjects = spark.createDataFrame([("X", "OIL", at(10)), ("X", "OIL", at(11)), ("Z", None, at(11))], "ticker string, sector string, now timestamp")
    got = {(r.ticker, r.now): (r.highest_severity, r.risk_level, r.fresh_entry_count, r.expired_entry_count, r.active_context_flag_ids)
           for r in state.snapshots(subjects, log).withColumn("now", F.unix_seconds("now")).collect()}
    s = lambda x: int(at(x).timestamp())
    assert got[("X", s(10))] == ("CRITICAL", "HIGH", 3, 0, ["fa", "fb"])          # the end is inclusive
    assert got[("X", s(11))] == ("MEDIUM", "ELEVATED", 2, 1, ["fa"])
    assert got[("Z", s(11))] == ("MEDIUM", "ELEVATED", 1, 0, ["fa"])
    only_old = spark.createDataFrame([(1, "GLOBAL", "*", "a", at(0), at(1), "HIGH", "1", "s")], LOG)
    r = state.snapshots(spark.createDataFrame([("X", None, at(5))], "ticker string, sector string, now timestamp"), only_old).first()
    assert (r.highest_severity, r.risk_level) == ("EXPIRED", "ELEVATED")


def test_eviction_keeps_newest(spark):
    df = spark.createDataFrame(_log(30, 5), LOG)
    assert [r.arrival_seq for r in state.evict(df, key=["name", "arrival_seq"], max_entries=3).collect()] == \
        [x[0] for x in sorted(_log(30, 5), key=lambda r: (r[4], r[3], r[0]), reverse=True)[:3]]


def test_decision_sees_no_future_and_cache_mode_counts_it(spark):
    rows = [(1, "GLOBAL", "*", "a", at(0), None, "LOW", "old", "fred_rates_v1"), (2, "GLOBAL", "*", "a", at(50), None, "LOW", "new", "fred_rates_v1"),
            (3, "TICKER", "X", "b", at(0), at(20), "LOW", "t", "yfinance_dev_raw_v1"), (4, "SECTOR", "OIL", "c", at(5), None, "LOW", "s", "else")]
    log = spark.createDataFrame(rows, LOG)
    d = spark.createDataFrame([(1, "X", at(20)), (2, "X", at(60)), (3, "Q", at(60))], "decision_id int, ticker string, evaluation_time timestamp")
    d = decision.resolve_sector(d, spark.createDataFrame([("X", "OIL")], "ticker string, sector string"))
    policy = decision.approvals([("fred_rates_v1", "GLOBAL", "a"), ("yfinance_dev_raw_v1", "TICKER", "b")])
    got = {}
    for r in decision.visible_entries(d, log, policy=policy).collect():
        got.setdefault(r.decision_id, []).append((r.scope, r.value, r.authority_class, r.source_mode))
    assert sorted(got[1]) == [("GLOBAL", "old", "APPROVED_RISK_CONTEXT", "OFFICIAL_SOURCE"), ("SECTOR", "s", "RESEARCH_ONLY", "UNKNOWN"),
                              ("TICKER", "t", "DEVELOPMENT_ONLY", "DEVELOPMENT_ONLY")]
    assert sorted(x[1] for x in got[2]) == ["new", "s"] and [x[1] for x in got[3]] == ["new"]
    cache = state.latest(log)
    assert {(r.decision_id, r.value) for r in decision.visible_entries(d, log, mode="cache", state=cache).collect()} == {
        (1, "t"), (1, "s"), (2, "new"), (2, "s"), (3, "new")}
    assert {r.decision_id: r.future_entry_exclusion_count for r in decision.future_exclusions(d, cache).collect()} == {1: 1, 2: 0, 3: 0}
    ctx = {r.decision_id: r for r in decision.assemble(d, decision.visible_entries(d, log, policy=policy)).collect()}
    assert [e.scope for e in ctx[1].structured_context] == ["GLOBAL", "SECTOR", "TICKER"] and len(ctx[1].approved_risk_context) == 1
    assert len({c.context_fingerprint for c in ctx.values()}) == 3 and ctx[3].sector_status == "UNRESOLVED"


def test_refresh_fold(spark, small_tasks):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.8 else "b", at(i), r.choice(["FAILED", "SUCCESS", "PARTIAL", "NO_FRESH_DATA"])) for i in range(150)]
    log = spark.createDataFrame(rows, "source_id string, observed_at timestamp, status string").withColumns({
        "failed": F.col("status") == "FAILED", "usable": F.col("status").isin("SUCCESS", "PARTIAL"), "full_success": F.col("status") == "SUCCESS",
        "completed_at": F.col("observed_at")})
    want = {}
    for k in ("hot", "b"):
        fails = bad = 0
        for s, t, st in (x for x in rows if x[0] == k):
            fails = fails + 1 if st == "FAILED" else 0
            bad = 0 if st in ("SUCCESS", "PARTIAL") else bad + 1
            want[int(t.timestamp())] = (fails, bad)
    for sliced in (False, True):
        got = state.refresh_state(log, sliced=sliced).withColumn("t", F.unix_seconds("observed_at")).collect()
        assert {x.t: (x.consecutive_failure_count, x.consecutive_non_usable_count) for x in got} == want


# --- evidence -------------------------------------------------------------------------------

DAY = 86_400_000_000
EV = ("evidence_id string, category string, source string, source_record_id string, policy_match_key string, tickers array<string>, sector string, is_global boolean, "
      "available_at timestamp, valid_from timestamp, valid_until timestamp, policy_eligible boolean, payload string")


def _evidence(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        glob = r.random() < 0.2
        tickers = [] if glob else r.sample(["A", "B", "C"], r.randint(0, 2))
        a = None if r.random() < 0.1 else at(r.randint(0, 20) * 3600)
        out.append((f"e{i}", r.choice(["FLAG", "AI_EVENT"]), "src", f"r{i}", f"FLAG_TYPE:K{r.randint(0, 3)}", tickers, None if glob or r.random() < 0.5 else r.choice("PQ"), glob,
                    a, None if r.random() < 0.7 else at(r.randint(0, 25) * 3600), None if r.random() < 0.5 else at(r.randint(0, 30) * 3600), r.random() < 0.9, None))
    return out


def _reason(e, ticker, sector, t, max_age):
    if not e[11]:
        return "n_policy_ineligible"
    if e[8] is None:
        return "n_missing_availability"
    if not (e[7] or ticker in e[5] or (sector is not None and e[6] == sector)):
        return "n_scope_mismatch"
    if e[8] > t or (e[9] is not None and e[9] > t):
        return "n_future"
    if e[10] is not None and t > e[10]:
        return "n_expired"
    if e[10] is None and t - e[8] > max_age:
        return "n_outside_lookback"
    return "n_selected"


def test_selection_and_counts_match_every_pair(spark, small_tasks):
    rows = _evidence(120, 7)
    r = random.Random(8)
    ds = [(i, r.choice("ABCD"), r.choice(["P", "Q", None]), at(r.randint(0, 30) * 3600)) for i in range(60)]
    e = spark.createDataFrame(rows, EV)
    d = spark.createDataFrame(ds, "decision_id int, ticker string, sector string, evaluation_time timestamp")
    age = dt.timedelta(hours=6)
    want = {x[0]: {} for x in ds}
    pairs = set()
    for x in ds:
        for y in rows:
            reason = _reason(y, x[1], x[2], x[3], age)
            want[x[0]][reason] = want[x[0]].get(reason, 0) + 1
            if reason == "n_selected":
                pairs.add((x[0], y[0]))
    got = ev.select(d, e, max_age_us=DAY // 4).collect()
    assert len(got) == len(pairs) and {(g.decision_id, g.evidence_id) for g in got} == pairs
    for sliced in (False, True):
        for g in ev.exclusion_counts(d, e, max_age_us=DAY // 4, sliced=sliced).collect():
            counts = {k: v for k, v in g.asDict().items() if k != "decision_id" and v}
            assert counts == want[g.decision_id]
    policy = ev.Policy((ev.Rule("a", ("FLAG_TYPE:K2",), "BLOCK", "ra"), ev.Rule("b", ("FLAG_TYPE:K0", "FLAG_TYPE:K1"), "REDUCE_SIZE", "rb", 0.5)))
    by_id = {y[0]: y for y in rows}
    for g in ev.evaluate(d, e, policy, max_age_us=DAY // 4).collect():
        mine = [by_id[q] for p, q in pairs if p == g.decision_id]
        order = lambda y: (y[8], y[1], y[2], y[3], y[0])
        first = next((rule for rule in policy.rules if any(y[4] in rule.match_keys for y in mine)), None)
        assert g.hypothetical_action == (first.action if first else "NO_CHANGE")
        hits = sorted((y for y in mine if first and y[4] in first.match_keys), key=order)
        assert g.matched_context_flag_ids == [y[0] for y in hits if y[1] == "FLAG"] and g.matched_context_event_ids == [y[0] for y in hits if y[1] == "AI_EVENT"]


def test_selection_digest_identifies_the_selected_set(spark, small_tasks):
    rows = _evidence(60, 9)
    r = random.Random(10)
    ds = [(i, r.choice("ABC"), r.choice(["P", "Q", None]), at(r.randint(0, 30) * 3600)) for i in range(80)]
    e, d = spark.createDataFrame(rows, EV), spark.createDataFrame(ds, "decision_id int, ticker string, sector string, evaluation_time timestamp")
    chosen = {x[0]: frozenset(y[0] for y in rows if _reason(y, x[1], x[2], x[3], dt.timedelta(hours=6)) == "n_selected") for x in ds}
    for sliced in (False, True):
        got = {g.decision_id: (g.selected_count, g.selected_digest) for g in ev.selection_digest(d, e, max_age_us=DAY // 4, sliced=sliced).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in chosen.items()}
        assert len({v[1] for v in got.values()}) == len(set(chosen.values()))
        assert all((got[a][1] == got[b][1]) == (chosen[a] == chosen[b]) for a in chosen for b in chosen)
    one = spark.createDataFrame([(1, "s1", at(0), "v", "h")], "decision_id int, signal string, evaluation_time timestamp, policy_version string, policy_config_hash string")
    digest = spark.createDataFrame([(1, 2, "dig")], "decision_id int, selected_count long, selected_digest string")
    ids = lambda fp: ev.identify(one, spark.createDataFrame([(1, fp)], "decision_id int, context_fingerprint string"), digest, run_hash="r", signal_id="signal").first()
    assert ids("a").shadow_evaluation_id == ids("a").shadow_evaluation_id != ids("b").shadow_evaluation_id


def test_policy_and_run_checks(spark):
    with pytest.raises(ValueError):
        ev.Rule("x", ("BAD",), "BLOCK", "r")
    with pytest.raises(ValueError):
        ev.Rule("x", ("FLAG_TYPE:A",), "BLOCK", "r", 0.5)
    with pytest.raises(ValueError):
        ev.Policy((ev.Rule("x", ("FLAG_TYPE:A",), "BLOCK", "r"), ev.Rule("x", ("FLAG_TYPE:B",), "BLOCK", "r")))
    with pytest.raises(ValueError):
        ev.RunDefinition(("A",), ("src",), 10, 10)


def test_adapters_share_columns(spark):
    flags = spark.createDataFrame([("f1", "src", "halt", "A", None, at(0), None, at(9))],
                                  "context_flag_id string, source string, flag_type string, ticker string, sector string, available_at timestamp, valid_from timestamp, valid_until timestamp")
    insider = spark.createDataFrame([("acc", 0, "SEC_FORM4_SALE", "A", at(0), "AMENDMENT_UNRESOLVED")],
                                    "accession_number string, transaction_index int, event_type string, issuer_ticker string, available_at timestamp, aggregate_eligibility string")
    rows = ev.from_flags(flags).unionByName(ev.from_insider_events(insider)).collect()
    assert [(r.policy_match_key, r.tickers, r.is_global, r.policy_eligible) for r in rows] == [
        ("FLAG_TYPE:HALT", ["A"], False, True), ("DETERMINISTIC_EVENT_TYPE:SEC_FORM4_SALE", ["A"], False, False)]


# --- source facts ---------------------------------------------------------------------------

def test_rates(spark):
    raw = [("S", "2026-05-15", "4.10", 0), ("S", "2026-05-15", "9", 1), ("S", "2026-05-14", ".", 2), ("S", "2026-05-13", "4.00", 3), ("S", "2026-05-19", "7", 4),
           ("M", "2026-05-15", "3.90", 0), ("L", "2026-05-15", "4.50", 0), ("O", "2026-04-01", "1", 0), ("S", "2026-5-12", "1", 9)]
    day = F.lit("2026-05-18").cast("date")
    pairs = rates.latest_two(rates.valid_observations(spark.createDataFrame(raw, "series string, date string, value string, row_seq int"), evaluation_date=day))
    facts, issues = rates.facts(pairs, evaluation_date=day, max_age_days=7, spreads={"ms": ("M", "S"), "lm": ("L", "M")}, regime=("S", "M", "L"))
    got = {r.indicator: (float(r.value) if r.value is not None else r.label) for r in facts.collect()}
    assert got == {"S": 4.1, "M": 3.9, "L": 4.5, "S_change": pytest.approx(0.1), "ms": pytest.approx(-0.2), "lm": pytest.approx(0.6),
                   "rate_curve_regime_v1": "FRONT_INVERTED__LONG_POSITIVE"}
    assert [(r.issue_type, r.indicator) for r in issues.collect()] == [("STALE_SERIES", "O")]
    until = facts.filter("indicator = 'S'").select(F.unix_micros("valid_until").alias("u")).first().u
    assert until == int(dt.datetime(2026, 5, 23, 4, 0, tzinfo=UTC).timestamp() * 1e6) - 1          # end of May 22 in New York
    facts, issues = rates.facts(pairs, evaluation_date=day, max_age_days=7, spreads={"ms": ("M", "S")}, stale_series=["S"])
    assert {r.indicator for r in facts.collect()} == {"M", "L"}
    assert "DERIVATION_SUPPRESSED_STALE_COMPONENT" in {r.issue_type for r in issues.collect()}


def test_weekly_facts(spark):
    rows = [("crude", "2026-05-15", "10"), ("crude", "2026-05-08", "7"), ("gas", "2026-05-15", "3"), ("gas", "2026-05-15", "4"), ("oil", "2026-05-15", "3"),
            ("oil", "2026-05-15", "3"), ("oil", "2026-05-08", "x")]
    df = spark.createDataFrame(rows, "series string, period string, value string").withColumns({"units": F.lit("u"), "expected_units": F.lit("u")})
    facts, issues = energy.weekly_facts(energy.select_periods(df), at=F.lit("2026-05-15").cast("date"))
    assert sorted((r.series, r.kind, r.value) for r in facts.collect()) == [("crude", "change_wow", 3.0), ("crude", "level", 10.0), ("oil", "level", 3.0)]
    assert sorted((r.series, r.issue_type) for r in issues.collect()) == [("gas", "CURRENT_PERIOD_INVALID"), ("oil", "EXPECTED_PRIOR_PERIOD_MISSING")]


def test_release_windows_are_inclusive(spark):
    rel = energy.windows(spark.createDataFrame([("r1", at(0), dt.date(2026, 5, 15)), ("r2", at(7200), dt.date(2026, 5, 15))],
                                               "release_id string, release_at timestamp, report_period date"), pre_minutes=10, post_minutes=5)
    p = spark.createDataFrame([(1, at(-600)), (2, at(300)), (3, at(301)), (4, at(-601)), (5, at(9000))], "id int, evaluation_time timestamp")
    t = spark.createDataFrame([("X",), ("Y",)], "ticker string")
    assert sorted((r.id, r.ticker) for r in energy.release_flags(p, rel, t).collect()) == [(1, "X"), (1, "Y"), (2, "X"), (2, "Y")]
    assert {r.id: r.release_id for r in energy.target_release(p, rel).collect()} == {1: "r1", 2: "r1", 3: "r1", 4: "r1", 5: "r2"}
    assert {r.problem for r in energy.release_order_problems(rel).collect()} == {"duplicate_report_period", "period_not_increasing"}
    assert energy.next_transitions(rel, F.lit(at(300)).cast("timestamp")).first().next_transition == int(at(300).timestamp() * 1e6) + 1


def test_bars(spark):
    close = {0: 10.0, 300: 11.0, 600: 12.0, 900: float("nan")}
    rows = [("A", at(s), c, i) for i, (s, c) in enumerate(close.items())] + [("A", at(0), 10.0, 9), ("B", at(0), 1.0, 0), ("B", at(0), 2.0, 1), ("C", at(900), 5.0, 0)]
    good, issues = bars.prepare(spark.createDataFrame(rows, "symbol string, bar_start timestamp, close double, row_seq int"))
    assert [(r.symbol, r.issue_type) for r in issues.collect()] == [("B", "CONFLICTING_DUPLICATE_TIMESTAMP")]
    ind, problems = bars.indicators(good, F.lit(at(931)).cast("timestamp"))
    got = {(r.symbol, r.indicator): r.value for r in ind.collect()}
    assert got == {("A", "latest_close"): 12.0, ("A", "return_5m"): pytest.approx(12 / 11 - 1)}
    assert sorted((r.symbol, r.issue_type, r.window) for r in problems.collect() if r.window) == [("A", "MISSING_EXACT_LOOKBACK", "15m"), ("A", "MISSING_EXACT_LOOKBACK", "60m")]
    assert [(r.symbol, r.issue_type) for r in problems.collect() if not r.window] == [("C", "NO_COMPLETED_BARS")]
    wide = spark.createDataFrame([(at(0), 1.0, None)], "bar_start timestamp, Close_A double, Close_B double")
    long = bars.wide_to_long(wide, ["A", "B", "Z"])
    assert sorted((r.symbol, r.close) for r in long.collect() if r.close) == [("A", 1.0)]
    assert sorted(r.symbol for r in bars.missing_symbols(long, spark.createDataFrame([("A",), ("B",), ("Z",)], "symbol string")).collect()) == ["B", "Z"]


def test_calendar_rules(spark):
    good = dict(occurrence_id="o1", event_type="CPI", tier="TIER_1", status="CONFIRMED", published_at=at(0), captured_at=at(1), scheduled_at=at(2), revision_id="r1", source_reference="ref")
    bad = [("event_type", "NFP2", "event_type"), ("tier", "X", "tier"), ("source_reference", "eia page", "forbidden_family"), ("status", "SCHEDULED", "status"),
           ("published_at", at(5), "published_before_captured")]
    rows = [good] + [{**good, c: v} for c, v, _ in bad]
    schema = "occurrence_id string, event_type string, tier string, status string, published_at timestamp, captured_at timestamp, scheduled_at timestamp, revision_id string, source_reference string"
    from tidemark.operators.quality import check
    got = check(spark.createDataFrame([tuple(r.values()) for r in rows], schema), calendar.problems()).collect()
    assert [r.violations for r in got] == [[]] + [[name] for _, _, name in bad]


def test_award_rules(spark):
    fund = [("l1", "10", "2024", False), ("l1", "20", "2024", False)]
    schema = "lookup_id string, transaction_obligated_amount string, reporting_fiscal_year string, has_next boolean"
    a = awards.funding_evidence(spark.createDataFrame(fund, schema)).first()
    b = awards.funding_evidence(spark.createDataFrame(fund[::-1], schema)).first()
    c = awards.funding_evidence(spark.createDataFrame([*fund[:1], ("l1", "21", "2024", False)], schema)).first()
    assert a.funding_fingerprint == b.funding_fingerprint != c.funding_fingerprint and a.funding_records == 2
    row = spark.createDataFrame([("xom", "U", "G1", "NEW_AWARD_DISCOVERED", "m1", "A", dt.date(2026, 5, 1), 10.50, 0.0, None, 2, "f", False)],
                                "ticker string, uei string, generated_unique_award_id string, event_classification string, mapping_version string, award_type string, business_date date, "
                                "total_obligation double, base_exercised_options double, base_and_all_options double, funding_records int, funding_fingerprint string, has_next boolean")
    now = F.lit("2026-05-02").cast("timestamp")
    event = awards.event_rows(row, now)
    e = event.first()
    assert (e.total_obligation_usd, e.base_exercised_options_usd, e.entry_name, e.amount_semantics) == ("10.5", "0", "usaspending:contract_award:XOM:G1", "award_total_not_incremental")
    again = awards.event_rows(row, F.lit("2027-01-01").cast("timestamp")).first()
    changed = awards.event_rows(row.withColumn("total_obligation", F.lit(11.0)), now).first()
    assert e.semantic_event_fingerprint == again.semantic_event_fingerprint != changed.semantic_event_fingerprint
    s = awards.state_entries(event).first()
    assert (s.scope, s.target, s.value, s.valid_until) == ("TICKER", "XOM", "NEW_AWARD_DISCOVERED", None)
    late = dt.datetime(2026, 5, 19, 3, 0, tzinfo=UTC)                # still May 18 in New York
    df = spark.createDataFrame([(None, dt.date(2026, 5, 16)), (None, dt.date(2026, 5, 15)), (None, None), ("NEW_AWARD_DISCOVERED", None)], "stored string, d date")
    got = [r.c for r in df.select(awards.classify(F.col("stored"), F.col("d"), F.lit(late).cast("timestamp"), 2).alias("c")).collect()]
    assert got == ["NEW_AWARD_DISCOVERED", "LATE_OR_BACKFILL_DISCOVERY", "LATE_OR_BACKFILL_DISCOVERY", "NEW_AWARD_DISCOVERED"]


def test_interval_join_keeps_the_intervals_off_the_driver(spark):
    from tidemark.operators.intervals import interval_join
    points = spark.createDataFrame([(i % 3, i * 1000) for i in range(50)], "k int, at long")
    spans = spark.createDataFrame([(k, a * 1000, a * 1000 + 5000) for k in range(3) for a in range(0, 50, 7)], "k int, a long, z long")
    out = interval_join(points, spans, keys=["k"], at="at", start="a", end="z")
    assert out.count() == sum(1 for i in range(50) for a in range(0, 50, 7) if a * 1000 <= i * 1000 <= a * 1000 + 5000)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()  # tiny sides, which a plan would broadcast


def test_live_sums_are_exact_and_one_row_per_scope_key(spark, monkeypatch):
    t = lambda n: dt.datetime(2026, 5, 1) + dt.timedelta(minutes=n)
    values = [3 * 2 ** 60, -5, 2 ** 33 + 7, 2 ** 62 - 1, -2 ** 62, 0, None, 2 ** 62]
    e = spark.createDataFrame([(f"e{i}", i % 3, v, ["A"], None, False, t(i), None, t(i + 4), True) for i, v in enumerate(values)],
                              "evidence_id string, ordinal int, v long, tickers array<string>, sector string, is_global boolean, available_at timestamp, valid_from timestamp, valid_until timestamp, policy_eligible boolean")
    d = spark.createDataFrame([(i, "A", "G", t(i)) for i in range(12)], "decision_id long, ticker string, sector string, evaluation_time timestamp")
    rows, scan = [], ev.OrderedScan
    monkeypatch.setattr(ev, "OrderedScan", lambda df, *a, **k: rows.append(df.where("_kind = 1").count()) or scan(df, *a, **k))
    got = {(r.decision_id, r.ordinal): (r.n, r.total) for r in ev.live_sums(
        d, e, id="decision_id", at="evaluation_time", max_age_us=1, value=F.col("v"), ordinals=3).collect()}
    want = {}
    for i in range(12):
        for j, v in enumerate(values):
            if j <= i <= j + 4:
                n, s = want.get((i, j % 3), (0, 0))
                want[i, j % 3] = (n + 1, s + (v or 0))
    assert got == want
    assert rows == [4 * 12]  # a decision's four scope keys, not once more for every ordinal
