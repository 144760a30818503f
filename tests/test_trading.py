import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cost, fills, labels, orders, positions, risk

UTC = dt.timezone.utc


# --- cost and labels ------------------------------------------------------------------------

def _cost(spark, **kw):
    row = dict(side="BUY", horizon="5m", order_style="MARKET", expected_gross_move_bps=20.0, midprice=100.0, quantity=1.0, spread=None, spread_bps=None)
    row.update(kw)
    schema = "side string, horizon string, order_style string, expected_gross_move_bps double, midprice double, quantity double, spread double, spread_bps double"
    return cost.estimate(spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)).first()


def test_cost_components(spark):
    r = _cost(spark, spread=0.05, quantity=1100.0)
    assert r.cost_spread_bps == pytest.approx(5.0) and r.estimated_slippage_bps == pytest.approx(2.0) and r.size_penalty_bps == pytest.approx(0.25)
    assert r.net_expected_edge_bps == pytest.approx(12.75) and r.profitable_after_costs and not r.fallback_spread_applied


def test_cost_fallback_bps_precedence_and_limit_orders(spark):
    r = _cost(spark)
    assert r.fallback_spread_applied and r.reason == "fallback_minimum_spread_bps_applied" and r.cost_spread_bps == 1.0
    assert _cost(spark, spread=9.0, spread_bps=3.0).cost_spread_bps == 3.0
    r = _cost(spark, order_style="LIMIT_AT_MID", spread_bps=3.0, horizon="1m")
    assert r.spread_cost_bps == 0 and r.missed_fill_penalty_bps == pytest.approx(0.3 * 18.0)
    assert _cost(spark, order_style="LIMIT_AT_MID", spread_bps=3.0, expected_gross_move_bps=-5.0).missed_fill_penalty_bps == 0


def test_cost_threshold_is_strict(spark):
    assert not _cost(spark, spread_bps=2.0, expected_gross_move_bps=5.0).profitable_after_costs       # edge is exactly 1
    assert _cost(spark, spread_bps=2.0, expected_gross_move_bps=5.0001).profitable_after_costs


@pytest.mark.parametrize("bad,error", [({"side": "HOLD"}, "invalid_side"), ({"horizon": "2m"}, "invalid_horizon"), ({"order_style": ""}, "invalid_order_style"),
                                       ({"midprice": 0.0}, "invalid_midprice"), ({"quantity": -1.0}, "invalid_quantity"), ({"spread": -0.1}, "negative_spread"),
                                       ({"spread_bps": -1.0}, "negative_spread_bps")])
def test_cost_rejections(spark, bad, error):
    r = _cost(spark, **bad)
    assert r.error == error and r.total_cost_bps is None


def test_label_bounds_ties_and_session(spark, small_tasks):
    at = dt.datetime(2026, 5, 18, 14, 0, tzinfo=UTC)
    close = dt.datetime(2026, 5, 18, 20, 0, tzinfo=UTC)          # 16:00 in New York
    sec = lambda t, s: t + dt.timedelta(seconds=s)
    snaps = spark.createDataFrame([("A", at, 100.0, 0.02, 1), ("A", sec(close, -60), 100.0, 0.02, 2), ("A", sec(close, -30), 100.0, 0.02, 3)],
                                  "ticker string, snapshot_time timestamp, midprice double, spread double, id int")
    prices = spark.createDataFrame([("A", sec(at, 59.999999), 1.0, 1), ("A", sec(at, 60), 101.0, 2), ("A", sec(at, 60), 102.0, 3), ("A", sec(at, 305), 103.0, 4),
                                    ("A", sec(at, 905.000001), 104.0, 5), ("B", sec(at, 900), 9.0, 6), ("A", close, 105.0, 7), ("A", sec(close, 1), 106.0, 8)],
                                   "ticker string, event_time timestamp, midprice double, ingest_seq long")
    for sliced in (False, True):
        good, bad = labels.labels(snaps, prices, sliced=sliced)
        got = {(r.id, r.horizon, r.side): r.forward_midprice for r in good.collect()}
        assert got == {(1, "1m", "BUY"): 101.0, (1, "1m", "SELL"): 101.0, (1, "5m", "BUY"): 103.0, (1, "5m", "SELL"): 103.0,
                       (2, "1m", "BUY"): 105.0, (2, "1m", "SELL"): 105.0}
        reasons = {(r.id, r.horizon): r.error for r in bad.collect()}
        assert reasons[(1, "15m")] == "no_forward_price" and reasons[(3, "1m")] == "outside_session" and reasons[(2, "5m")] == "outside_session"


# --- risk -----------------------------------------------------------------------------------

def _decide(spark, config=risk.RiskConfig(), **kw):
    t = dt.datetime(2026, 5, 18, 14, 0, tzinfo=UTC)
    row = dict(ticker="A", signal="BUY", confidence=0.5, evaluation_time=t, market_data_time=t, spread_dollars=0.01, spread_bps=1.0, latency_ms=10.0,
               cost_ticker="A", profitable_after_costs=True, daily_loss_dollars=0.0, consecutive_losses=0, open_positions=0, symbol_position_exists=False,
               duplicate_or_conflicting_order=False, event_window_active=False, high_risk_context_active=False, elevated_risk_context_active=False)
    row.update(kw)
    kinds = {str: "string", bool: "boolean", float: "double", int: "int", dt.datetime: "timestamp", type(None): "double"}
    special = {"cost_ticker": "string", "market_data_time": "timestamp"}
    schema = ", ".join(f"{k} {special.get(k, kinds[type(v)])}" for k, v in row.items())
    return risk.decide(spark.createDataFrame([tuple(row.values())], schema), config).first()


@pytest.mark.parametrize("kw,reason", [
    ({}, "approved"), ({"cost_ticker": None}, "missing_cost_estimate"), ({"cost_ticker": "B"}, "cost_estimate_ticker_mismatch"),
    ({"profitable_after_costs": False}, "cost_not_profitable_after_costs"), ({"spread_dollars": None, "spread_bps": None}, "missing_spread"),
    ({"spread_dollars": 0.06}, "spread_dollars_too_wide"), ({"spread_bps": 10.5}, "spread_bps_too_wide"), ({"latency_ms": None}, "missing_latency_ms"),
    ({"latency_ms": 1001.0}, "latency_too_high"), ({"latency_ms": 1000.0}, "approved"), ({"market_data_time": None}, "missing_market_data_time"),
    ({"daily_loss_dollars": 50.0}, "daily_loss_limit_hit"), ({"consecutive_losses": 3}, "consecutive_loss_limit_hit"),
    ({"duplicate_or_conflicting_order": True}, "duplicate_or_conflicting_order"), ({"open_positions": 3}, "max_open_positions_hit"),
    ({"symbol_position_exists": True}, "max_position_per_symbol_hit"), ({"event_window_active": True, "high_risk_context_active": True}, "event_window_active"),
    ({"high_risk_context_active": True, "elevated_risk_context_active": True}, "high_context_risk"), ({"elevated_risk_context_active": True}, "elevated_context_risk"),
    ({"signal": "HOLD", "cost_ticker": None}, "signal_no_action"), ({"signal": "EXIT", "latency_ms": None}, "signal_exit")])
def test_first_failing_rule_wins(spark, kw, reason):
    r = _decide(spark, **kw)
    assert r.reasons[0] == reason
    assert r.decision == {"approved": "APPROVE", "elevated_context_risk": "REDUCE_SIZE", "signal_no_action": "DO_NOTHING", "signal_exit": "EXIT"}.get(reason, "BLOCK")


def test_staleness_is_strict_and_future_data_passes(spark):
    t = dt.datetime(2026, 5, 18, 14, 0, tzinfo=UTC)
    assert _decide(spark, market_data_time=t - dt.timedelta(seconds=5)).decision == "APPROVE"
    assert _decide(spark, market_data_time=t - dt.timedelta(seconds=5, microseconds=1)).reasons == ["stale_market_data"]
    assert _decide(spark, market_data_time=t + dt.timedelta(seconds=50)).decision == "APPROVE"


def test_switched_off_rules(spark):
    c = risk.RiskConfig(reject_if_expected_edge_below_cost=False, block_during_eia_window=False, block_during_cpi_window=False, block_during_fomc_window=False,
                        block_on_high_risk=False, reduce_size_on_elevated_risk=False, max_position_per_symbol=2)
    assert _decide(spark, c, cost_ticker=None, event_window_active=True, high_risk_context_active=True, elevated_risk_context_active=True,
                   symbol_position_exists=True).decision == "APPROVE"


# --- orders ---------------------------------------------------------------------------------

def test_gate_reasons(spark):
    rows = [(1, "s1", "a", "BUY", "APPROVE", True, None, True, 10.0), (2, "s2", "A", "BUY", "APPROVE", True, None, True, 1.0),
            (3, "s3", "A", "SELL", "APPROVE", True, None, True, 1.0), (4, "s4", "A", "EXIT", "EXIT", True, None, False, None),
            (5, "s5", "A", "BUY", "APPROVE", True, None, True, 1.0), (6, "s6", "A", "EXIT", "EXIT", True, None, True, None),
            (7, "s7", "B", "BUY", "REDUCE_SIZE", True, 0.5, True, 10.0), (8, "s8", "C", "BUY", "REDUCE_SIZE", True, None, True, 10.0),
            (9, "s9", "D", "BUY", "APPROVE", True, None, False, 1.0), (10, "s10", "E", "BUY", "APPROVE", False, None, True, 1.0),
            (11, "s11", "F", "HOLD", "APPROVE", True, None, True, 1.0), (12, "s12", "G", "BUY", "APPROVE", True, None, True, 0.0),
            (13, "s13", "H", "BUY", "APPROVE", True, None, True, 1.0), (14, "s14", "I", "BUY", "BLOCK", False, None, True, 1.0)]
    d = spark.createDataFrame(rows, "seq int, signal_id string, ticker string, signal string, decision string, approved boolean, reduce_size_factor double, risk_logged boolean, desired_quantity double")
    open_orders = spark.createDataFrame([("h", "SELL", "new"), ("b", "BUY", "FILLED")], "ticker string, side string, status string")
    got = {r.signal_id: (r.allowed, r.reason, r.effective_quantity) for r in orders.gate(d, open_orders=open_orders, seq="seq").collect()}
    assert got == {
        "s1": (True, "risk_decision_approved", 10.0), "s2": (False, "duplicate_open_order", 1.0), "s3": (False, "conflicting_open_order", 1.0),
        "s4": (True, "exit_close_position_allowed", None), "s5": (False, "liquidation_in_progress", 1.0), "s6": (False, "close_position_already_in_progress", 0.0),
        "s7": (True, "risk_decision_reduced_size", 5.0), "s8": (False, "invalid_reduce_size_factor", 0.0), "s9": (False, "risk_log_failed", 0.0),
        "s10": (False, "risk_decision_not_approved", 0.0), "s11": (False, "signal_no_order", 0.0), "s12": (False, "invalid_quantity", 0.0),
        "s13": (False, "conflicting_open_order", 1.0), "s14": (False, "risk_decision_blocked", 0.0)}


# --- positions ------------------------------------------------------------------------------

SCHEMA = "fill_id string, ticker string, side string, quantity double, fill_price double, seq long"


def _replay(rows):
    """Plain re-statement of the position rules."""
    book, out = {}, {}
    for fid, k, side, qty, price, seq in sorted(rows, key=lambda r: r[5]):
        q, avg, real = book.get(k, (0.0, None, 0.0))
        d = qty if side == "BUY" else -qty
        delta = 0.0
        if q == 0:
            book[k] = (d, price, 0.0)
        elif q * d > 0:
            book[k] = (q + d, (abs(q) * avg + abs(d) * price) / (abs(q) + abs(d)), real)
        else:
            delta = (price - avg if q > 0 else avg - price) * min(abs(q), abs(d))
            left = q + d
            if abs(left) <= 1e-12:
                book.pop(k)
            elif left * q > 0:
                book[k] = (left, avg, real + delta)
            else:
                book[k] = (left, price, real + delta)
        n = book.get(k, (0.0, None, None))
        out[fid] = (n[0], n[1], delta, n[2])
    return out


def test_fold_plain_and_sliced(spark, small_tasks):
    r = random.Random(17)
    rows = [(f"f{i}", "HOT" if r.random() < 0.85 else f"t{r.randint(0, 3)}", r.choice(["BUY", "SELL"]), float(r.randint(1, 6)), 10 + r.randint(0, 50) / 10, i)
            for i in range(300)]
    want = _replay(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for sliced in (False, True, None):
        got = positions.position_fold(df, order=["seq"], sliced=sliced).collect()
        assert len(got) == len(want)
        for x in got:
            q, avg, delta, real = want[x.fill_id]
            assert x.new_quantity == q and x.realized_pnl_delta == pytest.approx(delta, abs=1e-9)
            assert (x.average_price is None) == (avg is None) and (avg is None or x.average_price == pytest.approx(avg, rel=1e-12))
            assert (x.position_realized_pnl is None) == (real is None) and (real is None or x.position_realized_pnl == pytest.approx(real, abs=1e-9))


def test_duplicate_fills_and_account(spark, small_tasks):
    rows = [("a", "X", "BUY", 10.0, 10.0, 0), ("a", "X", "BUY", 99.0, 1.0, 1), ("b", "X", "SELL", 4.0, 9.0, 2), ("c", "X", "SELL", 6.0, 8.0, 3),
            ("d", "X", "BUY", 1.0, 5.0, 4), ("e", "X", "SELL", 1.0, 5.0, 5), ("f", "X", "BUY", 2.0, 5.0, 6), ("g", "X", "SELL", 2.0, 7.0, 7)]
    one = positions.unique_fills(spark.createDataFrame(rows, SCHEMA), ["seq"])
    assert one.count() == 7 and one.filter("fill_id = 'a'").first().quantity == 10.0
    for sliced in (False, True):
        acc = positions.account_state(positions.position_fold(one, order=["seq"]), order=["seq"], session_day=F.lit("2026-05-18").cast("date"), sliced=sliced)
        got = {r.fill_id: (r.total_realized_pnl, r.daily_loss_dollars, r.consecutive_losses) for r in acc.collect()}
        assert got == {"a": (0, 0, 0), "b": (-4, 4, 1), "c": (-16, 16, 2), "d": (-16, 16, 2), "e": (-16, 16, 2), "f": (-16, 16, 2), "g": (-12, 12, 0)}


def test_exposure_needs_marks_only_when_asked(spark):
    p = spark.createDataFrame([("A", -2.0, 10.0), ("B", 3.0, 5.0)], "ticker string, quantity double, average_price double")
    m = spark.createDataFrame([("A", 12.0)], "ticker string, price double")
    got = {r.sector: r.exposure for r in positions.exposure_summary(positions.exposure(p, m)).collect()}
    assert got == {"UNKNOWN": 39.0, "TOTAL": 39.0}
    with pytest.raises(Exception, match="missing mark price"):
        positions.exposure(p, m, require_marks=True).collect()


def test_slippage_signs(spark):
    df = spark.createDataFrame([("BUY", 118.44, 118.42, None), ("SELL", 118.40, 118.42, None), ("BUY", 1.0, 0.0, 5.0), ("BUY", 1.0, None, 2.0)],
                               "side string, fill_price double, explicit double, arrival double")
    got = [r.slippage for r in fills.with_slippage(df, explicit="explicit", arrival="arrival").collect()]
    assert got[0] == pytest.approx(0.02) and got[1] == pytest.approx(0.02) and got[2] is None and got[3] == pytest.approx(-1.0)


def test_payload_errors(spark):
    docs = ['{"id":"1","side":"buy","qty":"2","price":"3","symbol":"abc","filled_at":"2026-05-18T14:00:00Z"}', '{"side":"buy"}', "not json",
            '{"id":"2","order":{"side":"SELL","symbol":"x"},"quantity":1.5,"avg_price":2,"timestamp":"2026-05-18T14:00:00+00:00"}',
            '{"id":"3","side":"buy","qty":"0","price":"3","symbol":"abc","filled_at":"2026-05-18T14:00:00Z"}',
            '{"id":"4","side":"buy","qty":"1","price":"3","symbol":"abc","filled_at":"2026-05-18T14:00:00"}']
    got = fills.parse_payloads(spark.createDataFrame([(d,) for d in docs], "payload string")).collect()
    assert [r.error for r in got] == [None, "missing_fill_id", "missing_fill_id", None, "invalid_quantity", "invalid_fill_time"]
    assert (got[0].ticker, got[0].side, got[3].ticker, got[3].side, got[3].quantity) == ("ABC", "BUY", "X", "SELL", 1.5)


def test_sliced_fold_keeps_fills_without_ticker_and_runs_its_input_once(spark, small_tasks):
    rows = [(f"f{i}", "X" if i % 3 else None, "BUY" if i % 5 < 3 else "SELL", 2.0, 5.0 + i % 4, i) for i in range(200)]
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, SCHEMA)
    plain = positions.position_fold(df, order=["seq"], sliced=False).collect()
    cut = positions.position_fold(df.mapInArrow(seen, df.schema), order=["seq"], sliced=True).collect()
    assert [r[:8] for r in sorted(cut, key=lambda r: r.seq)] == [r[:8] for r in sorted(plain, key=lambda r: r.seq)]
    assert runs.value == 200


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_sliced_fold_and_account_scan_their_slices(spark, small_tasks):
    """Slices are written in order and whole, so neither fold nor account shuffles rows again; small batches go on from one another."""
    r = random.Random(23)
    rows = [(f"f{i}", r.choice(["X", "X", "X", "Y", None]), r.choice(["BUY", "SELL"]), float(r.randint(1, 6)), 10 + r.randint(0, 50) / 10, i) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        plain, cut = (positions.position_fold(df, order=["seq"], sliced=s) for s in (False, True))
        assert "Exchange hashpartitioning" not in _plan(cut) and "Exchange rangepartitioning" not in _plan(cut)
        numbers = [[tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in sorted(t.collect(), key=lambda x: x.seq)] for t in (plain, cut)]
        assert numbers[0] == numbers[1]
        # days that are no neighbours in the order, a day and profits that are NULL, several accounts or one
        fold = plain.withColumns({"realized_pnl_delta": F.when(F.col("seq") % 11 != 3, F.round(F.col("realized_pnl_delta") * 10)),
                                  "day": F.when(F.col("seq") % 7 != 5, F.date_add(F.lit("2026-05-18").cast("date"), (F.col("seq") % 3).cast("int")))}).localCheckpoint()
        for account in ([], ["ticker"]):
            plain, cut = (positions.account_state(fold, account=account, order=["seq"], session_day=F.col("day"), sliced=s) for s in (False, True))
            assert "Exchange hashpartitioning" not in _plan(cut) and "Exchange rangepartitioning" not in _plan(cut)
            assert plain.columns == cut.columns
            assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_slices_that_come_apart_are_refused(spark, small_tasks):
    from tidemark.operators.ordered import sorted_slices, slice_runs
    rows = sorted_slices(spark.range(200).toDF("n"), [F.col("n")], 200)

    def places(batches):
        yield from (b.select(["n"]) for b, _ in slice_runs(batches))

    assert sorted(x.n for x in rows.mapInArrow(places, "n long").collect()) == list(range(200))
    with pytest.raises(Exception, match="came apart"):
        rows.where("n % 5 = 0").mapInArrow(places, "n long").collect()


def test_newest_rows_of_a_key(spark):
    from tidemark.operators.ordered import newest
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), (None, 4, 4), (None, None, 5), ("b", None, 6)], "k string, at int, n int")
    assert sorted(x.n for x in newest(df, ["k"], "at").collect()) == [2, 3, 4, 6]
