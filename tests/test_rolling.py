import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators.live import live_totals
from tidemark.operators.parity import differences, out_of_order
from tidemark.session import MAX_ROWS_KEY
from tidemark.operators.rolling import final_snapshot, frame_totals, rolling_features
from tidemark.streaming.live import live_features

T0 = dt.datetime(2026, 5, 18, 13, 30, tzinfo=dt.timezone.utc)
SCHEMA = ("ticker string, event_time timestamp, ingest_seq long, record_type string, price double, size double, bid_price double, "
          "ask_price double, bid_size double, ask_size double")


def _records(n, seed, late=False):
    r = random.Random(seed)
    out, t = [], 0
    for i in range(n):
        t += r.choice([0, 0, 1, 3, 40])
        at = t - r.choice([0, 0, 5, 90]) if late else t
        kind = r.choice(["trade", "quote", "tbbo", "other"])
        price, size = (100.0 + r.randint(0, 40) / 10, float(r.randint(1, 9))) if kind in ("trade", "other") else (None, None)
        bid = 100.0 + r.randint(0, 30) / 10 if kind in ("quote", "tbbo") else None
        ask = bid + r.choice([0.0, 0.1, 0.4]) if bid else None
        if r.random() < 0.1:
            ask = None
        out.append(("HOT" if r.random() < 0.8 else "B", T0 + dt.timedelta(seconds=at), i, kind, price, size, bid, ask,
                    None if bid is None else float(r.randint(1, 5)), None if ask is None else 2.0))
    return out


def _window(rows):
    """Direct reading of the feature rules over the rows of one frame."""
    def like(r):
        has_quote = r[6] is not None or r[7] is not None
        return (r[3] in ("trade", "trades", "tbbo_trade") or (r[4] is not None and r[5] is not None and not has_quote),
                r[3] in ("quote", "bbo", "mbp-1", "tbbo", "bbo-1s", "bbo-1m") or (r[6] is not None and r[7] is not None))

    def last(values):
        known = [v for v in values if v is not None]
        return known[-1] if known else None

    trades = [r for r in rows if like(r)[0]]
    mids = [(r[6] + r[7]) / 2 for r in rows if r[6] is not None and r[7] is not None]
    prices = [r[4] for r in trades if r[4] is not None]
    returns = [b / a - 1 for a, b in zip(mids, mids[1:]) if a > 0]
    both = [r for r in rows if r[6] is not None and r[7] is not None]
    mid, spread = last(mids), last([r[7] - r[6] for r in both])
    return {
        "record_count_window": len(rows), "trade_count_window": len(trades), "quote_count_window": sum(like(r)[1] for r in rows),
        "last_trade_price": last(prices), "last_trade_size": last([r[5] for r in trades]), "last_bid_price": last([r[6] for r in rows]),
        "last_ask_size": last([r[9] for r in rows]), "midprice": mid, "spread": spread, "volume_window": sum(r[5] or 0 for r in trades),
        "price_return_window": prices[-1] / prices[0] - 1 if len(prices) >= 2 else None,
        "midprice_change_from_previous": mids[-1] - mids[-2] if len(mids) >= 2 else None,
        "simple_volatility_window": statistics.pstdev(returns) if len(returns) >= 2 else None}


def _close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


@pytest.mark.parametrize("cap", [50_000, 7])
def test_frames_match_direct_replay(spark, small_tasks, cap):
    rows = _records(260, 11)
    df = spark.createDataFrame(rows, SCHEMA)
    ordered = {k: sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])) for k in ("HOT", "B")}
    want = {}
    for mine in ordered.values():
        for i, r in enumerate(mine):
            want[r[2]] = _window([x for x in mine[: i + 1] if x[1] >= r[1] - dt.timedelta(seconds=60)][-cap:])
    for sliced in (False, True):
        got = {r.ingest_seq: r for r in rolling_features(df, cap=cap, sliced=sliced).collect()}
        assert set(got) == set(want)
        for seq, w in want.items():
            for c, v in w.items():
                assert _close(getattr(got[seq], c), v), (sliced, seq, c, getattr(got[seq], c), v)


def test_sliced_equals_plain_and_final(spark, small_tasks):
    df = spark.createDataFrame(_records(300, 12), SCHEMA)
    a, b = rolling_features(df, sliced=False), rolling_features(df, sliced=True)
    columns = [c for c in a.columns if c not in ("ticker", "ingest_seq", "event_time")]
    assert differences(a, b, ["ticker", "ingest_seq"], columns).count() == 0
    finals = {r.ticker: r.ingest_seq for r in final_snapshot(a).collect()}
    newest = {}
    for r in _records(300, 12):
        if r[0] not in newest or (r[1], r[2]) > newest[r[0]]:
            newest[r[0]] = (r[1], r[2])
    assert finals == {k: v[1] for k, v in newest.items()}


def test_inclusive_lower_bound_and_later_ties(spark):
    rows = [("A", T0, 0, "trade", 1.0, 1.0, None, None, None, None), ("A", T0 + dt.timedelta(seconds=60), 1, "trade", 1.0, 1.0, None, None, None, None),
            ("A", T0 + dt.timedelta(seconds=60), 2, "trade", 1.0, 1.0, None, None, None, None),
            ("A", T0 + dt.timedelta(seconds=60, microseconds=1), 3, "trade", 1.0, 1.0, None, None, None, None)]
    got = {r.ingest_seq: r.record_count_window for r in rolling_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 3}


def test_frame_totals_with_heavy_ties(spark, small_tasks):
    r = random.Random(3)
    rows = [("A", r.choice([1, 1, 1, 2, 9, 40]), i, float(r.randint(1, 5))) for i in range(250)]
    df = spark.createDataFrame(rows, "k string, d long, seq long, q double")
    ordered = sorted(rows, key=lambda x: (x[1], x[2]))
    want = {x[2]: sum(y[3] for y in ordered[: i + 1] if y[1] >= x[1] - 10) for i, x in enumerate(ordered)}
    for sliced in (False, True):
        got = frame_totals(df, key="k", at="d", order=["seq"], value="q", lookback=10, sliced=sliced).collect()
        assert {x.seq: x.frame_sum for x in got} == want


def test_live_totals_with_late_records(spark, small_tasks):
    r = random.Random(8)
    rows = [("HOT" if r.random() < 0.8 else "B", 1000 + 10 * i - r.choice([0, 0, 30, 400]), i, float(r.randint(1, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, a long, size double")
    want = {}
    for k in ("HOT", "B"):
        seen, top = [], None
        for x in sorted((x for x in rows if x[0] == k), key=lambda x: x[2]):
            seen.append(x)
            top = x[1] if top is None else max(top, x[1])
            live = [y for y in seen if y[1] >= top - 100]
            want[x[2]] = (top, len(live), sum(y[3] for y in live))
    for sliced in (False, True):
        got = live_totals(df, key="k", at="t", arrival="a", values={"volume": "size"}, lookback=100, sliced=sliced).collect()
        assert {x.a: (x.max_time, x.live_rows, x.live_volume) for x in got} == want


def test_live_stream_with_late_rows_and_reset(spark, tmp_path):
    from pyspark.sql import functions as F
    from tidemark.streaming.runner import file_stream, to_table
    rows = _records(120, 21, late=True)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("reset", F.col("ingest_seq") == 70)
    for i, part in enumerate(([0, 40], [40, 80], [80, 120])):
        (df.filter(F.col("ingest_seq").between(part[0], part[1] - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in")))
    stream = file_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema, files_per_batch=1)
    got = {r.ingest_seq: r for r in to_table(live_features(stream), "live-test").collect()}
    for k in ("HOT", "B"):
        live, top = [], None
        for x in sorted((x for x in rows if x[0] == k), key=lambda x: x[2]):
            if x[2] == 70:
                live, top = [], None
            live.append(x)
            top = x[1] if top is None else max(top, x[1])
            live = [y for y in live if y[1] >= top - dt.timedelta(seconds=60)]
            for c, v in _window(live).items():
                assert _close(getattr(got[x[2]], c), v), (x[2], c)


def test_out_of_order_rows(spark):
    df = spark.createDataFrame([("A", 1, 0), ("A", 5, 1), ("A", 4, 2), ("A", 5, 3)], "k string, t long, s long")
    assert [r.s for r in out_of_order(df, key="k", at="t", order=["s"]).collect()] == [2]


def test_frames_are_whole(spark):
    """Sixty thousand rows of one key and one day, on both paths."""
    df = spark.range(60_000).select(F.lit("A").alias("k"), F.lit(3).cast("long").alias("d"), F.col("id").alias("seq"), F.lit(1.0).alias("q"))
    spark.conf.set(MAX_ROWS_KEY, "20000")
    try:
        for sliced in (False, True):
            got = frame_totals(df, key="k", at="d", order=["seq"], value="q", lookback=10, sliced=sliced).agg(F.max("frame_rows"), F.max("frame_sum"), F.count("*")).first()
            assert tuple(got) == (60_000, 60_000.0, 60_000)
    finally:
        spark.conf.unset(MAX_ROWS_KEY)


def test_python_groups_are_bounded(spark, monkeypatch):
    """Below the limit of a Spark task a Python task still gets few rows at a time; blocks and slices give the same values."""
    from pyspark.sql import types as T
    from tidemark.operators import ordered
    from tidemark.operators.rolling import over_frames
    r = random.Random(8)
    df = spark.createDataFrame([("HOT" if i % 10 else None, r.randint(0, 3000), i, i % 7 / 4) for i in range(3000)], "k string, d long, seq long, q double")
    plain = frame_totals(df, key="k", at="d", order=["seq"], value="q", lookback=2000, sliced=False).collect()
    monkeypatch.setattr(ordered, "PYTHON_ROWS", 200)
    schema = T.StructType([df.schema["seq"], T.StructField("n", T.LongType())])
    got = over_frames(df, ["k"], ["d", "seq"], 50, None, lambda p: p.assign(n=len(p)), schema).collect()
    assert sorted(x.seq for x in got) == list(range(3000))
    assert max(x.n for x in got) < 1000
    cut = frame_totals(df, key="k", at="d", order=["seq"], value="q", lookback=2000).collect()
    assert sorted(map(str, cut)) == sorted(map(str, plain))


@pytest.mark.parametrize("cap", [None, 40])
def test_whole_keys_pass_in_pieces(spark, monkeypatch, cap):
    """Whole keys (``sliced=False``) larger than a Python task are not held whole, and have the values of keys that are."""
    from pyspark.sql import types as T
    from tidemark.operators import ordered
    from tidemark.operators.rolling import over_frames
    r = random.Random(9)
    df = spark.createDataFrame([("HOT" if i % 10 else None, r.randint(0, 3000), i, i % 7 / 4) for i in range(3000)], "k string, d long, seq long, q double")
    feed = spark.createDataFrame(_records(2000, 9), SCHEMA)
    totals = dict(key="k", at="d", order=["seq"], value="q", lookback=200, cap=cap, sliced=False)
    plain, features = frame_totals(df, **totals).collect(), rolling_features(feed, cap=cap, sliced=False).cache()
    features.count()
    monkeypatch.setattr(ordered, "PYTHON_ROWS", 200)
    schema = T.StructType([df.schema["seq"], T.StructField("n", T.LongType())])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        got = over_frames(df, ["k"], ["d", "seq"], 50, cap, lambda p: p.assign(n=len(p)), schema, sliced=False).collect()
        assert sorted(x.seq for x in got) == list(range(3000))
        assert max(x.n for x in got) < 400
        assert sorted(map(str, frame_totals(df, **totals).collect())) == sorted(map(str, plain))
        columns = [c for c in features.columns if c not in ("ticker", "ingest_seq", "event_time")]
        assert differences(features, rolling_features(feed, cap=cap, sliced=False), ["ticker", "ingest_seq"], columns).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
