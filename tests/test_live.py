"""The live window against plain windows, record by record."""

import random

import numpy as np
import pytest

from tidemark.operators.rolling import MEASURES
from tidemark.streaming import live as lv
from tidemark.streaming.live import Window, live_features
from tidemark.streaming.runner import in_slices

NAN = float("nan")


def records(seed, n=400):
    r = random.Random(seed)
    maybe = lambda v: v if r.random() < 0.7 else NAN
    out, at = [], 0
    for i in range(n):
        at += r.choice([0, 0, 1, 2, 9])
        value = lambda: round(r.uniform(-0.5, 9), r.choice([0, 2, 9]))
        out.append((at - r.choice([0, 0, 0, 3, 12, 40]), r.random() < 0.6, r.random() < 0.5, *[maybe(value()) for _ in range(8)]))
    return out


def plain(rows):
    """Features of a window's rows in arrival order."""
    w = [np.array([r[k] for r in rows], float) for k in range(11)]
    trade = w[1] > 0
    price, size, bid, ask, bid_size, ask_size, mid, spread = w[3:]
    known = lambda v: v[~np.isnan(v)]
    last = lambda v: v[-1] if len(v) else NAN
    ratio = lambda v: v[-1] / v[0] - 1 if len(v) >= 2 and v[0] > 0 else NAN
    both, mids, prices = ~np.isnan(bid) & ~np.isnan(ask), known(mid), known(price[trade])
    moves = (mids[1:] / np.where(mids[:-1] > 0, mids[:-1], 1) - 1)[mids[:-1] > 0]
    return [len(rows), trade.sum(), w[2].sum(), last(prices), last(known(size[trade])), last(known(bid)), last(known(ask)), last(known(bid_size)),
            last(known(ask_size)), last(mids), last(known(spread)), last(bid[both]), last(ask[both]), known(size[trade]).sum(), ratio(prices),
            ratio(mids), mids[-1] - mids[-2] if len(mids) >= 2 else NAN, np.std(moves) if len(moves) >= 2 else NAN]


@pytest.mark.parametrize("seed,cap", [(1, None), (2, None), (3, 7), (4, 1), (5, 30)])
def test_against_plain_windows(seed, cap):
    window, live, newest = Window(20, cap), [], None
    for i, row in enumerate(records(seed)):
        if i in (150, 151, 300):
            window.clear()
            live, newest = [], None
        window.add(i, *row)
        newest = row[0] if newest is None else max(newest, row[0])
        live = [x for x in [*live, (i, row)] if x[1][0] >= newest - 20]
        live = live[-cap:] if cap else live
        assert window.newest == newest and window.live() == [x[0] for x in live]
        assert np.allclose(window.snapshot(), plain([x[1] for x in live]), rtol=1e-11, atol=1e-13, equal_nan=True)


def test_numbers_without_end_and_sums_without_drift():
    w, inf = Window(10, None), float("inf")
    for i, (t, size, mid) in enumerate([(0, 1e300, 1e-300), (1, 0.1, inf), (2, inf, 2.0), (3, NAN, 3.0)]):
        w.add(i, t, True, False, 1.0, size, NAN, NAN, NAN, NAN, mid, NAN)
    assert w.snapshot()[13] == inf and np.isnan(w.snapshot()[-1])
    for i, t, size in ((4, 13, 0.1), (5, 14, 0.1), (6, 14, NAN)):
        w.add(i, t, True, False, 1.0, size, NAN, NAN, NAN, NAN, 3.0, NAN)
    assert w.snapshot()[13] == 0.2 and w.snapshot()[-1] == 0.0


def test_a_record_does_not_go_over_its_window(monkeypatch):
    """20,000 records of one window look at each row a few times."""
    looks = []
    monkeypatch.setattr(lv, "heappush", lambda heap, row: (looks.append(1), heap.append(row)))
    w = Window(1 << 40, None)
    for i in range(20_000):
        w.add(i, i, True, True, 1.0 + i % 3, 1.0, 1.0, 2.0, 1.0, 1.0, 1.0 + i % 5, 1.0)
        w.snapshot()
    assert len(looks) == 20_000 and all(len(s) == 1 for s in w.stacks) and w.rows == 20_000


def test_stream_in_slices(spark, monkeypatch):
    """Windows go on after a restart, and output comes in pieces."""
    monkeypatch.setattr(lv, "CHUNK", 7)
    none = lambda v: None if v != v else v
    rows = [("AB"[i % 2], i, 1_000_000 * r[0], "trade" if r[1] else "quote", *[none(v) for v in r[3:9]]) for i, r in enumerate(records(6, 120))]
    df = spark.createDataFrame(rows, "ticker string, ingest_seq long, t long, record_type string, price double, size double, bid_price double,"
                               " ask_price double, bid_size double, ask_size double").selectExpr("*", "timestamp_micros(t) as event_time")
    make = lambda s: live_features(s, lookback_seconds=20)
    key = lambda x: x.ingest_seq
    one, many = sorted(in_slices(df, "ingest_seq", 2, make, "live").collect(), key=key), sorted(in_slices(df, "ingest_seq", 4, make, "live").collect(), key=key)
    assert one == many and len(one) == 120 and {r.ticker for r in one} == {"A", "B"}
    assert list(MEASURES) == one[0].__fields__[3:]
    for k in "AB":
        seen = [r for r in rows if r[0] == k]
        for i, got in enumerate(r for r in one if r.ticker == k):
            newest = max(r[2] for r in seen[:i + 1])
            assert got.max_time == newest
            assert got.record_count_window <= i + 1
