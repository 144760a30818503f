import random

from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.intervals import interval_join
from tidemark.operators.ordered import OrderedScan, Running, first_per_key, positions


def _rows(n=400, seed=1):
    r = random.Random(seed)
    # one key holds most rows, and one instant holds many of them
    return [("hot" if r.random() < 0.8 else f"k{r.randint(0, 5)}", r.choice([5, 5, 5, r.randint(0, 50)]), i,
             r.choice([None, float(r.randint(-9, 9))])) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "key string, at long, seq long, v double")


def _expected(rows, reverse):
    out = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]), reverse=reverse)
        n, total, top, low, last, first, before = 0, None, None, None, None, None, None
        for r in mine:
            before = last
            v = r[3]
            if v is not None:
                n, total, last = n + 1, (total or 0) + v, v
                top, low = v if top is None else max(top, v), v if low is None else min(low, v)
                first = v if first is None else first
            out[r[2]] = (n, total, top, low, last, first, before)
    return out


def test_running_values_plain_and_sliced(spark, small_tasks):
    rows = _rows()
    specs = [Running("n", "count", "v"), Running("s", "sum", "v"), Running("hi", "max", "v"), Running("lo", "min", "v"),
             Running("l", "last", "v"), Running("f", "first", "v"), Running("p", "last", "v", inclusive=False)]
    for reverse in (False, True):
        want = _expected(rows, reverse)
        for sliced in (False, True, None):
            scan = OrderedScan(_frame(spark, rows), ["key"], ["at", "seq"], sliced=sliced)
            assert scan.sliced == (sliced is not False)       # None measures: the hot key is over the limit
            got = scan.running(*specs, reverse=reverse).result().collect()
            assert {r.seq: (r.n, r.s, r.hi, r.lo, r.l, r.f, r.p) for r in got} == want


def test_second_pass_reads_first(spark, small_tasks):
    rows = _rows(300, 2)
    for sliced in (False, True):
        scan = OrderedScan(_frame(spark, rows), ["key"], ["at", "seq"], sliced=sliced)
        scan = scan.running(Running("n", "count", F.lit(1))).running(Running("top", "max", F.col("n")))
        assert all(r.n == r.top for r in scan.result().collect())


def test_positions_and_first(spark, small_tasks):
    rows = _rows(300, 3)
    got = {r.seq: r.pos for r in positions(_frame(spark, rows), ["key"], ["at", "seq"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))):
            want[r[2]] = i + 1
    assert got == want
    first = {r.key: r.seq for r in first_per_key(_frame(spark, rows), ["key"], ["at", "seq"]).collect()}
    assert first == {k: min((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))[2] for k in {r[0] for r in rows}}


def test_asof_both_directions(spark, small_tasks):
    r = random.Random(4)
    left = [(i, "hot" if r.random() < 0.9 else "b", r.randint(0, 300)) for i in range(150)]
    right = [("hot" if r.random() < 0.9 else "b", r.randint(0, 300), i, i * 10) for i in range(150)]
    lf = spark.createDataFrame(left, "id long, key string, t long")
    rf = spark.createDataFrame(right, "key string, rt long, seq long, v long")
    for direction in ("forward", "backward"):
        for sliced in (False, True):
            got = {x.id: x.v for x in asof_join(lf, rf, keys=["key"], left_at="t", right_at="rt", right_order=["seq"], right_cols=["v"],
                                                direction=direction, sliced=sliced).collect()}
            want = {}
            for i, k, t in left:
                c = [x for x in right if x[0] == k and (x[1] >= t if direction == "forward" else x[1] <= t)]
                pick = (min if direction == "forward" else max)(c, key=lambda x: (x[1], x[2]), default=None)
                want[i] = pick[3] if pick else None
            assert got == want


def test_interval_join_is_exact(spark):
    r = random.Random(5)
    hour = 3_600_000_000
    pts = [(i, r.choice("ab"), r.randint(0, 5000 * hour)) for i in range(200)]
    ivs = []
    for i in range(150):
        a = r.randint(0, 5000 * hour)
        ivs.append((i, r.choice("ab"), a, r.choice([None, a, a + r.randint(0, 3 * hour), a + r.randint(0, 4000 * hour), a - 5])))
    p = spark.createDataFrame(pts, "pid long, key string, t long")
    v = spark.createDataFrame(ivs, "iid long, key string, s long, e long")
    got = sorted((x.pid, x.iid) for x in interval_join(p, v, keys=["key"], at="t", start="s", end="e").collect())
    want = sorted((a[0], b[0]) for a in pts for b in ivs if a[1] == b[1] and b[2] <= a[2] and (b[3] is None or a[2] <= b[3]))
    assert got == want


def test_open_intervals_have_no_last_day(spark):
    far = 4_200_000_000_000_000  # the year 2103
    points = spark.createDataFrame([("a", far), ("a", 5), ("b", far)], "k string, at long")
    intervals = spark.createDataFrame([("a", 10, None), ("a", 0, 7)], "k string, lo long, hi long")
    got = interval_join(points, intervals, keys=["k"], at="at", start="lo", end="hi").collect()
    assert sorted((r.k, r["at"], r.lo) for r in got) == [("a", 5, 0), ("a", far, 10)]
