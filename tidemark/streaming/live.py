"""Live feature stream: one snapshot per record in arrival order, state per ticker.

The cut-off follows the largest event time seen for the ticker and never moves back; a late
record is added, and dropped at once when it is older than the cut-off.  A global watermark
would drop rows by other tickers' times, so the maximum is kept in the ticker's own state.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.market import observations
from tidemark.operators.rolling import LOOKBACK_SECONDS, MEASURES

_VALUES = ["price", "size", "bid_price", "ask_price", "bid_size", "ask_size", "mid_obs", "spread_obs"]
_BUFFER = ["_t", "is_trade", "is_quote", *_VALUES]
#: Last known values of a window beside its prices and midprices: of trades their size, both sides of a quote, and columns.
LAST = ("size", "spread", "both", "bid_price", "ask_price", "bid_size", "ask_size")
NAN = math.nan
#: Rows of output that a task makes at a time.
CHUNK = 20_000


def _pack(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(data) as r:
        return r.read_pandas()


class ExactSums:
    """Sum and squares of numbers that come and go, without error: integers over a power of two that grows as needed."""

    def __init__(self) -> None:
        self.n = self.total = self.squares = self.shift = self.rising = self.falling = self.unknown = 0

    def move(self, x: float, sign: int) -> None:
        """A number comes (1) or goes (-1)."""
        self.n += sign
        if x - x != 0:
            self.rising += sign * (x > 0)
            self.falling += sign * (x < 0)
            self.unknown += sign * (x != x)
            return
        n, d = x.as_integer_ratio()
        s = d.bit_length() - 1
        if s > self.shift:
            self.total <<= s - self.shift
            self.squares <<= 2 * (s - self.shift)
            self.shift = s
        n <<= self.shift - s
        self.total += sign * n
        self.squares += sign * n * n

    def sum(self) -> float:
        if self.unknown or self.rising and self.falling:
            return NAN
        if self.rising or self.falling:
            return math.inf if self.rising else -math.inf
        return _quotient(self.total, 1 << self.shift)

    def deviation(self) -> float:
        """Population standard deviation; NaN below two numbers."""
        if self.n < 2 or self.rising or self.falling or self.unknown:
            return NAN
        return math.sqrt(_quotient(self.n * self.squares - self.total * self.total, self.n * self.n << 2 * self.shift))


def _quotient(a: int, b: int) -> float:
    try:
        return a / b
    except OverflowError:
        return math.copysign(math.inf, a)


class Chain:
    """Known values of the live rows in arrival order; any of them may leave.  ``moves`` holds the returns of neighbours."""

    def __init__(self, moves: ExactSums | None = None) -> None:
        self.head, self.tail, self.n, self.moves = None, None, 0, moves

    def _move(self, before: list, after: list, sign: int) -> None:
        if self.moves is not None and before[2] > 0:
            self.moves.move(after[2] / before[2] - 1, sign)

    def add(self, value: float) -> list:
        node = [self.tail, None, value]
        if self.tail is None:
            self.head = node
        else:
            self.tail[1] = node
            self._move(self.tail, node, 1)
        self.tail = node
        self.n += 1
        return node

    def remove(self, node: list) -> None:
        before, after, _ = node
        if before is None:
            self.head = after
        else:
            before[1] = after
            self._move(before, node, -1)
        if after is None:
            self.tail = before
        else:
            after[0] = before
            self._move(node, after, -1)
        if before is not None and after is not None:
            self._move(before, after, 1)
        node[0] = node[1] = None
        self.n -= 1

    def last(self) -> float:
        return NAN if self.tail is None else self.tail[2]

    def total_return(self) -> float:
        return self.tail[2] / self.head[2] - 1 if self.n >= 2 and self.head[2] > 0 else NAN

    def change(self) -> float:
        return self.tail[2] - self.tail[0][2] if self.n >= 2 else NAN


class Window:
    """Live rows of one key.  A record costs the logarithm of the window, not its length.

    Rows leave by their time, whatever their arrival (a heap), or as the oldest beyond the cap.  A
    column's last known value is the top of a stack of (time, number, value) on which every row
    lies over older ones of a later time; others can never be the last again.
    """

    def __init__(self, lookback: int, cap: int | None) -> None:
        self.lookback, self.cap = lookback, cap
        self.clear()

    def clear(self) -> None:
        self.newest: int | None = None
        self.heap: list[tuple] = []
        self.arrived: deque[tuple] = deque()
        self.floor = self.rows = self.trades = self.quotes = 0
        self.volume, self.prices, self.mids = ExactSums(), Chain(), Chain(ExactSums())
        self.stacks: list[list[tuple]] = [[] for _ in LAST]

    def _leave(self, row: tuple) -> None:
        _, _, trade, quote, size, price, mid = row
        self.rows -= 1
        self.trades -= trade
        self.quotes -= quote
        if size is not None:
            self.volume.move(size, -1)
        if price is not None:
            self.prices.remove(price)
        if mid is not None:
            self.mids.remove(mid)

    def add(self, i: int, t: int, trade: bool, quote: bool, price: float, size: float, bid: float, ask: float, bid_size: float,
            ask_size: float, mid: float, spread: float) -> None:
        """Row number ``i``; numbers ascend."""
        if self.newest is None or t > self.newest:
            self.newest = t
        limit = self.newest - self.lookback
        while self.heap and self.heap[0][0] < limit:
            row = heappop(self.heap)
            if row[1] >= self.floor:
                self._leave(row)
        if t >= limit:
            size = size if trade else NAN
            row = (t, i, trade, quote, size if size == size else None, self.prices.add(price) if trade and price == price else None,
                   self.mids.add(mid) if mid == mid else None)
            heappush(self.heap, row)
            self.rows += 1
            self.trades += trade
            self.quotes += quote
            if size == size:
                self.volume.move(size, 1)
            both = (bid, ask) if bid == bid and ask == ask else NAN
            for stack, value in zip(self.stacks, (size, spread, both, bid, ask, bid_size, ask_size)):
                if value == value:
                    while stack and stack[-1][0] <= t:
                        stack.pop()
                    stack.append((t, i, value))
            if self.cap:
                self.arrived.append(row)
                while self.rows > self.cap:
                    row = self.arrived.popleft()
                    if row[0] >= limit:
                        self.floor = row[1] + 1
                        self._leave(row)
        for stack in self.stacks:
            while stack and (stack[-1][0] < limit or stack[-1][1] < self.floor):
                stack.pop()

    def snapshot(self) -> tuple:
        """Feature values in the order of ``MEASURES``."""
        size, spread, both, bid, ask, bid_size, ask_size = (s[-1][2] if s else NAN for s in self.stacks)
        quote_bid, quote_ask = both if both == both else (NAN, NAN)
        prices, mids = self.prices, self.mids
        return (self.rows, self.trades, self.quotes, prices.last(), size, bid, ask, bid_size, ask_size, mids.last(), spread, quote_bid, quote_ask,
                self.volume.sum(), prices.total_return(), mids.total_return(), mids.change(), mids.moves.deviation())

    def live(self) -> list[int]:
        """Numbers of the live rows."""
        return sorted(row[1] for row in self.heap if row[1] >= self.floor)


def live_features(records: DataFrame, *, arrival: str = "ingest_seq", lookback_seconds: int = LOOKBACK_SECONDS, cap: int | None = None,
                  key: str = "ticker") -> DataFrame:
    """Streaming (or batch) records to snapshots; ``snapshot_time`` is the largest time so far.

    A boolean column ``reset`` clears the ticker's state before its row.
    """
    df = observations(records)
    if "reset" not in df.columns:
        df = df.withColumn("reset", F.lit(False))
    df = df.withColumn("_t", F.unix_micros(F.col("event_time").cast("timestamp"))).select(key, arrival, "reset", *_BUFFER)
    schema = T.StructType([df.schema[key], df.schema[arrival], T.StructField("max_time", T.LongType()),
                           *[T.StructField(c, T._parse_datatype_string(k)) for c, k in MEASURES.items()]])
    lookback = lookback_seconds * 1_000_000
    names = [f.name for f in schema]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(arrival, kind="stable", ignore_index=True)
        if state.exists:
            newest, packed = state.get
            old = _unpack(packed)
        else:
            newest, old = None, rows.iloc[0:0][_BUFFER]
        cols = {c: np.concatenate([old[c].to_numpy(), rows[c].to_numpy()]).astype(
            np.int64 if c == "_t" else bool if c.startswith("is_") else float) for c in _BUFFER}
        window, n = Window(lookback, cap), len(old)
        for i, row in enumerate(zip(*(cols[c][:n].tolist() for c in _BUFFER))):
            window.add(i, *row)
        window.newest = newest
        resets = rows["reset"].to_numpy(bool)
        for a in range(0, len(rows), CHUNK):
            part = {c: v[n + a:n + a + CHUNK] for c, v in cols.items()}
            values, times = np.empty((len(part["_t"]), len(MEASURES))), np.empty(len(part["_t"]), np.int64)
            for i, row in enumerate(zip(*(part[c].tolist() for c in _BUFFER))):
                if resets[a + i]:
                    window.clear()
                window.add(n + a + i, *row)
                values[i], times[i] = window.snapshot(), window.newest
            out = pd.DataFrame(values, columns=list(MEASURES)).astype({c: np.int64 for c, kind in MEASURES.items() if kind == "long"})
            yield out.assign(**{key: k[0], arrival: rows[arrival].iloc[a:a + CHUNK].to_numpy(), "max_time": times})[names]
        live = np.array(window.live(), np.int64)
        state.update((window.newest, _pack(pd.DataFrame({c: v[live] for c, v in cols.items()}))))

    out = df.groupBy(key).applyInPandasWithState(step, schema, "newest long, buffer binary", "append", GroupStateTimeout.NoTimeout)
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c, k in MEASURES.items() if k == "double"})
