"""Tie-exact rolling frames per ticker.

The frame of a row ends at the row itself (later rows with the same time are outside),
starts at the first row not older than the look-back, and holds all rows from there (at
most the newest ``cap`` rows if the caller gives a cap).
Spark's RANGE frame includes later peers and re-reads the whole frame for every row, so
the per-frame values come from prefix arrays in an Arrow-fed task: O(n log n) per task
however dense the data.

Work is cut by position, not by time: block ``b`` of a ticker is its rows
``b*size+1 .. (b+1)*size`` plus the rows before that a frame may reach, so a task holds a
block and one frame even when one ticker has most of the table.  How far a frame may reach
is measured: no more than twice the rows of the fullest stretch of one look-back.  When
every ticker fits a task no positions are needed and whole tickers are bundled by hash.
Whole tickers that do not fit (asked for with ``sliced=False``) are sorted by Spark and pass
through a task piece by piece, each piece with the frame before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.market import observations, spread_bps
from tidemark.operators.ordered import SLICE, OrderedScan, bundles_for, key_sizes, positions, python_rows
from tidemark.session import stable

LOOKBACK_SECONDS = 60


# --- numpy helpers on rows sorted by (code, time, tie) -------------------------------------

def frame_starts(code: np.ndarray, t: np.ndarray, lookback: int, cap: int | None) -> np.ndarray:
    """Index of the first row of every row's frame."""
    uniq, rank = np.unique(t, return_inverse=True)
    width = len(uniq) + 1
    lo = np.searchsorted(code * width + rank, code * width + np.searchsorted(uniq, t - lookback))
    return lo if cap is None else np.maximum(lo, np.arange(len(t)) - cap + 1)


def last_at(valid: np.ndarray) -> np.ndarray:
    """Index of the last valid row at or before each row (-1: none)."""
    return np.maximum.accumulate(np.where(valid, np.arange(len(valid)), -1))


def first_from(valid: np.ndarray) -> np.ndarray:
    """Index of the first valid row at or after each row (n: none)."""
    n = len(valid)
    return np.minimum.accumulate(np.where(valid, np.arange(n), n)[::-1])[::-1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading zero; extended precision keeps differences exact enough."""
    return np.concatenate([[0], np.cumsum(values.astype(np.longdouble))])


def take(values: np.ndarray, index: np.ndarray, ok: np.ndarray) -> np.ndarray:
    return np.where(ok, values[np.clip(index, 0, len(values) - 1)], np.nan)


def deviations(returns: np.ndarray, has: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Population standard deviation of the returns with row index in (first, last]; NaN below two."""
    where = np.flatnonzero(has)
    r = returns[where]
    a = np.searchsorted(where, first, side="right")
    b = np.searchsorted(where, last, side="right")
    n = np.maximum(b - a, 0)
    s1, s2 = prefix(r), prefix(r * r)
    mean = (s1[b] - s1[a]) / np.maximum(n, 1)
    var = (s2[b] - s2[a]) / np.maximum(n, 1) - mean * mean
    small = np.flatnonzero((n >= 2) & (n <= 48))      # short frames: two exact passes
    if len(small):
        m = (n[small]).astype(float)
        mu, ss = np.zeros(len(small)), np.zeros(len(small))
        for phase in (0, 1):
            for k in range(int(n[small].max())):
                live = k < n[small]
                x = r[np.minimum(a[small] + k, len(r) - 1)]
                if phase == 0:
                    mu += np.where(live, x, 0.0)
                else:
                    ss += np.where(live, (x - mu) ** 2, 0.0)
            if phase == 0:
                mu = mu / m
        var[small] = ss / m
    return np.where(n >= 2, np.sqrt(np.maximum(var, 0)).astype(float), np.nan)


# --- bundling -----------------------------------------------------------------------------

def frame_bound(df: DataFrame, keys: Sequence[str], at: str, lookback: int) -> int:
    """No frame has more rows: two neighbouring stretches of one look-back cover it."""
    stretch = df.groupBy(*keys, F.floor(F.col(at) / F.lit(lookback)).alias("_stretch")).count()
    return 2 * int(stretch.agg(F.max("count")).first()[0] or 1)


def in_pieces(keys: Sequence[str], at: str, lookback: int, cap: int | None, kernel: Callable[[pd.DataFrame], pd.DataFrame],
              names: Sequence[str], rows: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Runs ``kernel`` over sorted rows of whole keys; held are a piece of ``rows`` rows and the frame that later rows may reach."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting, count = None, [], 0

        def piece() -> pd.DataFrame:
            nonlocal held, waiting, count
            before = 0 if held is None else len(held)
            p = pd.concat(waiting if held is None else [held, *waiting], ignore_index=True)
            waiting, count = [], 0
            p["_code"] = code = p.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy(np.int64)
            t = p[at].to_numpy(np.int64)
            reach = np.flatnonzero((code == code[-1]) & (t >= t[-1] - lookback))
            held = p.iloc[reach[0] if cap is None else max(reach[0], len(p) - cap):].drop(columns="_code")
            return kernel(p).iloc[before:][names]

        for b in batches:
            if len(b):
                waiting.append(b)
                count += len(b)
            if count >= max(rows, 0 if held is None else len(held)):
                yield piece()
        if count:
            yield piece()

    return run


def over_frames(df: DataFrame, keys: Sequence[str], order: Sequence[str], lookback: int, cap: int | None,
                kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType,
                *, sliced: bool | None = None) -> DataFrame:
    """Run ``kernel`` over bounded bundles; ``_own`` marks the rows it must return.

    The kernel gets rows sorted by (key code ``_code``, order) with the look-back rows of
    each block included, and returns one row per own row.
    """
    spark = df.sparkSession
    limit = python_rows(spark)
    largest, total = key_sizes(df, keys)
    if sliced is None:
        sliced = largest > limit
    bundles = bundles_for(df, total)
    if not sliced and largest > limit:
        rows = df.repartition(bundles, *keys).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in (*keys, *order)])
        return rows.mapInPandas(in_pieces(keys, order[0], lookback, cap, kernel, [f.name for f in schema], max(1, limit // 4)), schema)
    if sliced:
        bound = frame_bound(df, keys, order[0], lookback)
        cap = bound if cap is None else min(cap, bound)
        size = max(cap, limit)
        df = positions(df, keys, order, "_pos", sliced=True)
        block = F.floor((F.col("_pos") - 1) / F.lit(size)).cast("long")
        tail = F.col("_pos") - block * size > size - cap + 1
        df = df.withColumn("_block", F.explode(F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))))
        df = df.withColumn("_own", F.col("_block") == block)
        group = [*keys, "_block"]
        bundles *= 4                    # blocks are near the limit already: seldom two of them in a bundle
    else:
        df = df.withColumn("_own", F.lit(True))
        group = list(keys)
    df = df.withColumn("_bundle", F.pmod(F.xxhash64(*group), F.lit(bundles)))
    part = [c for c in ("_block",) if sliced]
    names = [f.name for f in schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, *part, *order], kind="stable", ignore_index=True)
        pdf["_code"] = pdf.groupby([*keys, *part], sort=False, dropna=False).ngroup().to_numpy(np.int64)
        out = kernel(pdf)
        return out.loc[pdf["_own"].to_numpy(bool), names]

    return df.groupBy("_bundle").applyInPandas(run, schema)


# --- the feature frame --------------------------------------------------------------------

MEASURES = {
    "record_count_window": "long", "trade_count_window": "long", "quote_count_window": "long",
    "last_trade_price": "double", "last_trade_size": "double", "last_bid_price": "double", "last_ask_price": "double",
    "last_bid_size": "double", "last_ask_size": "double", "midprice": "double", "spread": "double",
    "quote_bid": "double", "quote_ask": "double", "volume_window": "double", "price_return_window": "double",
    "midprice_return_window": "double", "midprice_change_from_previous": "double", "simple_volatility_window": "double",
}


def feature_kernel(lookback: int, cap: int | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        n = len(p)
        i = np.arange(n)
        code = p["_code"].to_numpy(np.int64)
        lo = frame_starts(code, p["_t"].to_numpy(np.int64), lookback, cap)
        f = {c: p[c].to_numpy(float) for c in
             ("price", "size", "bid_price", "ask_price", "bid_size", "ask_size", "mid_obs", "spread_obs")}
        trade, quote = p["is_trade"].to_numpy(bool), p["is_quote"].to_numpy(bool)
        out = {"record_count_window": i - lo + 1}

        def count(mask):
            c = np.concatenate([[0], np.cumsum(mask)])
            return c[i + 1] - c[lo]

        def latest(values, mask=None):
            valid = ~np.isnan(values) if mask is None else ~np.isnan(values) & mask
            at = last_at(valid)
            return take(values, at, at >= lo)

        out["trade_count_window"], out["quote_count_window"] = count(trade), count(quote)
        out["last_trade_price"], out["last_trade_size"] = latest(f["price"], trade), latest(f["size"], trade)
        for c in ("bid_price", "ask_price", "bid_size", "ask_size"):
            out[f"last_{c}"] = latest(f[c])
        out["midprice"], out["spread"] = latest(f["mid_obs"]), latest(f["spread_obs"])
        both = ~np.isnan(f["bid_price"]) & ~np.isnan(f["ask_price"])
        out["quote_bid"], out["quote_ask"] = latest(f["bid_price"], both), latest(f["ask_price"], both)
        sizes = prefix(np.where(trade & ~np.isnan(f["size"]), f["size"], 0.0))
        out["volume_window"] = (sizes[i + 1] - sizes[lo]).astype(float)

        def total_return(values, valid):
            at, start = last_at(valid), first_from(valid)[lo]
            ok = (at >= lo) & (start < at)
            first = take(values, start, ok)
            ok &= first > 0
            return np.where(ok, take(values, at, ok) / np.where(ok, first, 1.0) - 1, np.nan)

        out["price_return_window"] = total_return(f["price"], trade & ~np.isnan(f["price"]))
        mid, has_mid = f["mid_obs"], ~np.isnan(f["mid_obs"])
        out["midprice_return_window"] = total_return(mid, has_mid)
        at = last_at(has_mid)
        before = np.concatenate([[-1], at[:-1]])                 # last mid strictly before each row
        prev = np.where(at >= 0, before[np.clip(at, 0, n - 1)], -1)
        ok = (at >= lo) & (prev >= lo)
        out["midprice_change_from_previous"] = take(mid, at, ok) - take(mid, prev, ok)
        step = has_mid & (before >= 0) & (code[np.clip(before, 0, n - 1)] == code)
        base = take(mid, before, step)
        step &= base > 0
        returns = np.where(step, mid / np.where(step, base, 1.0) - 1, 0.0)
        out["simple_volatility_window"] = deviations(returns, step, first_from(has_mid)[lo], i)
        return p.assign(**out)

    return kernel


def rolling_features(records: DataFrame, *, lookback_seconds: int = LOOKBACK_SECONDS, cap: int | None = None,
                     order: Sequence[str] = ("ingest_seq",), key: str = "ticker", keep: Sequence[str] = (),
                     sliced: bool | None = None) -> DataFrame:
    """One feature row per market record, in event-time order (ties by ``order``).

    Output: key, event_time, the order columns, ``keep`` columns and the feature values.
    """
    if lookback_seconds <= 0 or (cap is not None and cap <= 0):
        raise ValueError("look-back and cap must be positive")
    df = observations(records).withColumn("_t", F.unix_micros(F.col("event_time").cast("timestamp")))
    carried = [key, "_t", *order, *keep]
    df = df.select(*carried, "price", "size", "bid_price", "ask_price", "bid_size", "ask_size",
                   "mid_obs", "spread_obs", "is_trade", "is_quote")
    schema = T.StructType([df.schema[c] for c in carried]
                          + [T.StructField(c, T._parse_datatype_string(k)) for c, k in MEASURES.items()])
    lookback = lookback_seconds * 1_000_000
    out = over_frames(df, [key], ["_t", *order], lookback, cap, feature_kernel(lookback, cap), schema, sliced=sliced)
    # Arrow carries the kernel's NaN for "no value"
    doubles = [c for c, k in MEASURES.items() if k == "double"]
    out = out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})
    return out.select(
        key, F.timestamp_micros("_t").alias("event_time"), *order, *keep,
        "record_count_window", "trade_count_window", "quote_count_window",
        F.coalesce("last_trade_price", "midprice").alias("last_price"),
        "last_trade_price", "last_trade_size", "last_bid_price", "last_ask_price", "last_bid_size", "last_ask_size",
        "midprice", "spread", spread_bps(F.col("spread"), F.col("midprice")).alias("spread_bps"),
        F.coalesce(F.col("quote_bid") >= F.col("quote_ask"), F.lit(False)).alias("is_crossed_or_locked"),
        F.lit(lookback_seconds).alias("lookback_window_seconds"), "volume_window", "price_return_window",
        "midprice_return_window", "midprice_change_from_previous", "simple_volatility_window")


def final_snapshot(features: DataFrame, *, order: Sequence[str] = ("ingest_seq",), key: str = "ticker") -> DataFrame:
    """Last feature row per ticker (the snapshot after all records)."""
    rest = [c for c in features.columns if c != key]
    return (features.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("event_time", *order)).alias("_r"))
            .select(key, "_r.*"))


def frame_totals(df: DataFrame, *, key: str, at: str, order: Sequence[str], value: str, lookback: int,
                 cap: int | None = None, sliced: bool | None = None) -> DataFrame:
    """Tie-exact trailing count and sum for any ordered table: adds ``frame_rows``, ``frame_sum``.

    ``at`` is a long and ``lookback`` is in its unit.  A key that is too large for a task is cut into
    slices; the rows of a frame that lie in earlier slices meet the slice as totals by instant, so a
    task holds its slice and one row per earlier instant in reach, however many rows a frame has.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("frame_rows", T.LongType()),
                           T.StructField("frame_sum", T.DoubleType())])
    largest, total = (0, 0) if cap is not None or sliced is False else key_sizes(df, [key])
    if cap is not None or sliced is False or (sliced is None and largest <= python_rows(df.sparkSession)):
        def kernel(p: pd.DataFrame) -> pd.DataFrame:
            lo = frame_starts(p["_code"].to_numpy(np.int64), p[at].to_numpy(np.int64), lookback, cap)
            i, s = np.arange(len(p)), prefix(np.nan_to_num(p[value].to_numpy(float)))
            return p.assign(frame_rows=i - lo + 1, frame_sum=(s[i + 1] - s[lo]).astype(float))

        return over_frames(df, [key], [at, *order], lookback, cap, kernel, schema, sliced=sliced)

    rows = OrderedScan(df, [key], [at, *order], sliced=True, total=total, rows=python_rows(df.sparkSession)).df
    amount = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    totals = rows.groupBy(key, SLICE, at).agg(F.count(F.lit(1)).alias("_rows"), F.sum(amount).alias("_sum"))
    spans = stable(rows.groupBy(key, SLICE).agg(F.min(at).alias("_first"), F.max(at).alias("_last")), "spans")
    source = spans.select(F.col(key).alias("_key"), F.col(SLICE).alias("_from"), "_last")
    target = spans.select(key, SLICE, "_first")
    reach = target.join(source, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_from") < F.col(SLICE)) & (F.col("_last") >= F.col("_first") - lookback))
    reach = reach.select("_key", "_from", F.col(SLICE).alias("_to"), (F.col("_first") - lookback).alias("_low"))
    earlier = totals.join(F.broadcast(reach), F.col(key).eqNullSafe(F.col("_key")) & (F.col(SLICE) == F.col("_from")) & (F.col(at) >= F.col("_low")))
    earlier = earlier.select(key, F.col("_to").alias(SLICE), at, "_rows", "_sum", F.lit(False).alias("_own"))
    own = rows.withColumns({"_rows": F.lit(1).cast("long"), "_sum": amount, "_own": F.lit(True)})
    names = schema.names

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([key, "_own", at, *order], kind="stable", ignore_index=True)
        code = p.groupby(key, sort=False, dropna=False).ngroup().to_numpy(np.int64)
        lo = frame_starts(code, p[at].to_numpy(np.int64), lookback, None)
        i, s = np.arange(len(p)), prefix(p["_sum"].to_numpy())
        n = np.concatenate([[0], np.cumsum(p["_rows"].to_numpy(np.int64))])
        p = p.assign(frame_rows=n[i + 1] - n[lo], frame_sum=(s[i + 1] - s[lo]).astype(float))
        return p.loc[p["_own"].to_numpy(bool), names]

    return own.unionByName(earlier, allowMissingColumns=True).groupBy(SLICE).applyInPandas(run, schema)
