"""Keyed state that lives in the stream's own state store: latest entries and accounts.

State is one small value per key, checkpointed by Spark with the offsets, so a restart goes on
where the last committed batch ended.  A state can begin with rows of a table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.times import micros
from tidemark.operators import state as state_ops

#: What an update did to its key.
WRITTEN, REPLACED, STALE, DUPLICATE, EXPIRED, CLEARED = "WRITTEN", "REPLACED", "IGNORED_STALE", "IGNORED_DUPLICATE", "EXPIRED", "CLEARED"
# Spark asks a processor for its state variables in a process of its own, which has no files of the application
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """``transformWithState`` needs the RocksDB store; a session that names a provider keeps it."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)


def _sorted(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


class LatestEntries(StatefulProcessor):
    """Per key the time and content of the newest entry; every update leaves with what it did.

    Within a batch updates apply in arrival order.  Nothing of a batch is looped over in Python:
    an update is stale if it is older than the running maximum, and the stored content is that of
    the last update that was not.
    """

    def __init__(self, keys: Sequence[str], columns: Sequence[str], order: Sequence[str], expires: bool):
        self.keys, self.columns, self.order, self.expires = list(keys), list(columns), list(order), expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at long, content string, until long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        newest = initialState.sort_values("state_at", kind="stable").iloc[-1]
        self._store(int(newest["state_at"]), newest["state_content"], newest["state_until"], timerValues)

    def _store(self, at: int, content: str, until, timerValues) -> None:
        until = None if until is None or pd.isna(until) else int(until)
        if self.expires:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if until is not None:
                self.handle.registerTimer(max(until // 1000, timerValues.getCurrentProcessingTimeInMs()) + 1)
        self.entry.update((at, content, until))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = _sorted(rows, self.order)
        known = self.entry.exists()
        at0, content0, _ = self.entry.get() if known else (np.iinfo(np.int64).min, None, None)
        reset = p["reset"].to_numpy(bool)
        status = np.full(len(p), CLEARED, object)
        for part in np.split(np.arange(len(p)), np.flatnonzero(reset)):  # a reset row comes first in its part
            if len(part) and reset[part[0]]:
                known, at0, content0 = False, np.iinfo(np.int64).min, None
                self.entry.clear()
                part = part[1:]
            if not len(part):
                continue
            at = p["state_at"].to_numpy(np.int64)[part]
            before = np.maximum.accumulate(np.append(at0, at))[:-1]
            fresh = np.flatnonzero(at >= before)
            content = p["state_content"].to_numpy(object)[part]
            last = np.append(np.array([content0], object), content[fresh][:-1])
            same = (at[fresh] == before[fresh]) & (content[fresh] == last)
            new = np.full(len(part), STALE, object)
            new[fresh] = np.where(same, DUPLICATE, REPLACED)
            if not known:
                new[0] = WRITTEN
            status[part] = new
            if len(fresh):
                known, at0, content0 = True, int(at[fresh[-1]]), content[fresh[-1]]
                self._store(at0, content0, p["state_until"].iloc[part[fresh[-1]]], timerValues)
        yield p.assign(update_status=status)[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            self.entry.clear()
            row = dict.fromkeys(self.columns)
            row.update(zip(self.keys, key), update_status=EXPIRED)
            yield pd.DataFrame([row], columns=self.columns)

    def close(self) -> None:
        pass


def latest_entries(updates: DataFrame, *, key: Sequence[str] = state_ops.KEY, arrival: str = "arrival_seq", updated: str = "updated_at",
                   content: Sequence[str] = ("value", "severity", "source", "valid_until"), valid_until: str | None = "valid_until",
                   expires: bool = False, start: DataFrame | None = None) -> DataFrame:
    """A stream of updates to the same rows with ``update_status``: WRITTEN, REPLACED, IGNORED_STALE, IGNORED_DUPLICATE.

    An update older than its key's entry is stale; one of the same time and content is a duplicate.
    A true ``reset`` column clears the key before later rows (status CLEARED).  With ``expires``, a
    timer on ``valid_until`` clears the entry when the clock passes it and emits EXPIRED.  ``start``
    are entries the state begins with (the same columns); they are not emitted.
    """
    use_state_store(updates.sparkSession)
    keys = list(key)

    def ready(df: DataFrame) -> DataFrame:
        if "reset" not in df.columns:
            df = df.withColumn("reset", F.lit(False))
        until = micros(valid_until) if valid_until else F.lit(None).cast("long")
        return df.withColumns({"state_at": micros(updated), "state_content": F.to_json(F.struct(*content)), "state_until": until, "reset": F.coalesce("reset", F.lit(False))})
    rows = ready(updates)
    names = [*keys, *(c for c in updates.columns if c not in keys)]
    schema = T.StructType([*(updates.schema[c] for c in names), T.StructField("update_status", T.StringType())])
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=LatestEntries(keys, schema.names, [arrival], expires), outputStructType=schema, outputMode="append",
        timeMode="processingtime" if expires else "none", initialState=None if start is None else ready(start).groupBy(*keys))


def entries_now(changes: DataFrame, *, key: Sequence[str] = state_ops.KEY, arrival: str = "arrival_seq") -> DataFrame:
    """The entry of every key after all ``changes``; a key that was cleared last has none."""
    kept = changes.where(F.col("update_status").isin(WRITTEN, REPLACED, CLEARED))
    rest = [c for c in changes.columns if c not in key]
    last = kept.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("_e")).select(*key, "_e.*")
    return last.where(F.col("update_status") != CLEARED).drop("update_status")


class Accounts(StatefulProcessor):
    """Per account the totals, the day's result and the loss streak after every fill."""

    def __init__(self, columns: Sequence[str], order: Sequence[str]):
        self.columns, self.order = list(columns), list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "total double, day long, daily double, streak long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[-1]
        self.totals.update((float(r["total_realized_pnl"]), int(r["state_day"]), float(r["daily_realized_pnl"]), int(r["consecutive_losses"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = _sorted(rows, self.order)
        total0, day0, daily0, streak0 = self.totals.get() if self.totals.exists() else (0.0, None, 0.0, 0)
        pnl, day = p["realized_pnl_delta"].to_numpy(float), p["state_day"].to_numpy(np.int64)
        n = np.arange(len(p))
        total = total0 + np.cumsum(pnl)
        # a day's sum begins anew where the day changes, and goes on from the state on its day
        opens = np.append(day0 is None or day[0] != day0, day[1:] != day[:-1])
        opened = np.maximum.accumulate(np.where(opens, n, -1))
        daily = total - np.where(opened >= 0, np.append(total0, total[:-1])[opened], total0 - daily0)
        losses = np.cumsum(pnl < 0)
        wins = np.maximum.accumulate(np.where(pnl > 0, n, -1))
        streak = losses - np.where(wins >= 0, losses[wins], -streak0)
        self.totals.update((float(total[-1]), int(day[-1]), float(daily[-1]), int(streak[-1])))
        yield p.assign(total_realized_pnl=total, daily_realized_pnl=daily, daily_loss_dollars=np.maximum(0.0, -daily),
                       consecutive_losses=streak.astype(np.int64))[self.columns]

    def close(self) -> None:
        pass


def account_stream(fills: DataFrame, *, account: Sequence[str], order: Sequence[str], session_day, start: DataFrame | None = None) -> DataFrame:
    """Fills with ``realized_pnl_delta`` (after :func:`position_stream`) to the account's state after each.

    Within a batch fills apply in ``order``, batches as they come.  A break-even fill leaves the
    streak; a new session day begins with nothing.  ``start``: account, ``state_day`` (epoch day) and the
    state columns of a table to go on from.
    """
    use_state_store(fills.sparkSession)
    keys = list(account)
    names = [*keys, *(c for c in fills.columns if c not in keys)]
    schema = T.StructType([*(fills.schema[c] for c in names), *(T.StructField(c, T.DoubleType()) for c in (
        "total_realized_pnl", "daily_realized_pnl", "daily_loss_dollars")), T.StructField("consecutive_losses", T.LongType())])
    rows = fills.withColumn("state_day", F.unix_date(session_day).cast("long"))
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Accounts(schema.names, order), outputStructType=schema, outputMode="append", timeMode="none",
        initialState=None if start is None else start.groupBy(*keys))
