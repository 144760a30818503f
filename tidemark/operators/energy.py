"""Weekly energy releases: event windows, exact prior-week changes, release lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import finite, stable_id
from tidemark.functions.times import MINUTE, micros, strict_date
from tidemark.operators.asof import asof_join
from tidemark.operators.intervals import interval_join
from tidemark.session import stable


def windows(releases: DataFrame, *, pre_minutes: int, post_minutes: int) -> DataFrame:
    """Adds window_start and window_end (micros) around release_at."""
    at = micros("release_at")
    return releases.withColumns({"window_start": at - F.lit(pre_minutes * MINUTE), "window_end": at + F.lit(post_minutes * MINUTE)})


SALTS = 64


def release_flags(probes: DataFrame, releases: DataFrame, tickers: DataFrame, *, at: str = "evaluation_time") -> DataFrame:
    """Flag rows for every probe inside a release window (inclusive) and every listed ticker.

    Every hit meets every ticker by definition; a salt as the equality key keeps that an
    ordinary join of any size (tickers are copied once per salt, hits are spread over them).
    """
    rel = releases.select(F.lit(1).alias("_k"), "release_id", "release_at", "window_start", "window_end")
    hit = interval_join(probes.withColumns({"_k": F.lit(1), "_at": micros(at)}), rel, keys=["_k"], at="_at",
                        start="window_start", end="window_end").drop("_k")
    hit = hit.withColumn("_salt", F.pmod(F.xxhash64("_at", "release_id", *probes.columns), F.lit(SALTS)))
    listed = tickers.select("ticker").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = hit.join(listed, "_salt").drop("_salt", "_at")
    return out.withColumns({
        "flag_type": F.lit("eia_wpsr_event_window"), "severity": F.lit("NORMAL"), "sector": F.lit("OIL"), "source": F.lit("eia_wpsr_v1"),
        "event_time": F.timestamp_micros("window_start"), "valid_until": F.timestamp_micros("window_end"), "available_at": F.col("release_at"),
        "context_flag_id": stable_id("context_flag", F.lit("eia_wpsr_v1"), F.col("release_id"), F.col("release_at"),
                                     F.col("window_start"), F.col("window_end"), F.col("ticker"))})


def select_periods(records: DataFrame, *, facets: Sequence[str] = ()) -> DataFrame:
    """(series, period, value, ambiguous): one row per series and period.

    Usable rows have a finite value and the expected units; more than one distinct
    (value text, facets) makes the period ambiguous.
    """
    parsed = records.withColumns({"period": strict_date("period"), "_value": finite(F.col("value").try_cast("double"))})
    good = parsed.filter(F.col("period").isNotNull() & F.col("_value").isNotNull() & (F.col("units") == F.col("expected_units")))
    identity = F.struct(F.col("value").alias("v"), *facets)
    return good.groupBy("series", "period").agg(
        F.min("_value").alias("_v"), (F.min(identity) != F.max(identity)).alias("ambiguous")).select(
        "series", "period", F.when(~F.col("ambiguous"), F.col("_v")).alias("value"), "ambiguous")


def weekly_facts(periods: DataFrame, *, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, issues): level, and change against exactly seven days before.

    With ``at`` only that report period is read; otherwise every period gives its facts.
    """
    periods = stable(periods, "periods")                    # read by the facts, the self join and the issues
    now = periods if at is None else periods.filter(F.col("period") == at)
    prior = periods.filter(~F.col("ambiguous")).select("series", F.date_add("period", 7).alias("period"), F.col("value").alias("prior_value"))
    both = now.filter(~F.col("ambiguous")).join(prior, ["series", "period"], "left")
    level = both.select("series", "period", F.lit("level").alias("kind"), "value")
    change = both.filter(F.col("prior_value").isNotNull()).select(
        "series", "period", F.lit("change_wow").alias("kind"), (F.col("value") - F.col("prior_value")).alias("value"))
    bad = now.filter("ambiguous").select("series", "period", F.lit("CURRENT_PERIOD_INVALID").alias("issue_type"))
    gap = both.filter(F.col("prior_value").isNull()).select("series", "period", F.lit("EXPECTED_PRIOR_PERIOD_MISSING").alias("issue_type"))
    return level.unionByName(change), bad.unionByName(gap)


def target_release(probes: DataFrame, releases: DataFrame, *, at: str = "evaluation_time", by: str = "window_start",
                   sliced: bool | None = None) -> DataFrame:
    """Adds release_id of the last release with ``by`` (micros) at or before the probe, else the first one."""
    rel = releases.select(F.lit(1).alias("_k"), F.col(by).alias("_start"), "release_id")
    first = rel.agg(F.min_by("release_id", "_start").alias("_first"))
    hit = asof_join(probes.withColumns({"_k": F.lit(1), "_at": micros(at)}), rel, keys=["_k"], left_at="_at", right_at="_start",
                    right_cols=["release_id"], direction="backward", sliced=sliced)
    return hit.join(F.broadcast(first)).withColumn("release_id", F.coalesce("release_id", "_first")).drop("_k", "_at", "_first")


def release_order_problems(releases: DataFrame) -> DataFrame:
    """(problem, key): repeated ids, times, periods, and periods not rising with release times."""
    def repeats(c):
        return releases.groupBy(F.col(c).cast("string").alias("key")).count().filter("count > 1").select(
            F.lit(f"duplicate_{c}").alias("problem"), "key")

    from tidemark.operators.ordered import Running, running
    seen = running(releases.withColumns({"_k": F.lit(1), "_t": micros("release_at")}), ["_k"], ["_t", "release_id"],
                   Running("_max", "max", F.col("report_period"), inclusive=False))
    out = seen.filter(F.col("report_period") <= F.col("_max")).select(F.lit("period_not_increasing").alias("problem"),
                                                                      F.col("release_id").cast("string").alias("key"))
    for c in ("release_id", "release_at", "report_period"):
        out = out.unionByName(repeats(c))
    return out


def next_transitions(windows_df: DataFrame, now: Column) -> DataFrame:
    """Next instant (micros) at which a window opens or has just closed."""
    t = micros(now)
    edges = windows_df.select(F.explode(F.array("window_start", F.col("window_end") + 1)).alias("edge"))
    return edges.filter(F.col("edge") > t).agg(F.min("edge").alias("next_transition"))


def transitions(probes: DataFrame, windows_df: DataFrame, *, at: str = "evaluation_time", end: str = "window_end") -> DataFrame:
    """Adds next_transition (micros) to every probe: the first opening or first instant after a closing later than ``at``.

    Openings and closings are one set of instants; the successor of each probe in it is a backward
    scan over slices, so neither the windows nor the probes are one task's.
    """
    edges = windows_df.select(F.lit(1).alias("_k"), F.explode(F.array("window_start", F.col(end) + 1)).alias("_edge")).filter("_edge is not null").distinct()
    later = probes.withColumns({"_k": F.lit(1), "_after": micros(at) + 1})
    out = asof_join(later, edges, keys=["_k"], left_at="_after", right_at="_edge", right_cols=["_edge"], direction="forward", sliced=True)
    return out.withColumnRenamed("_edge", "next_transition").drop("_k", "_after")
