"""Rate observations: valid latest and previous, level, change, spread and regime facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import decimal_text, decimal_value, stable_id
from tidemark.functions.times import end_of_local_day, strict_date
from tidemark.operators.ordered import first_per_key
from tidemark.session import stable


def valid_observations(raw: DataFrame, *, evaluation_date: Column, order: Sequence[str] = ("row_seq",)) -> DataFrame:
    """(series, observation_date, value): the first parsable row per date, none after the evaluation date.

    ``raw``: series, date, value as text, and the order columns.
    """
    parsed = raw.withColumns({"observation_date": strict_date("date"), "value": decimal_value("value")})
    good = parsed.filter(F.col("observation_date").isNotNull() & F.col("value").isNotNull()
                         & (F.col("observation_date") <= evaluation_date))
    return first_per_key(good.select("series", "observation_date", "value", *order), ["series", "observation_date"],
                         list(order)).drop(*order)


def latest_two(observations: DataFrame) -> DataFrame:
    """Per series the two newest observations, by a bounded map-side-combined aggregate."""
    pair = F.struct("observation_date", "value")
    last = observations.groupBy("series").agg(F.max(pair).alias("latest"))
    older = observations.join(last, "series").filter(F.col("observation_date") < F.col("latest.observation_date"))
    prev = older.groupBy("series").agg(F.max(pair).alias("previous"))
    return last.join(prev, "series", "left")


def is_current(observation_date: Column, evaluation_date: Column, max_age_days: int) -> Column:
    return evaluation_date.between(observation_date, F.date_add(observation_date, max_age_days))


def facts(pairs: DataFrame, *, evaluation_date: Column, max_age_days: int, spreads: Mapping[str, tuple[str, str]],
          regime: tuple[str, str, str] | None = None, stale_series: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(facts, issues) from :func:`latest_two` rows.

    ``spreads``: name -> (minuend, subtrahend); ``regime``: (short, mid, long).  Derived facts
    need equal dates of their parts and no part rejected as stale.
    """
    pairs = stable(pairs, "rates")                          # one row per series, read by every fact and issue
    current = pairs.filter(is_current(F.col("latest.observation_date"), evaluation_date, max_age_days)).select(
        "series", F.col("latest.observation_date").alias("d"), F.col("latest.value").alias("v"),
        F.col("previous.observation_date").alias("pd"), F.col("previous.value").alias("pv"))
    raw = current.filter(~F.col("series").isin(*stale_series)) if stale_series else current
    level = raw.select(F.col("series").alias("indicator"), F.lit("yield_level").alias("value_kind"),
                       F.col("d").alias("observation_date"), F.col("v").cast("decimal(38,18)").alias("value"),
                       F.lit(None).cast("string").alias("label"), F.array("series").alias("components"))
    change = raw.filter(F.col("pv").isNotNull()).select(
        F.concat("series", F.lit("_change")).alias("indicator"), F.lit("yield_change").alias("value_kind"),
        F.col("d").alias("observation_date"), (F.col("v") - F.col("pv")).cast("decimal(38,18)").alias("value"),
        F.lit(None).cast("string").alias("label"), F.array("series").alias("components"))
    # one row holding every configured series: configuration-sized, so a single map is safe
    wanted = sorted({s for p in spreads.values() for s in p} | set(regime or ()))
    board = current.filter(F.col("series").isin(*wanted)).agg(
        F.map_from_entries(F.collect_list(F.struct("series", F.struct("d", "v")))).alias("m"))

    def part(s, f):
        return F.try_element_at("m", F.lit(s))[f]

    derived, problems = [], []
    jobs = [(n, "yield_spread", p) for n, p in spreads.items()] + ([("rate_curve_regime_v1", "categorical_regime", regime)] if regime else [])
    for name, kind, parts in jobs:
        dates = [part(s, "d") for s in parts]
        present = F.lit(True)
        for d in dates:
            present = present & d.isNotNull()
        aligned = F.lit(True)
        for d in dates[1:]:
            aligned = aligned & (d == dates[0])
        rows = board.filter(present)
        if kind == "yield_spread":
            value = (part(parts[0], "v") - part(parts[1], "v")).cast("decimal(38,18)")
            label = F.lit(None).cast("string")
        else:
            front, long = part(parts[1], "v") - part(parts[0], "v"), part(parts[2], "v") - part(parts[1], "v")
            value = F.lit(None).cast("decimal(38,18)")
            label = F.concat(F.when(front < 0, "FRONT_INVERTED").otherwise("FRONT_POSITIVE"), F.lit("__"),
                             F.when(long < 0, "LONG_INVERTED").otherwise("LONG_POSITIVE"))
        fact = rows.filter(aligned).select(F.lit(name).alias("indicator"), F.lit(kind).alias("value_kind"), dates[0].alias("observation_date"),
                                           value.alias("value"), label.alias("label"), F.array(*[F.lit(s) for s in parts]).alias("components"))
        if set(parts) & set(stale_series):
            problems.append(fact.select(F.lit("DERIVATION_SUPPRESSED_STALE_COMPONENT").alias("issue_type"), "indicator"))
        else:
            derived.append(fact)
        problems.append(rows.filter(~aligned).select(F.lit("DATE_MISALIGNED").alias("issue_type"), F.lit(name).alias("indicator")))
    out, issue = level.unionByName(change), pairs.filter(
        ~is_current(F.col("latest.observation_date"), evaluation_date, max_age_days)).select(
        F.lit("STALE_SERIES").alias("issue_type"), F.col("series").alias("indicator"))
    for d in derived:
        out = out.unionByName(d)
    for p in problems:
        issue = issue.unionByName(p)
    out = out.withColumns({
        "source_event_time": F.col("observation_date").cast("timestamp"),
        "valid_until": end_of_local_day(F.date_add("observation_date", max_age_days)),
        "indicator_id": stable_id("context_indicator", F.lit("fred_rates_v1"), F.col("indicator"),
                                  F.col("observation_date"), F.coalesce(decimal_text("value"), F.col("label"))),
        "source_record_id": F.concat(F.lit("fred_rates_v1:"), F.sha2(F.concat_ws("|", F.col("indicator"), F.array_join("components", ","),
                                                                               F.col("observation_date").cast("string")), 256))})
    return out, issue
