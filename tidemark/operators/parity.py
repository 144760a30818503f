"""Comparison of two feature outputs, and the event-time order precondition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import Running, running


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str],
                tolerance: float = 1e-12) -> DataFrame:
    """Rows (keys, column, left_value, right_value) that differ; missing rows and NaN count."""
    missing = [c for c in (*keys, *columns) if c not in left.columns or c not in right.columns]
    if missing:
        raise ValueError(f"columns on one side only: {missing}")
    numeric = {f.name for f in left.schema if f.dataType.typeName() in ("double", "float", "long", "integer")}
    l = left.select(*keys, F.lit(True).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    r = right.select(*keys, F.lit(True).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    both = l.join(r, list(keys), "full_outer")
    cells = []
    for c in columns:
        a, b = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        same = a.eqNullSafe(b)
        if c in numeric:
            x, y = a.cast("double"), b.cast("double")
            scale = F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
            same = (a.isNull() & b.isNull()) | F.coalesce(
                ~F.isnan(x) & ~F.isnan(y) & (F.abs(x - y) <= F.lit(tolerance) * scale), F.lit(False))
        bad = ~same | F.col("_l").isNull() | F.col("_r").isNull()
        cells.append(F.when(bad, F.struct(F.lit(c).alias("column"), a.cast("string").alias("left_value"),
                                          b.cast("string").alias("right_value"))))
    return both.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("_d")).select(*keys, "_d.*")


def out_of_order(df: DataFrame, *, key: str, at: str, order: Sequence[str]) -> DataFrame:
    """Rows whose time is earlier than that of a row before them."""
    seen = running(df, [key], order, Running("_max", "max", F.col(at), inclusive=False))
    return seen.filter(F.col(at) < F.col("_max")).drop("_max")


def report(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Per key of either side: compared, differing (columns) and names (the differing ones, sorted); NaN never agrees."""
    bad = differences(left, right, keys, columns, tolerance).groupBy(*keys).agg(F.array_sort(F.collect_list("column")).alias("names"))
    every = left.select(*keys).unionByName(right.select(*keys)).distinct()
    none = F.array().cast("array<string>")
    return (every.join(bad, list(keys), "left").withColumn("names", F.coalesce("names", none))
            .select(*keys, F.lit(len(columns)).cast("long").alias("compared"), F.size("names").cast("long").alias("differing"), "names"))


def known_names(columns: Sequence[str]) -> Column:
    """Names of the columns that have a value in the row, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])))


def name_sets(df: DataFrame, expected: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Sets of known names against the expected one: group, missing, unexpected, rows.

    Every set is an array in order, so rows with equal sets meet map-side as one.
    """
    want = F.array_sort(F.array(*map(F.lit, expected)))
    rest = [c for c in df.columns if c not in group]
    sets = df.groupBy(*group, known_names(rest).alias("_names")).agg(F.count(F.lit(1)).alias("rows"))
    return sets.select(*group, F.array_except(want, "_names").alias("missing"), F.array_except("_names", want).alias("unexpected"), "rows")
