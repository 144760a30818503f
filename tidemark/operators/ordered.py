"""Running aggregates over an ordered key, safe when one key holds most of the rows.

A window partitioned by a hot key runs in one task.  ``OrderedScan`` measures the keys
first (one map-side-combined count).  When every key fits a task it is a plain window.
Otherwise the rows are range-partitioned by (key, order), each slice computes its local
running value, one total per (key, slice) is carried forward, and the two are merged.
The result is the same; no task sees more than a slice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import max_rows, stable

SLICE = "_slice"


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` in count, sum, min, max, last, first (NULLs ignored)."""

    name: str
    how: str
    col: Column | str
    inclusive: bool = True

    @property
    def column(self) -> Column:
        return F.col(self.col) if isinstance(self.col, str) else self.col


def key_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(largest key, total) row counts."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max("n"), F.sum("n")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _aggregate(how: str, c: Column) -> Column:
    return {
        "count": lambda: F.count(c),
        "sum": lambda: F.sum(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "last": lambda: F.last(c, ignorenulls=True),
        "first": lambda: F.first(c, ignorenulls=True),
    }[how]()


def _total(how: str, c: Column, order: Column, reverse: bool) -> Column:
    if how in ("last", "first"):
        pick = F.max_by if (how == "last") != reverse else F.min_by
        return pick(c, F.when(c.isNotNull(), order))
    return _aggregate(how, c)


def _merge(how: str, carry: Column, local: Column) -> Column:
    if how == "count":
        return F.coalesce(carry, F.lit(0)) + local
    if how == "sum":
        return F.coalesce(carry + local, carry, local)
    if how == "min":
        return F.least(carry, local)
    if how == "max":
        return F.greatest(carry, local)
    return F.coalesce(local, carry) if how == "last" else F.coalesce(carry, local)


class OrderedScan:
    """Rows ordered by ``order`` within ``keys``; the order must be total within a key."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], *, sliced: bool | None = None,
                 total: int | None = None, rows: int | None = None):
        self.keys, self.order = list(keys), list(order)
        self.spark = df.sparkSession
        limit = max_rows(self.spark) if rows is None else rows
        if sliced is None:
            largest, total = key_sizes(df, self.keys)
            sliced = largest > limit
        elif sliced and total is None:
            total = df.count()
        self.sliced = sliced
        if sliced:
            slices = max(2, math.ceil(total / max(1, limit // 2)))
            df = stable(
                df.repartitionByRange(slices, *self.keys, *self.order).withColumn(SLICE, F.spark_partition_id()),
                "slices")
        self.df = df

    def _with(self, df: DataFrame) -> "OrderedScan":
        other = object.__new__(OrderedScan)
        other.__dict__.update(self.__dict__, df=df)
        return other

    def transform(self, fn) -> "OrderedScan":
        """Row-local change (select, withColumn, filter); keeps keys and order columns."""
        return self._with(fn(self.df))

    def running(self, *specs: Running, reverse: bool = False) -> "OrderedScan":
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        part = self.keys + ([SLICE] if self.sliced else [])
        base = Window.partitionBy(*part).orderBy(*order) if part else Window.orderBy(*order)

        def frame(w, inclusive):
            return w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

        local = self.df.withColumns(
            {s.name: _aggregate(s.how, s.column).over(frame(base, s.inclusive)) for s in specs})
        if not self.sliced:
            return self._with(local)
        position = F.struct(*self.order)
        totals = self.df.groupBy(*part).agg(*[_total(s.how, s.column, position, reverse).alias(s.name) for s in specs])
        by_slice = Window.partitionBy(*self.keys).orderBy(F.col(SLICE).desc() if reverse else F.col(SLICE))
        carry = totals.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(part)],
            *[_aggregate("sum" if s.how == "count" else s.how, F.col(s.name)).over(frame(by_slice, False))
              .alias(f"_c{i}") for i, s in enumerate(specs)])
        joined = local.join(carry, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(part)], "left")
        joined = joined.withColumns({s.name: _merge(s.how, F.col(f"_c{i}"), F.col(s.name)) for i, s in enumerate(specs)})
        return self._with(joined.drop(*[f"_k{i}" for i in range(len(part))], *[f"_c{i}" for i in range(len(specs))]))

    def result(self) -> DataFrame:
        return self.df.drop(SLICE)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], *specs: Running,
            reverse: bool = False, sliced: bool | None = None) -> DataFrame:
    """One-pass form of :class:`OrderedScan`."""
    return OrderedScan(df, keys, order, sliced=sliced).running(*specs, reverse=reverse).result()


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos",
              sliced: bool | None = None) -> DataFrame:
    """1-based position within the key (a skew-safe row_number)."""
    return running(df, keys, order, Running(name, "count", F.lit(1)), sliced=sliced)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, last: bool = False) -> DataFrame:
    """First (or last) whole row per key by order; map-side combined, so copies may be many.

    A row travels once, its order columns first; rows of one order are decided by their other columns.
    """
    rest = [c for c in df.columns if c not in keys]
    plain = {c for c in rest if isinstance(df.schema[c].dataType, T.AtomicType) and df.schema[c].dataType.typeName() != "variant"}
    if plain == set(rest) and set(order) <= set(df.columns):
        row = F.struct(*[c for c in order if c in rest], *[c for c in rest if c not in order])
        picked = (F.max if last else F.min)(row)
    else:
        picked = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order))
    return (df.groupBy(*keys).agg(picked.alias("_r"))
            .select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*df.columns))


#: Rows of a group that a Python task takes at once: it holds them several times over, in Arrow, pandas and arrays.
PYTHON_ROWS = 200_000


def python_rows(spark) -> int:
    return min(max_rows(spark), PYTHON_ROWS)


def bundles_for(df: DataFrame, total: int) -> int:
    """Number of hash bundles for Python tasks: bounded rows each even if some keys meet, and enough to use the cores."""
    spark = df.sparkSession
    return max(math.ceil(4 * total / python_rows(spark)),
               min(spark.sparkContext.defaultParallelism, max(1, total // 20_000)))


# --- slices that a scan gives whole and in order --------------------------------------------

#: Place of a row: the number of its slice in the upper bits, its place in the slice in the lower ones.
AT = "_at"
_PLACE_BITS = 33


def sorted_slices(df: DataFrame, by: Sequence[Column], total: int, *, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
                  added: Sequence[T.StructField] = ()) -> DataFrame:
    """Rows range-partitioned and sorted ``by``, written once with ``SLICE`` and ``AT``: a slice is one file with one row group.

    A task that scans the table gets whole slices in order (:func:`slice_runs` makes sure), so nothing that
    follows the order has to be shuffled again.  ``fn`` sees the sorted rows before they are written and adds columns.
    """
    spark = df.sparkSession
    slices = max(2, math.ceil(total / max(1, max_rows(spark) // 2)), min(spark.sparkContext.defaultParallelism, total // 20_000))
    rows = df.repartitionByRange(slices, *by).sortWithinPartitions(*by)
    rows = rows.withColumn(SLICE, F.spark_partition_id()).withColumn(AT, F.monotonically_increasing_id())
    if fn is not None:
        rows = rows.mapInArrow(fn, T.StructType([*rows.schema.fields, *added]))
    return stable(rows, "slices", "zstd", {"parquet.block.size": 1 << 30, "maxRecordsPerFile": 0})


def slice_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Pieces of one slice each, in order, and whether the slice begins with the piece."""
    due = None
    for b in batches:
        at = b.column(AT).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1), len(at)] if len(at) else []
        for s, e in zip(cuts, cuts[1:]):
            begins = not at[s] & ((1 << _PLACE_BITS) - 1)
            if not begins and at[s] != due:
                raise RuntimeError("the rows of a slice came apart")
            due = at[e - 1] + 1
            yield b.slice(s, e - s), begins


class KeyRuns:
    """Bounds of the runs of equal keys in pieces of :func:`slice_runs`."""

    def __init__(self, keys: Sequence[str]):
        self.keys, self.last = list(keys), None

    def bounds(self, b: pa.RecordBatch, begins: bool) -> tuple[list[int], bool]:
        """(start of every run and the end, whether the first run begins here)."""
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for k in self.keys:
            codes = b.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        first, last = ([(c[i].is_valid, str(c[i])) for c in map(b.column, self.keys)] for i in (0, b.num_rows - 1))
        fresh = begins or first != self.last
        self.last = last
        return [*np.flatnonzero(new).tolist(), b.num_rows], fresh


def newest(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Rows with the greatest ``at`` of their key, found by hash aggregation; the table is read twice, neither sorted nor (if keys are few) shuffled."""
    top = df.groupBy(*keys).agg(F.max(at).alias("_top")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    top = stable(top, "newest")                            # written, so its size is known
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(top, [*same, F.col(at).eqNullSafe(F.col("_top"))]).select(*df.columns)
