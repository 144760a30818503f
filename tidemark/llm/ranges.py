"""Ranges of an integer id with known bounds, so that neighbouring ranges can be told apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import longs

#: Ids drawn for each range, for its bounds alone; they never change a result.
SAMPLES_PER_RANGE = 200


def id_bounds(df: DataFrame, ranges: int, col: str = "doc_id") -> list[int]:
    """Lowest id of every range but the first: quantiles of a bounded sample of ids."""
    ids = df.select(F.col(col).cast("long").alias("id")).where(F.col("id").isNotNull())
    want = ranges * SAMPLES_PER_RANGE
    total = ids.count()
    if ranges < 2 or not total:
        return []
    drawn = np.sort([r[0] for r in ids.sample(fraction=min(1.0, 2.0 * want / total), seed=11).limit(4 * want).collect()])
    return sorted({int(drawn[len(drawn) * i // ranges]) for i in range(1, ranges)}) if len(drawn) else []


def with_range(df: DataFrame, bounds: list[int], col: str = "doc_id") -> DataFrame:
    """``range``: the number of the id's range; NULL ids are in the first."""
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index(col))
            at = np.searchsorted(edges, longs(ids), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "range"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, range int")
