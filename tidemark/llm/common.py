"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import utc

#: Characters of text that one Python block handles at a time; bounds the memory of a task.
BLOCK_CHARS = 4_000_000
#: The same where rows are passed through.
ROW_CHARS = 500_000
#: Rows that are turned into Python strings at a time.
BATCH_ROWS = 128


#: Rows of an Arrow batch where the session has Spark's own default: texts are long, and a batch is held on both sides.
ARROW_ROWS, ARROW_DEFAULT, ARROW_KEY = 1000, "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(df: DataFrame) -> DataFrame:
    """Make the package known to the executors before Python work is planned, with batches of moderate size."""
    spark = utc(df.sparkSession)
    if spark.conf.get(ARROW_KEY) == ARROW_DEFAULT:
        spark.conf.set(ARROW_KEY, str(ARROW_ROWS))
    return df


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside its successors and the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns, whatever their names, never meet the operator's own."""
    return ready(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_CHARS) -> Iterator[tuple[list, list]]:
    """(ids, texts) in blocks of about ``limit`` bytes; NULL texts become empty ones.

    A block has whole rows in their order; a text longer than the limit is a block of its own.
    """
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):  # a whole batch as Python strings would be held beside the block
            part = batch.slice(at, BATCH_ROWS)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                t = t or ""
                if ids and size + len(t) > limit:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
    if ids:
        yield ids, texts
    del ids, texts
    give_back()


def longs(column: pa.Array) -> np.ndarray:
    """64-bit integers of a column; NULL becomes the least one."""
    return column.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def bytes_of(texts: DataFrame) -> int:
    """Bytes of all texts: one scan with a partial sum, used to size partitions."""
    return int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


class Positional:
    """A table with its columns renamed by place, so that columns added by an operator cannot clash."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.names = docs.columns
        self.df = ready(docs).toDF(*(f"c{i}" for i in range(len(self.names))))
        self.id, self.text = (f"c{self.names.index(c)}" for c in (id_col, text_col))

    def restore(self, df: DataFrame, **new: Column) -> DataFrame:
        """The table's own columns under their names; ``new`` gives other values, by name."""
        return df.select(*(new.get(n, F.col(f"c{i}")).alias(n) for i, n in enumerate(self.names)))

    def with_value(self, name: str, kind: str, fn: Callable[[list, list], pa.Array]) -> DataFrame:
        """``df`` and a column made from the ids and texts of a bounded number of rows at a time."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.df.schema.fields)
        id_at, text_at = (self.df.columns.index(c) for c in (self.id, self.text))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes, at = pc.binary_length(b.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False), 0
                ends = np.cumsum(sizes)
                while at < len(sizes):
                    end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + ROW_CHARS, "right")))
                    part = b.slice(at, end - at)
                    new = fn(part.column(id_at).to_pylist(), part.column(text_at).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns, new], names=[*part.schema.names, name])
                    at = end
        return self.df.mapInArrow(run, f"{schema}, `{name}` {kind}")
