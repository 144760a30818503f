"""Best-two-fit packing of tokenized documents into sequences.

A bin is filled greedily with the longest piece that fits; then its smallest piece gives way to
two unpacked ones if they fill the widened gap more tightly.  A piece is known by its length
alone, and there are at most ``size`` lengths, so the plan is made from the counts of the lengths:
a filled bin is a pattern of lengths, used as often as the counts allow, which is just what
filling bin after bin would do.  Spark counts the lengths, numbers the pieces of each length
(salted, so a length that a third of all pieces share is many groups) and looks up their places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keyed_text, text_blocks
from tidemark.llm.tokens import BYTE_LEVEL, Cuts, encoder, end_each
from tidemark.session import stable

SIZE = 1024
#: Pieces of one length that one task numbers.
NUMBERED = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole ones, a shorter one first."""
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SIZE, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text", cuts: Cuts = BYTE_LEVEL) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array<int>)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer, cuts)
        for ids, texts in text_blocks(batches):
            flat, counts = end_each(*tok.encode(texts), end_id)
            flat = flat.astype("<u4", copy=False)
            rows: list[tuple] = []
            kept: list[np.ndarray] = []
            base = 0
            for doc, n in zip(ids, counts.tolist()):
                for k, (start, length) in enumerate(cut(n, size)):
                    part = flat[base + start:base + start + length]
                    rows.append((doc, k, start, length, zlib.crc32(part)))
                    kept.append(part.astype(np.int32)) if with_ids else None
                base += n
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return keyed_text(docs, id_col, text_col).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


@dataclass(frozen=True)
class Plan:
    """Slots sorted by (length, first number): a slot takes ``uses`` pieces, one for each of its sequences."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Best-two-fit over counts of lengths (1 to size)."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    taken = np.zeros(size + 1, np.int64)
    slots: list[tuple[int, int, int, int]] = []
    sequence = 0
    while left.any():
        have = left.copy()
        items, gap = [], size
        while gap and len(fits := np.flatnonzero(have[1:gap + 1])):
            items.append(int(fits[-1]) + 1)
            have[items[-1]] -= 1
            gap -= items[-1]
        if gap and len(items) > 1:
            two = _two_fit(have, items[-1], gap)
            if two:
                have[items.pop()] += 1
                items += two
        used = np.bincount(items, minlength=size + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        offset = 0
        for length in items:
            slots.append((length, int(taken[length]), sequence, offset))
            taken[length] += times
            left[length] -= times
            offset += length
        sequence += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], sequence)


def _two_fit(have: np.ndarray, smallest: int, gap: int) -> list[int] | None:
    """Two lengths whose sum is above ``smallest`` and as near to ``smallest + gap`` as can be."""
    room = smallest + gap
    lengths = np.flatnonzero(have[:room] > 0)
    best, low, high = smallest, 0, len(lengths) - 1
    found = None
    while low <= high:
        a, b = int(lengths[low]), int(lengths[high])
        if a + b > room or (low == high and have[a] < 2):
            high -= 1
            continue
        if a + b > best:
            best, found = a + b, [b, a]
        low += 1
    return found


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset.

    ``parts`` should be a written table: it is read three times.  Sequences are numbered from 0
    without gaps; inside one, offsets run without gaps from 0 and end at ``size`` or before.
    Equal rows are different pieces and get different places.  No rows, no sequences.
    """
    counts = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}  # at most ``size`` rows
    made = plan(counts, size)
    salts = max(1, -(-max(counts.values(), default=0) // NUMBERED))
    order = ["doc_id", "piece", "ids_crc32"]
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = (salted.groupBy("length", "_salt").count()
              .withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count"))
              .select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), "_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)).cast("long"))
    ranked = ranked.join(before, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before") - 1).drop("_l", "_s", "_salt", "_before")
    key = made.length * (1 << 44) + made.first

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = b.pop("_rank").to_numpy()
            at = np.searchsorted(key, b["length"].to_numpy() * (1 << 44) + rank, "right") - 1
            yield b.assign(sequence_id=made.sequence[at] + rank - made.first[at], offset=made.offset[at])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SIZE, with_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents: ids by the tokenizer and ``end_id``, cut only where longer than ``size``.

    A NULL or empty text is the end id alone.  NULL and repeated doc_ids are kept, one set of
    pieces for each row.  Other columns are ignored.  No documents, no rows.
    """
    return pack(stable(pieces(docs, tokenizer, end_id, size, with_ids, id_col, text_col), "pieces"), size)
