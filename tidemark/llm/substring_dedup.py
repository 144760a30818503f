"""Repeated passages by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 32 bytes has its top bits zero, at a character's
end.  The rule looks at the bytes around the place alone, so a text inserted somewhere moves the
chunks after it but does not change them.  Chunks are compared by a 64-bit digest; the first one
in order of (doc_id, start) is kept.  Only runs of repeated chunks in a row of at least
``min_chars`` count as passages, so common short phrases stay.

A block of texts is searched first, and only the first chunk of a digest there goes on to the
global comparison; a chunk found in a third of all documents is one row for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed_text, longs, text_blocks
from tidemark.llm.kernels import Sums, byte_values, joined, mix

#: Chunks have 2**BITS bytes on average; a place is no cut within LEAST bytes after another.
BITS, LEAST = 5, 8
#: Characters that a run of repeated chunks needs: about 16 words.
MIN_CHARS = 100
BLOCK = 2_000_000


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gear values of it and the 31 bytes before, each shifted by its distance."""
    h = (byte_values(5) >> np.uint64(32)).astype(np.uint32)[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)  # the right side is a copy made before the addition
    return h


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner (index of the text), start and end in characters, digest; and a hash of every text."""
    n = len(texts)
    data, first, last = joined(texts, 32)
    cut = (gear(data) >> np.uint32(32 - BITS)) == 0
    seen = np.cumsum(cut)
    before = np.zeros(len(data), np.int64)
    before[1:] = seen[:-1]
    early = np.zeros(len(data), np.int64)
    early[LEAST:] = seen[:-LEAST]
    cut &= before == early
    head = (data & 0xC0) != 0x80  # first byte of a character
    cut[:-1] &= head[1:]
    at = np.flatnonzero(cut) + 1
    owner = np.searchsorted(first, at, "right") - 1
    inner = (at > first[owner]) & (at < last[owner])
    at, owner = at[inner], owner[inner]
    some = np.flatnonzero(last > first)
    starts = np.sort(np.concatenate([first[some], at]))
    who = np.searchsorted(first, starts, "right") - 1
    closing = np.append(who[1:] != who[:-1], True) if len(who) else np.zeros(0, bool)
    ends = np.append(starts[1:], 0)
    ends[closing] = last[who[closing]]
    sums = Sums(data)
    chars = np.concatenate([[0], np.cumsum(head)])
    base = chars[first[who]]
    whole = sums.of(first, last) if n else np.zeros(0, np.uint64)
    return who, chars[starts] - base, chars[ends] - base, sums.of(starts, ends), whole


ROWS = "kind int, key long, doc_id long, text_hash long, start int, end int, seen_in long"
SPANS = "doc_id long, text_hash long, start int, end int, seen_in long"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: first of their digest in a block; of kind 1: repeats within the block."""
    for ids, texts in text_blocks(batches, BLOCK):
        who, start, end, digest, whole = chunks(texts)
        known = np.array([i is not None for i in ids])
        doc = np.array([i if i is not None else -(1 << 63) for i in ids], np.int64)[who]
        text = whole.view(np.int64)[who]
        order = np.lexsort((start, text, doc, digest))
        d, t, s, h = doc[order], text[order], start[order], digest[order]
        opens = np.ones(len(order), bool)
        opens[1:] = h[1:] != h[:-1]
        lead = np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0)) if len(order) else order
        # the same place of the same document in a repeated row is no repeat
        repeat = ~opens & ((d != d[lead]) | (t != t[lead]) | (s != s[lead]))
        use = opens | repeat
        kind = np.where(repeat, 1, 0)[use]
        key = np.where(repeat, mix((d.view(np.uint64) ^ s.astype(np.uint64)) + h).view(np.int64), h.view(np.int64))[use]
        null = ~known[who[order]][use]
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(key), pa.array(d[use], mask=null), pa.array(t[use]), pa.array(s[use].astype(np.int32)),
             pa.array(end[order][use].astype(np.int32)), pa.array(d[lead][use], mask=~known[who[order]][lead][use])],
            names=["kind", "key", "doc_id", "text_hash", "start", "end", "seen_in"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in; all but the first of each digest out."""
    lead: tuple | None = None
    for b in batches:
        kind, key, doc, text, start, end, seen = map(longs, b.columns)
        n = len(kind)
        if not n:
            continue
        opens = np.ones(n, bool)
        opens[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
        if lead and lead[0] == kind[0] and lead[1] == key[0]:
            opens[0] = False
        at = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
        first = [np.where(at < 0, lead[k] if lead else 0, c[np.maximum(at, 0)]) for k, c in ((2, doc), (3, text), (4, start))]
        other = (doc != first[0]) | (text != first[1]) | (start != first[2])
        out = (kind == 1) | (~opens & other)
        seen = np.where(kind == 1, seen, first[0])
        i = int(at[-1])
        if i >= 0:
            lead = (kind[i], key[i], doc[i], text[i], start[i])
        low = -(1 << 63)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[out], mask=doc[out] == low), pa.array(text[out]), pa.array(start[out].astype(np.int32)),
             pa.array(end[out].astype(np.int32)), pa.array(seen[out], mask=seen[out] == low)], names=["doc_id", "text_hash", "start", "end", "seen_in"])


def _runs(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted repeated chunks in, runs of them out; the last run waits for the next batch."""
        held = np.zeros((0, 5), np.int64)

        def close(rows: np.ndarray, keep_last: bool) -> tuple[np.ndarray, np.ndarray]:
            same = (rows[1:, :3] == rows[:-1, :3]).all(axis=1)
            rows = rows[np.append(True, ~same)]  # a chunk may come twice, from repeated rows
            opens = np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]) | (rows[1:, 2] != rows[:-1, 3]))
            at = np.flatnonzero(opens)
            if keep_last:
                at, rest = at[:-1], rows[at[-1]:]
                rows = rows[:len(rows) - len(rest)]
            else:
                rest = rows[:0]
            if not len(at):
                return rows[:0], rest
            ends = np.append(at[1:], len(rows)) - 1
            runs = np.column_stack([rows[at, 0], rows[at, 1], rows[at, 2], rows[ends, 3], np.minimum.reduceat(rows[:, 4], at)])
            return runs[runs[:, 3] - runs[:, 2] >= min_chars], rest

        for b in batches:
            rows = np.column_stack([longs(c) for c in b.columns])
            if len(rows):
                made, held = close(np.concatenate([held, rows]), True)
                yield _spans(made)
        if len(held):
            yield _spans(close(held, False)[0])
    return run


def _spans(rows: np.ndarray) -> pa.RecordBatch:
    low = -(1 << 63)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[:, 0], mask=rows[:, 0] == low), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)),
         pa.array(rows[:, 3].astype(np.int32)), pa.array(rows[:, 4], mask=rows[:, 4] == low)], names=["doc_id", "text_hash", "start", "end", "seen_in"])


def repeated_spans(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage that is not the first of its kind: doc_id, text_hash, start, end, seen_in.

    start and end are characters of the text (end not included); seen_in is a document with an
    earlier copy of a chunk of the passage (the same document for repeats within one).  Order is
    by doc_id, then text hash, then place; NULL ids come first.  NULL and empty texts have no
    passage.  Rows with the same id and text are one document and get the same spans once.
    """
    found = keyed_text(docs, id_col, text_col).mapInArrow(_search, ROWS)
    again = (found.repartition(F.col("kind"), F.col("key"))
             .sortWithinPartitions("kind", "key", "doc_id", "text_hash", "start").mapInArrow(_repeats, SPANS))
    return (again.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "start", "end")
            .mapInArrow(_runs(min_chars), SPANS))


def repeated_documents(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with repeated passages: doc_id, text_hash, n_spans, repeated_chars, spans, seen_in (sorted set)."""
    return repeated_spans(docs, min_chars, id_col, text_col).groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("repeated_chars"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("seen_in")).alias("seen_in"))


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of all rows with the repeated passages cut out; a NULL text stays NULL."""
    found = repeated_documents(docs, min_chars, id_col, text_col).select(
        F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "spans")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            data, first, last = joined([t or "" for t in texts], 32)
            h = Sums(data).of(first, last).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h)], names=["doc_id", "text", "text_hash"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                at, kept = 0, []
                for s in spans or []:
                    kept.append(text[at:s["start"]])
                    at = s["end"]
                out.append(text if text is None else "".join(kept) + text[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = keyed_text(docs, id_col, text_col).mapInArrow(hashed, "doc_id long, text string, text_hash long")
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, text string")
