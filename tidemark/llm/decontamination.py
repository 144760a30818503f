"""Benchmark passages in documents by the q-gram lemma and banded alignment.

An item of m characters occurs with at most e edits only where at least m + 1 - q * (e + 1) of its
q-grams lie on e + 1 neighbouring diagonals (place in the text less place in the item).  Texts are
searched for q-grams of the items, hits are counted in bands of 2 * (e + 1) diagonals that
overlap by half, and what reaches the count is aligned inside its band.

The items are the query set: they are read in blocks of bounded size, and every block is carried
to all texts.  Documents are neither moved nor joined.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Positional, keyed_text
from tidemark.llm.kernels import U
from tidemark.llm.line_dedup import CharSums

Q, RATE = 10, 0.08
#: Characters of items that one pass over the documents looks for.
ITEM_CHARS = 2_000_000
TABLE_BITS = 22
NEVER = 0xFFFFFFFF
#: Alignments that go in step.
GROUP = 128
#: Hits in a text from which they are counted by band at once.
MANY_HITS = 500_000
MATCHES = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Lower case where it is one character, and a space for white space, below U+10000."""
    low = [chr(c).lower() for c in range(0x10000)]
    table = np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(low)], np.uint32)
    table[[c for c in range(0x10000) if chr(c).isspace()]] = 0x20
    return table


def folded(text: str) -> np.ndarray:
    """Characters with case and kinds of white space evened out; places stay."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    small = chars < 0x10000
    chars[small] = _fold_table()[chars[small]]
    return chars


@dataclass
class Index:
    """The q-grams of a block of items, sorted by hash."""

    ids: list
    items: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray


def build(ids: list, texts: list[str], q: int, rate: float) -> Index:
    items = [folded(t.strip()) for t in texts]
    sizes = np.array([len(x) for x in items], np.int64)
    budget = np.maximum(0, np.minimum((sizes * rate).astype(np.int64), sizes // q - 1))
    joined = np.concatenate([*items, np.zeros(0, np.uint32)])
    first = np.cumsum(sizes) - sizes
    item = np.repeat(np.arange(len(items)), np.maximum(sizes - q + 1, 0))
    place = np.arange(len(item)) - np.repeat(np.cumsum(np.maximum(sizes - q + 1, 0)) - np.maximum(sizes - q + 1, 0), np.maximum(sizes - q + 1, 0))
    h = CharSums(joined, 7).of(first[item] + place, first[item] + place + q)
    order = np.argsort(h, kind="stable")
    table = np.zeros(1 << TABLE_BITS, bool)
    table[(h >> U(64 - TABLE_BITS)).astype(np.int64)] = True
    return Index(ids, items, budget, sizes + 1 - q * (budget + 1), h[order], item[order], place[order], table)


def candidates(index: Index, texts: list[np.ndarray], q: int) -> list[tuple[int, int, int]]:
    """(text, item, first diagonal of a band) where the hits of a band reach the item's count."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.concatenate([*texts, np.zeros(0, np.uint32)])
    if len(data) < q or not len(index.hashes):
        return []
    first = np.cumsum(sizes) - sizes
    h = CharSums(data, 7).of(np.arange(len(data) - q + 1), np.arange(q, len(data) + 1))
    at = np.flatnonzero(index.table[(h >> U(64 - TABLE_BITS)).astype(np.int64)])
    owner = np.searchsorted(first, at, "right") - 1
    inner = at + q <= first[owner] + sizes[owner]
    at, owner = at[inner], owner[inner]
    low = np.searchsorted(index.hashes, h[at])
    high = np.searchsorted(index.hashes, h[at], "right")
    n = high - low
    # a text that repeats a q-gram of an item as often as it likes is counted band by band, hits are not spelled out
    load = np.bincount(owner, n, len(texts))
    crowded = np.flatnonzero(load > MANY_HITS)
    dense = [c for t in crowded.tolist() for c in _dense(index, t, sizes[t], (at - first[owner])[owner == t], low[owner == t], high[owner == t])]
    if len(crowded):
        keep = ~np.isin(owner, crowded)
        at, owner, low, n = at[keep], owner[keep], low[keep], n[keep]
    rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    who, item = np.repeat(owner, n), index.item[rows]
    pair = who * len(index.items) + item
    seen, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
    good = count[inverse] >= index.least[item]
    who, item, pair = who[good], item[good], pair[good]
    diagonal = np.repeat(at - first[owner], n)[good] - index.place[rows][good]
    width = index.budget[item] + 1
    band = diagonal // width
    keys = np.concatenate([np.column_stack([pair, band]), np.column_stack([pair, band - 1])])
    keys, count = np.unique(keys, axis=0, return_counts=True)
    item = keys[:, 0] % len(index.items)
    good = count >= index.least[item]
    return dense + [(int(p) // len(index.items), int(i), int(b) * int(index.budget[i] + 1)) for p, i, b in zip(keys[good, 0], item[good], keys[good, 1])]


def _dense(index: Index, text: int, size: int, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int]]:
    """``candidates`` of one text: for every place of a q-gram in an item, its places in the text are counted by band."""
    counts: dict[int, np.ndarray] = {}
    shift = {}
    order = np.argsort(low, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(low[order])) + 1):
        if not len(places) or high[places[0]] == low[places[0]]:
            continue
        for row in range(int(low[places[0]]), int(high[places[0]])):
            i, width = int(index.item[row]), int(index.budget[index.item[row]]) + 1
            if i not in counts:
                shift[i] = len(index.items[i]) // width + 2
                counts[i] = np.zeros(shift[i] + int(size) // width + 3, np.int64)
            counts[i] += np.bincount((at[places] - int(index.place[row])) // width + shift[i], minlength=len(counts[i]))
    out = []
    for i, c in counts.items():
        both = c[:-1] + c[1:]  # a band and the next one
        out += [(text, i, int(b - shift[i]) * int(index.budget[i] + 1)) for b in np.flatnonzero(both >= index.least[i])]
    return out


def align(items: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, wide: np.ndarray, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each whole item in its text on ``wide`` diagonals from ``low``, and where it ends.

    The start in the text is free, or at its first character if ``anchored``.  All pairs go through
    the characters of their items in step; a row of the band is one array over all diagonals.
    """
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (items, texts))
    longest, width = int(m.max()), int(wide.max())
    pattern = np.full((len(items), longest), NEVER - 1, np.uint32)
    window = np.full((len(items), longest + width + 1), NEVER, np.uint32)
    for c, (item, text) in enumerate(zip(items, texts)):
        pattern[c, :len(item)] = item
        a, b = max(0, int(low[c])), min(len(text), int(low[c]) + window.shape[1])
        if b > a:
            window[c, a - low[c]:b - low[c]] = text[a:b]
    steps, far = np.arange(width, dtype=np.int32), np.int32(1 << 28)
    first, size, inside = low[:, None].astype(np.int32), n[:, None].astype(np.int32), steps < wide[:, None]
    at = first + steps  # characters of the text used so far, on each diagonal
    row = np.where(inside & (at >= 0) & (at <= size), at if anchored else np.int32(0), far).astype(np.int32)
    for i in range(1, longest + 1):
        at = first + (steps + np.int32(i))
        ok = inside & (at >= 0) & (at <= size)
        best = np.where(at >= 1, row + (window[:, i - 1:i - 1 + width] != pattern[:, i - 1:i]), far)
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)
        best[:, -1] = np.minimum(best[:, -1], far)
        best = np.where(ok, best, far) - steps
        now = np.where(ok, np.minimum.accumulate(best, axis=1) + steps, far)
        row = np.where((i <= m)[:, None], now, row).astype(np.int32)
    at = row.argmin(axis=1)
    return row[np.arange(len(items)), at].astype(np.int64), low + m + at


def _aligned(items: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, wide: np.ndarray, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``align`` in groups of items of like length; an item meets equal stretches of text once."""
    edits, ends = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    seen: dict[tuple, int] = {}
    like = np.empty(len(items), np.int64)
    for c, (item, text) in enumerate(zip(items, texts)):
        a, b = max(0, int(low[c])), min(len(text), int(low[c]) + len(item) + int(wide[c]) + 1)
        like[c] = seen.setdefault((item.tobytes(), int(wide[c]), a - int(low[c]), b - int(low[c]), text[a:max(a, b)].tobytes()), c)
    own = np.unique(like)
    order = own[np.argsort([len(items[i]) for i in own], kind="stable")]
    for g in np.split(order, np.arange(GROUP, len(order), GROUP)):
        if len(g):
            edits[g], ends[g] = align([items[i] for i in g], [texts[i] for i in g], low[g], wide[g], anchored)
    return edits[like], ends[like] - low[like] + low


def matches(index: Index, texts: list[str | None], q: int) -> list[list[dict]]:
    """Verified occurrences in each text; overlapping ones of an item count once, the one with fewest edits."""
    chars = [folded(t or "") for t in texts]
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    tried = candidates(index, chars, q)
    e = np.array([index.budget[i] for _, i, _ in tried], np.int64)
    low = np.array([x for _, _, x in tried], np.int64)
    edits, ends = _aligned([index.items[i] for _, i, _ in tried], [chars[t] for t, _, _ in tried], low - e, 4 * e + 2)
    # the start: the same from the end backwards
    hits = np.flatnonzero(edits <= e)
    items = [index.items[tried[h][1]] for h in hits]
    back = [chars[tried[h][0]][max(0, int(ends[h]) - len(x) - int(e[h])):int(ends[h])][::-1] for h, x in zip(hits, items)]
    _, sizes = _aligned([x[::-1] for x in items], back, -e[hits], 2 * e[hits] + 1, anchored=True)
    for h, size in zip(hits.tolist(), sizes.tolist()):
        found.setdefault(tried[h][:2], []).append((int(edits[h]), int(ends[h]) - size, int(ends[h])))
    out: list[list[dict]] = [[] for _ in texts]
    for (t, i), spans in found.items():
        kept: list[tuple[int, int, int]] = []  # (start, end, edits), apart and in order
        for fewest, a, b in sorted(spans):
            at = bisect_left(kept, (a, b, fewest))
            if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
                kept.insert(at, (a, b, fewest))
        out[t] += [{"item_id": index.ids[i], "start": a, "end": b, "edits": fewest} for a, b, fewest in kept]
    return [sorted(m, key=lambda x: (x["start"], x["item_id"] is not None, x["item_id"] or 0)) for m in out]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    for r in rows.orderBy("i", "t").toLocalIterator():
        if ids and size + len(r.t) > ITEM_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t)
    if ids:
        yield ids, texts


def _with_matches(docs: Positional, block: tuple[list, list[str]], q: int, rate: float) -> DataFrame:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
    made: list[Index] = []

    def run(_: list, texts: list) -> pa.Array:
        if not made:
            made.append(build(*block, q, rate))
        return pa.array(matches(made[0], texts, q), kind)
    return docs.with_value("matches", MATCHES, run)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per occurrence: doc_id, item_id, start, end (characters of the text), edits.

    ``benchmark``: item_id and text.  An item of m characters, without white space around it, is found
    where the text has it with at most min(rate * m, m / q - 1) edits (rounded down); case and kinds
    of white space do not count.  Items of fewer than q characters and NULL ones are not searched.
    NULL and empty texts have no match; a repeated row repeats its matches; equal items are found
    each.  No documents or no items: no rows.  Other columns are ignored.
    """
    rows = Positional(keyed_text(docs, id_col, text_col))
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, end int, edits int")
    for block in _blocks(benchmark, "item_id", "text"):
        one = _with_matches(rows, block, q, rate).select(F.col("c0").alias("doc_id"), F.explode("matches").alias("m"))
        out = out.unionByName(one.select("doc_id", "m.item_id", "m.start", "m.end", "m.edits"))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item occurs."""
    for block in _blocks(benchmark, "item_id", "text"):
        rows = Positional(docs)
        docs = rows.restore(_with_matches(rows, block, q, rate).where(F.size("matches") == 0))
    return docs
