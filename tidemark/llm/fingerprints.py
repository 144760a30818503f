"""Context-triggered piecewise hashing of documents.

A hash of the last seven bytes is taken at every byte; where it ends in k zero bits, a piece
ends.  k is the smallest level that leaves at most 64 pieces.  A piece gives one of 64 characters, so a
fingerprint is ``k:signature:signature at level k + 1``.  Two fingerprints compare where they
share a level, by the edit distance of the signatures there; a change of a text alters the
characters of the pieces it touches and no others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed_text
from tidemark.llm.kernels import Sums, joined, ranges_within
from tidemark.llm.ranges import id_bounds, with_range
from tidemark.session import stable

WINDOW = 7
PIECES = 64
#: Signatures with no common run of so many characters have nothing in common.
COMMON = 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
BLOCK = 2_000_000


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of every text; an empty one gives ``0::``."""
    n = len(texts)
    data, first, last = joined(texts, WINDOW)
    sums = Sums(data)
    at = ranges_within(first, last)
    owner = np.repeat(np.arange(n), last - first)
    hashed = sums.of(at - (WINDOW - 1), at + 1)
    level, done = 0, np.zeros(n, bool)
    chosen = np.full(n, -2, np.int64)
    signatures: list[list[str]] = [[] for _ in range(n)]
    while not done.all():
        inner = at < last[owner] - 1
        ends = np.bincount(owner[inner], minlength=n)
        fresh = (chosen < 0) & (ends < PIECES)
        chosen[fresh] = level
        wanted = fresh | (chosen == level - 1)
        for i, s in zip(np.flatnonzero(wanted), _signatures(sums, first, last, at[inner], owner[inner], wanted)):
            signatures[i].append(s)
        done |= chosen == level - 1
        level += 1
        keep = (hashed & np.uint64((1 << min(level, 63)) - 1)) == 0 if level < 64 else np.zeros(len(at), bool)
        at, owner, hashed = at[keep], owner[keep], hashed[keep]
    return [f"{k}:{a}:{b}" for k, (a, b) in zip(chosen.tolist(), signatures)]


def _signatures(sums: Sums, first: np.ndarray, last: np.ndarray, at: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> list[str]:
    """A character for each piece of the wanted texts; ``at``: last byte of every piece but the last one."""
    who = np.flatnonzero(wanted & (last > first))
    mine = wanted[owner]
    starts = np.concatenate([first[who], at[mine] + 1])
    starts.sort()
    sizes = np.bincount(owner[mine], minlength=len(first))[who] + 1
    ends = np.append(starts[1:], 0)
    closing = np.cumsum(sizes) - 1
    ends[closing] = last[who]
    chars = ALPHABET[(sums.of(starts, ends) >> np.uint64(58)).astype(np.int64)].tobytes().decode()
    cuts = np.concatenate([[0], closing + 1]).tolist()
    made = dict(zip(who.tolist(), (chars[a:b] for a, b in zip(cuts, cuts[1:]))))
    return [made.get(i, "") for i in np.flatnonzero(wanted).tolist()]


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of ASCII strings of at most 64 characters, all pairs in step."""
    n, one = len(a), np.uint64(1)
    m = np.fromiter(map(len, a), np.int64, n)
    k = np.fromiter(map(len, b), np.int64, n)
    width = int(k.max(initial=0))
    text = np.frombuffer("".join(s.ljust(width, "\0") for s in b).encode(), np.uint8).reshape(n, width) if width else np.zeros((n, 0), np.uint8)
    where = np.zeros((n, 128), np.uint64)
    rows = np.repeat(np.arange(n), m)
    places = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    np.bitwise_or.at(where, (rows, np.frombuffer("".join(a).encode(), np.uint8)), one << places.astype(np.uint64))
    top = np.maximum(m - 1, 0).astype(np.uint64)
    plus, minus, score, each = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), m.copy(), np.arange(n)
    for j in range(width):
        eq = where[each, text[:, j]]
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus), plus & xh
        step = ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64)
        score += np.where(j < k, step, 0)
        up, down = (up << one) | one, down << one
        plus, minus = down | ~(xv | up), up & xv
    return np.where(m == 0, k, score)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 if equal, 0 at incompatible levels or with nothing in common."""
    out = np.zeros(len(left))
    pairs: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1.0
            continue
        (kx, *sx), (ky, *sy) = x.split(":"), y.split(":")
        for dx, a in enumerate(sx):
            dy = int(kx) + dx - int(ky)
            if dy in (0, 1) and a and sy[dy] and _common(a, sy[dy]):
                pairs.append((i, a, sy[dy]))
    if pairs:
        far = edit_distances([p[1] for p in pairs], [p[2] for p in pairs])
        longer = np.array([max(len(p[1]), len(p[2])) for p in pairs])
        np.maximum.at(out, [p[0] for p in pairs], np.minimum(1 - far / longer, 0.99))
    return out


def _common(a: str, b: str) -> bool:
    size = min(COMMON, len(a), len(b))
    return not {a[i:i + size] for i in range(len(a) - size + 1)}.isdisjoint(b[i:i + size] for i in range(len(b) - size + 1))


def compare_with_next(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and the likenesses.

    Edited text: the last half of the characters (rounded down) replaced by as many from the start
    of the next document (all, if it has fewer).  Next: ascending doc_id, the first after the last;
    rows with equal ids follow each other by text, NULL ids come first.  A NULL text is empty.  One
    row alone is its own next one.  No rows, no result.  Other columns are ignored.

    Result: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt to ranges of ids and sorted there; a task streams its range with one
    document of look-ahead.  The last document of a range meets the first one of the next range
    in a small join, one row for each range.
    """
    spark = docs.sparkSession
    keyed = keyed_text(docs, id_col, text_col)
    bounds = id_bounds(keyed, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = with_range(keyed, bounds).repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "doc_id", "text")
    made = stable(dealt.mapInArrow(_stream, f"{RESULT}, {EDGES}"), "fingerprints")
    edges = made.where("head is not null or tail is not null")
    held = sorted(r[0] for r in edges.select("range").distinct().collect())  # at most one number a range
    if not held:
        return made.select(*NAMES)
    following = spark.createDataFrame(list(zip(held, held[1:] + held[:1])), "range int, following int")
    heads = edges.where("head is not null").select(F.col("range").alias("_r"), F.col("head").alias("_next"))
    last = (edges.where("tail is not null").join(following, "range").join(heads, F.col("following") == F.col("_r"))
            .select("doc_id", "tail", "_next").mapInArrow(_pairs, RESULT))
    return made.where("fingerprint is not null").select(*NAMES).unionByName(last)


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
EDGES = "range int, head string, tail string"
NAMES = [f.split()[0] for f in RESULT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compare(ids: list, texts: list[str], following: list[str]) -> list:
    """Columns of the result for documents and the texts after them."""
    edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, following)]
    every = fingerprints(texts + edited + following[-1:])
    own, changed = every[:len(texts)], every[len(texts):2 * len(texts)]
    after = own[1:] + every[-1:]
    hashes = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]
    return [ids, list(map(len, texts)), hashes, own, changed, likeness(own, changed), likeness(own, after)]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = NAMES + ["range", "head", "tail"]

    def batch(cols: list, part: int, head: str | None = None, tail: str | None = None) -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(cols, _TYPES)]
        k = len(arrays[0])
        extra = [pa.array([part] * k, pa.int32()), pa.array([head] * k, pa.string()), pa.array([tail] * k, pa.string())]
        return pa.RecordBatch.from_arrays(arrays + extra, names=names)

    def edge(part: int, doc: int | None, head: str | None, tail: str | None) -> pa.RecordBatch:
        return batch([[doc]] + [[None]] * 6, part, head, tail)

    ids, texts, size, now = [], [], 0, None
    for b in batches:
        for doc, text, part in zip(*(c.to_pylist() for c in b.columns)):
            text = text or ""
            if part != now:
                if texts:
                    yield from _finish(ids, texts, now, batch, edge)
                yield edge(part, None, text, None)
                ids, texts, size, now = [], [], 0, part
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size > BLOCK and len(texts) > 1:
                yield batch(_compare(ids[:-1], texts[:-1], texts[1:]), now)
                ids, texts, size = ids[-1:], texts[-1:], len(text)
    if texts:
        yield from _finish(ids, texts, now, batch, edge)


def _finish(ids: list, texts: list[str], part: int, batch, edge) -> Iterator[pa.RecordBatch]:
    if len(texts) > 1:
        yield batch(_compare(ids[:-1], texts[:-1], texts[1:]), part)
    yield edge(part, ids[-1], None, texts[-1])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc, text, after in zip(*(c.to_pylist() for c in b.columns)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_compare([doc], [text], [after]), _TYPES)], names=NAMES)
