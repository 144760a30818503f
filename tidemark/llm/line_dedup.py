"""Repeated lines by a segment-partition edit join.

A line is cut into TAU + 1 segments.  A line within TAU edits keeps one of them unchanged, near its
place, so lines meet under (length, number and text of a segment): every line is listed under its
own segments and looks up the substrings that can be a segment of a line up to TAU characters
shorter (the multi-match-aware windows).  Meeting lines are compared by the parities of their
hashed character pairs, which an edit can change in four places at most; what is left is verified
by a banded bit-parallel edit distance.

Lines are named by 64-bit hashes; the entries travel to buckets of the key as packed arrays.  Lines
that occur word for word more than once in a block are sent once.  In a bucket, every line is
paired with the first line that looks like it, so a group of lines is a star; a second round
verifies pairs of different components that met, were not verified and have like fine signatures.  Texts are fetched only for
lines that met a similar one.  Short lines, where two edits can make another word, have no entries
and are one class only if they are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Positional, bytes_of, keyed_text, text_blocks
from tidemark.llm.components import components
from tidemark.llm.kernels import BASE, INVERSE, MIX_1, U, mix, powers
from tidemark.session import stable

TAU = 2
#: Shorter lines (white space around a line does not count) have an edit budget of 0: only equal ones are repeats.
LEAST = 20
BLOCK = 500_000
#: Words of the fine signature that the second round compares.
SIGN = 4
BUCKET_BYTES = 8_000_000
#: Buckets that one task takes, one after the other.
BUCKETS_PER_TASK = 4
#: Bits of the fixed-size filter of line hashes whose texts are fetched; only rows, never results, depend on it.
FILTER_BITS = 1 << 24
LOW = -(1 << 63)

LINES = [("kind", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())]
LINES_DDL = "kind int, doc_id long, text_hash long, line int, h1 long, h2 long, n long"


class Lines:
    """The lines of a block of texts, as ranges of one array of characters."""

    def __init__(self, texts: list[str]):
        raw = ("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass")
        self.chars = np.frombuffer(raw, "<u4")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(sizes + 1) - sizes - 1
        self.sizes = sizes
        ends = np.flatnonzero(self.chars == 10)
        starts = np.append(0, ends[:-1] + 1)
        self.owner = np.searchsorted(self.first, starts, "right") - 1
        self.number = np.arange(len(starts)) - np.searchsorted(starts, self.first)[self.owner]
        self.count = np.bincount(self.owner, minlength=len(texts))
        # without white space around
        solid = np.flatnonzero((self.chars != 0x20) & ((self.chars < 0x09) | (self.chars > 0x0D)))
        low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        some = high > low
        self.start, self.end = starts.copy(), starts.copy()
        self.start[some] = solid[low[some]]
        self.end[some] = solid[high[some] - 1] + 1

    def hashes(self, seed: int) -> "CharSums":
        return CharSums(self.chars, seed)


class CharSums:
    """Hash of any range of characters in constant time."""

    def __init__(self, chars: np.ndarray, seed: int):
        n = len(chars)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(chars.astype(np.uint64) + U(seed)) * powers(n, BASE), out=self.sums[1:])
        self.back = powers(n + 1, INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * MIX_1)


def windows(tau: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift): where a segment of a shorter line is looked for."""
    out = []
    for less in range(tau + 1):
        for i in range(tau + 1):
            low = max(-i, less - (tau - i))
            high = min(i, less + (tau - i))
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def _pairs_of(chars: np.ndarray) -> np.ndarray:
    """A hash of each character and the one after it."""
    return (chars[:-1].astype(np.uint64) * U(BASE) + chars[1:].astype(np.uint64) * MIX_1) * U(BASE)


def _parities(bits: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    edges = np.column_stack([start, end - 1]).reshape(-1)
    return np.bitwise_xor.reduceat(np.append(bits, bits.dtype.type(0)), edges)[::2] if len(edges) else bits[:0]


def pair_bits(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32 parities of the hashed character pairs of each range (at least two characters long)."""
    return _parities(np.uint32(1) << (_pairs_of(chars) >> U(59)).astype(np.uint32), start, end)


def signatures(texts: list[str]) -> list[np.ndarray]:
    """256 parities of the character pairs of each line, as four words."""
    lines = Lines(texts)
    where = _pairs_of(lines.chars) >> U(56)
    end = lines.first + lines.sizes
    return [_parities(np.where(where >> U(6) == U(w), U(1) << (where & U(63)), U(0)), lines.first, end).view(np.int64) for w in range(SIGN)]


def entries(lines: Lines, which: np.ndarray, names: np.ndarray, sums: CharSums, tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, names, pair parities and a mark for own segments of the chosen lines."""
    start, end = lines.start[which], lines.end[which]
    size = end - start
    bits = pair_bits(lines.chars, start, end)
    keys, at, own = [], [], []
    for less, i, shift in windows(tau):
        shorter = size - less
        base, longer = shorter // (tau + 1), shorter % (tau + 1)
        # the last segments are one character longer
        place = i * base + np.maximum(0, i - (tau + 1 - longer)) + shift
        width = base + (i >= tau + 1 - longer)
        good = np.flatnonzero((shorter >= LEAST) & (place >= 0) & (place + width <= size))
        text = sums.of(start[good] + place[good], start[good] + place[good] + width[good])
        keys.append(mix(text + U((2 * i + 1) * int(MIX_1) % (1 << 64)) + shorter[good].astype(np.uint64) * U(INVERSE)))
        at.append(good)
        own.append(np.full(len(good), less == 0 and shift == 0))
    at = np.concatenate(at)
    return np.concatenate(keys), names[at], bits[at], np.concatenate(own)


def _lines(tau: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches, BLOCK):
            lines = Lines(texts)
            one, two = lines.hashes(3), lines.hashes(29)
            docs = np.array([LOW if i is None else i for i in ids], np.int64)
            whole = one.of(lines.first, lines.first + lines.sizes).view(np.int64)
            use = np.flatnonzero(lines.end > lines.start)
            h1, h2 = one.of(lines.start[use], lines.end[use]), two.of(lines.start[use], lines.end[use])
            who = lines.owner[use]
            chars = np.bincount(who, (lines.end - lines.start)[use], len(texts)).astype("<i8")
            # rows of the lines: kind 0 a line, kind 1 a document (number of lines, characters of lines)
            table = np.concatenate([
                np.column_stack([np.zeros(len(use), np.int64), docs[who], whole[who], lines.number[use], h1.view(np.int64), h2.view(np.int64), (lines.end - lines.start)[use]]),
                np.column_stack([np.ones(len(texts), np.int64), docs, whole, np.full(len(texts), -1), lines.count, np.zeros(len(texts), np.int64), chars])])
            _, lead = np.unique(h1, return_index=True)
            lead = lead[(lines.end - lines.start)[use[lead]] >= LEAST]
            key, name, bits, own = entries(lines, use[lead], h1[lead], one, tau)
            bucket = (key >> U(31)) % U(buckets)
            order = np.argsort(bucket, kind="stable")
            key, name, bits, own, bucket = key[order], name[order], bits[order], own[order], bucket[order].astype(np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else [], len(bucket)).astype(int)
            rows = [(-1 - abs(int(whole[0])) % buckets, table.astype("<i8").tobytes(), None, None, None)]
            rows += [(int(bucket[a]), key[a:b].tobytes(), name[a:b].tobytes(), bits[a:b].tobytes(), own[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))],
                                             names=["bucket", "keys", "names", "bits", "own"])
    return run


PACKED_DDL = "bucket long, keys binary, names binary, bits binary, own binary"


def _bucket(tau: int):
    def run(table: pa.Table) -> pa.Table:
        """Lines pass through; entries become pairs (kind 2: h1, h2) and meetings (kind 3: key in n, line in h1)."""
        if table.column("bucket")[0].as_py() < 0:
            cols = np.concatenate([np.frombuffer(k, "<i8").reshape(-1, 7) for k in table.column("keys").to_pylist()])
            return _rows(cols)
        key, name, bits, own = (np.concatenate([np.frombuffer(v, t) for v in table.column(c).to_pylist()])
                                for c, t in (("keys", np.uint64), ("names", np.uint64), ("bits", np.uint32), ("own", bool)))
        order = np.lexsort((~own, name, key))
        key, name, bits, own = key[order], name[order], bits[order], own[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))  # own segments come first
        key, name, bits, own = key[fresh], name[fresh], bits[fresh], own[fresh]
        opens = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(opens, len(key)))
        listed = np.logical_or.reduceat(own, opens)
        lead = np.full(len(key), -1)
        two = opens[(sizes == 2) & listed]
        alike = np.bitwise_count(bits[two] ^ bits[two + 1]) <= 4 * tau
        lead[two[alike] + 1] = two[alike]
        heads: list[int] = []
        for a, n in zip(opens[(sizes > 2) & listed].tolist(), sizes[(sizes > 2) & listed].tolist()):
            _stars(bits[a:a + n], 4 * tau, a, lead, heads)
        led = np.flatnonzero(lead >= 0)
        met = np.unique(np.concatenate([led, lead[led], np.array(heads, np.int64)]))
        zero, none = np.zeros(len(led), np.int64), np.zeros(len(met), np.int64)
        return _rows(np.concatenate([
            np.column_stack([zero + 2, zero, zero, zero, name[lead[led]].view(np.int64), name[led].view(np.int64), zero]),
            np.column_stack([none + 3, none, none, none, name[met].view(np.int64), none, key[met].view(np.int64)])]))
    return run


def _stars(bits: np.ndarray, most: int, base: int, lead: np.ndarray, heads: list[int]) -> None:
    """Lead every line of a group to the first one before it that looks alike; lines that have none
    before, but one after, are heads.  So both lines of every pair that looks alike are noted."""
    n = len(bits)
    free = np.arange(n)
    for j in range(n - 1):
        led = lead[base + j] >= 0
        free = free[free > j]
        rest = free if led else np.arange(j + 1, n)
        if led and not len(free):
            continue
        like = rest[np.bitwise_count(bits[rest] ^ bits[j]) <= most]
        if not led and len(like):
            heads.append(base + j)
            like = like[lead[base + like] < 0]
        lead[base + like] = base + j
        free = free[lead[base + free] < 0]


def _rows(cols: np.ndarray) -> pa.Table:
    arrays = [pa.array(cols[:, i].astype(np.int32) if t == pa.int32() else np.ascontiguousarray(cols[:, i]), t, mask=cols[:, 1] == LOW if i == 1 else None)
              for i, (_, t) in enumerate(LINES)]
    return pa.Table.from_arrays(arrays, names=[n for n, _ in LINES])


def banded_distances(left: list[str], right: list[str], tau: int) -> np.ndarray:
    """Edit distance of every pair, or tau + 1 if it is more: bit-parallel in a band of 2 * tau + 1 diagonals.

    All pairs go through their columns in step.  Bit k of a word stands for row j - tau + k.
    """
    m, n = (np.fromiter(map(len, s), np.int64, len(s)) for s in (left, right))
    out = np.full(len(left), tau + 1)
    fits = np.flatnonzero((abs(m - n) <= tau) & (m > tau))
    for i in np.flatnonzero((abs(m - n) <= tau) & (m <= tau)).tolist():
        out[i] = min(tau + 1, _plain_distance(left[i], right[i]))
    if not len(fits):
        return out
    m, n = m[fits], n[fits]
    wide = int(n.max())
    pattern = np.full((len(fits), int(max(m.max(), wide)) + 2 * tau + 2), 0xFFFFFFFF, np.uint32)
    text = np.full((len(fits), wide), 0xFFFFFFFE, np.uint32)
    for r, i in enumerate(fits.tolist()):
        pattern[r, tau:tau + m[r]] = np.frombuffer(left[i].encode("utf-32-le", "surrogatepass"), "<u4")
        text[r, :n[r]] = np.frombuffer(right[i].encode("utf-32-le", "surrogatepass"), "<u4")
    band, one = (1 << (2 * tau + 1)) - 1, np.int64(1)
    plus = np.full(len(fits), ((1 << (tau + 1)) - 1) << tau, np.int64)
    minus, score = np.zeros(len(fits), np.int64), np.full(len(fits), tau, np.int64)
    for j in range(1, wide + 1):
        now = text[:, j - 1]
        eq = np.zeros(len(fits), np.int64)
        for k in range(2 * tau + 1):
            eq |= (pattern[:, j - 1 + k] == now).astype(np.int64) << k
        down = ((((eq & plus) + plus) ^ plus) | eq | minus) & band
        up_h, down_h = (minus | ~(down | plus)) & band, down & plus
        row = m - j + tau  # bit of the last row of the pattern
        diagonal = row >= 2 * tau
        at = np.clip(row, 0, 2 * tau)
        step = np.where(diagonal, 1 - ((down >> (2 * tau)) & one), ((up_h >> at) & one) - ((down_h >> at) & one))
        score += np.where(j <= n, step, 0)
        shifted = down >> 1
        plus, minus = (down_h | ~(shifted | up_h)) & band, shifted & up_h
    out[fits] = np.minimum(score, tau + 1)
    return out


def _plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def _filter(names: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of hashed names, joined by Spark: FILTER_BITS / 64 words at most."""
    word = F.expr(f"pmod(shiftright(h1, 6), {FILTER_BITS // 64})")
    bit = F.expr("shiftleft(1L, cast(pmod(h1, 64) as int))")
    words = np.zeros(FILTER_BITS // 64, np.int64)
    got = names.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    words[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return words


def _texts(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(h1, text) of lines that the filter lets through, once for each name and block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_blocks(batches, BLOCK):
            lines = Lines(texts)
            use = np.flatnonzero(lines.end - lines.start >= LEAST)
            h1 = lines.hashes(3).of(lines.start[use], lines.end[use]).view(np.int64)
            keep = (wanted[(h1 >> 6) % (FILTER_BITS // 64)] >> (h1 % 64)) & 1
            use, h1 = use[keep == 1], h1[keep == 1]
            h1, lead = np.unique(h1, return_index=True)
            out = [lines.chars[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(lines.start[use[lead]], lines.end[use[lead]])]
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(out, pa.string())], names=["h1", "text"])
    return docs.mapInArrow(run, "h1 long, text string")


def _signed(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = b.column(1).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in lines], pa.int64()), *map(pa.array, signatures(lines))],
                                                 names=["h1", "text", "n", *(f"s{w}" for w in range(SIGN))])
    return texts.mapInArrow(run, "h1 long, text string, n long, " + ", ".join(f"s{w} long" for w in range(SIGN)))


def _verified(pairs: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                good = banded_distances(part.column(2).to_pylist(), part.column(3).to_pylist(), tau) <= tau
                yield part.select([0, 1]).filter(pa.array(good))
    left = texts.select(F.col("h1").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("h1").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def line_rows(docs: DataFrame, tau: int = TAU) -> tuple[DataFrame, DataFrame]:
    """Rows of all lines and documents, and (h1, component) of the lines that have similar ones."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * partitions, -(-bytes_of(docs) // BUCKET_BYTES))
    # as many tasks as the text asks for, not as many as there are shuffle partitions
    tasks = max(partitions, -(-buckets // BUCKETS_PER_TASK))
    packed = docs.mapInArrow(_lines(tau, buckets), PACKED_DDL).repartition(tasks, "bucket")
    rows = stable(packed.groupBy("bucket").applyInArrow(_bucket(tau), LINES_DDL), "lines")
    pairs = stable(rows.where("kind = 2").select(F.least("h1", "h2").alias("a"), F.greatest("h1", "h2").alias("b")).distinct(), "line-pairs")
    met = rows.where("kind = 3").select("h1", F.col("n").alias("key"))
    known = _texts(docs, _filter(met.select("h1"))).join(met.select("h1").distinct(), "h1", "left_semi").dropDuplicates(["h1"])
    texts = stable(_signed(known), "line-texts")
    links = stable(_verified(pairs, texts, tau), "line-links")
    group = components(links)
    named = met.join(group.withColumnRenamed("node", "h1"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = stable(named.join(mixed, "key", "left_semi").join(texts.drop("text"), "h1"), "line-meetings")
    apart = sum((F.bit_count(F.col(f"x.s{w}").bitwiseXOR(F.col(f"y.s{w}"))) for w in range(SIGN)), F.lit(0))
    again = (left.alias("x").join(left.alias("y"), "key")
             .where((F.col("x.h1") < F.col("y.h1")) & (F.col("x.component") != F.col("y.component"))
                    & (F.abs(F.col("x.n") - F.col("y.n")) <= tau) & (apart <= 4 * tau))
             .select(F.col("x.h1").alias("a"), F.col("y.h1").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
    more = stable(_verified(again, texts, tau), "line-links")
    if not more.isEmpty():
        group = components(links.unionByName(more))
    return rows, group.select(F.col("node").alias("h1"), "component")


def repeated_lines(docs: DataFrame, tau: int = TAU, whole_from: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_lines, n_removed, removed (sorted line numbers from 0).

    Lines are parted by line feeds; white space around a line does not count, nor do empty lines.
    Equal lines, and lines of LEAST characters or more within ``tau`` edits of each other, directly
    or through others, are one class; its first line in order of (doc_id, text hash, line number) stays and the
    others are removed.  NULL ids come first.  With ``whole_from``, a document that would lose
    that share of the characters of its lines is a copy rather than a host of common lines, and
    nothing is removed from it.  A NULL text is an empty one, which has one empty line.  Rows with the
    same id and text are one document and give one row.  Other columns are ignored.
    """
    keyed = keyed_text(docs, id_col, text_col)
    rows, group = line_rows(keyed, tau)
    lines = rows.where("kind = 0").select(F.coalesce("doc_id", F.lit(LOW)).alias("doc_id"), "text_hash", "line", "h1", "h2", "n").distinct()
    place = F.struct("doc_id", "text_hash", "line")
    exact = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies")).join(group, "h1", "left")
    classes = stable(exact.where("copies > 1 or component is not null"), "line-classes")
    firsts = classes.where("component is not null").groupBy("component").agg(F.min("first").alias("_first"))
    keeper = (classes.join(firsts, "component", "left")
              .select(F.col("h1"), F.col("h2"), F.coalesce("_first", "first").alias("first")))
    gone = (lines.join(keeper, ["h1", "h2"]).where(place != F.col("first"))
            .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("line")).alias("removed"), F.sum("n").alias("lost")))
    whole = (rows.where("kind = 1").select(F.coalesce("doc_id", F.lit(LOW)).alias("doc_id"), "text_hash", F.col("h1").alias("n_lines"), F.col("n").alias("chars")).distinct())
    out = whole.join(gone, ["doc_id", "text_hash"], "left")
    take = F.col("lost").isNotNull()
    if whole_from is not None:
        take = take & (F.col("lost") < F.col("chars") * whole_from)
    removed = F.when(take, F.col("removed")).otherwise(F.array().cast("array<int>"))
    return out.select(F.when(F.col("doc_id") != LOW, F.col("doc_id")).alias("doc_id"), "text_hash", "n_lines",
                      F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_repeated_lines(docs: DataFrame, tau: int = TAU, whole_from: float | None = None, id_col: str = "doc_id", text_col: str = "text",
                           keep_emptied: bool = True) -> DataFrame:
    """All rows and columns of ``docs``, the texts without the repeated lines; a NULL text stays NULL.

    A column ``n_chars``, if there is one, gets the new number of characters where lines went.
    Without ``keep_emptied``, rows that lost lines and have nothing but white space left go; texts
    that were empty before stay.
    """
    found = repeated_lines(docs, tau, whole_from, id_col, text_col).where("n_removed > 0").select(
        F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "removed")
    rows = Positional(docs, id_col, text_col)

    def hashed(_: list, texts: list) -> pa.Array:
        lines = Lines([t or "" for t in texts])
        return pa.array(lines.hashes(3).of(lines.first, lines.first + lines.sizes).view(np.int64))

    known = rows.with_value("_hash", "long", hashed)
    both = known.join(found, F.col(rows.id).cast("long").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left")
    lines = F.split(rows.text, "\n", -1)
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed")))
    # one split a row; the places that stay are looked up in it
    kept = F.transform(F.array(F.struct(lines.alias("x"), stay.alias("i"))), lambda p: F.array_join(F.transform(p["i"], lambda i: F.get(p["x"], i)), "\n"))[0]
    cut = both.withColumn("_text", F.when(F.col("removed").isNotNull(), kept).otherwise(F.col(rows.text)))
    if not keep_emptied:
        cut = cut.where(F.col("removed").isNull() | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {text_col: F.col("_text")}
    if "n_chars" in docs.columns:
        own = F.col(f"c{docs.columns.index('n_chars')}")
        new["n_chars"] = F.when(F.col("removed").isNotNull(), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(own)
    return rows.restore(cut, **new)
