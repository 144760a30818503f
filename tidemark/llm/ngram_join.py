"""Jaccard join of documents on word n-grams with prefix, length, positional and suffix filters.

An n-gram is a 64-bit hash; two sets of n hashes are mistaken for more alike by accident with a
chance of about n * n / 2**64.

1. Frequencies.  A task reads a block of texts and sends the block's hashes, as packed arrays, to
   buckets of the hash; a hash is sent once a block, with the number of documents that have it there.
   A bucket adds up and answers every block with the hashes that more than one document has.
   N-grams of a single document never match, so they are only counted; most documents end here.
2. Prefixes.  A document's n-grams are ordered rare first (single ones, then by count and hash).
   Documents that reach the threshold share an n-gram in the first n - ceil(t * n) + 1 of both.
3. Equal sets are one class from here on, so a group of copies is one node.
4. Links.  In a first round every document meets, for each n-gram of its prefix, only the one
   document of similar size there with the fewest single n-grams.  Groups of near copies become
   stars and then components.  In a second round all pairs that share a prefix n-gram, lie in
   different components and pass the length and positional filters are verified too.  A pair is
   verified once, after the suffix filter, on the n-grams that are not single.  No link between
   components is lost, and pairs inside a component are not spelled out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Positional, bytes_of, keyed_text, text_blocks
from tidemark.llm.components import components
from tidemark.llm.kernels import MIX_2, U, mix, ranges_within, words
from tidemark.session import stable

WORDS, PERCENT = 5, 75
BLOCK = 500_000
#: Text bytes for each bucket of hashes; a bucket is counted in memory by one task at a time.
BUCKET_BYTES = 16_000_000
#: Buckets that one task counts, one after the other.
BUCKETS_PER_TASK = 4
LOW = -(1 << 63)


def _place(k: int) -> np.uint64:
    """A value for the k-th place of an n-gram, so that the order of its words counts."""
    return U((2 * k + 1) * int(MIX_2) % (1 << 64))


def shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of every text, sorted by text and hash: hashes, and how many each text has.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    h, owner = words(texts)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    grams = np.zeros(len(h), np.uint64)
    for k in range(min(n, len(h))):
        grams[:len(h) - k] += mix(h[k:] + _place(k))
    inside = np.arange(len(h)) - first[owner] <= counts[owner] - n
    short = np.flatnonzero((counts > 0) & (counts < n))
    alone = [mix(np.array([sum(int(mix(h[first[i] + k:first[i] + k + 1] + _place(k))[0]) for k in range(counts[i])) % (1 << 64)], np.uint64)
                 + U(int(counts[i]))) for i in short]
    values = np.concatenate([mix(grams[inside]), *alone])
    who = np.concatenate([owner[inside], short])
    order = np.lexsort((values, who))
    values, who = values[order], who[order]
    new = np.append(True, (values[1:] != values[:-1]) | (who[1:] != who[:-1])) if len(values) else np.zeros(0, bool)
    return values[new], np.bincount(who[new], minlength=len(texts))


@dataclass(frozen=True)
class Threshold:
    """Sets of a and b with i in common are linked when 100 * i >= percent * (a + b - i)."""

    percent: int

    def least(self, n: int | np.ndarray):
        """The fewest n-grams that a set of n shares with any set it is linked to."""
        return -(-self.percent * n // 100)

    def enough(self, common: Column, a: Column, b: Column) -> Column:
        return common * (100 + self.percent) >= (a + b) * self.percent


def narrow(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes that hold the largest; the first byte tells how many."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _packed(blocks: Iterator[tuple[list, list]], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for number, (ids, texts) in enumerate(blocks):
        values, counts = shingles(texts, n)
        owner = np.repeat(np.arange(len(texts)), counts)
        sums = [np.zeros(len(texts), np.uint64) for _ in range(2)]
        edges = np.concatenate([[0], np.cumsum(counts)])
        for total, salt in zip(sums, (U(0x51), U(0xA7))):
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + salt))])
            total[:] = running[edges[1:]] - running[edges[:-1]]
        # of equal sets in a block only the first sends its n-grams, one with an id if there is any
        known_first = np.argsort([i is None for i in ids], kind="stable")
        _, lead = np.unique(np.column_stack([counts.astype(np.uint64), *sums])[known_first], axis=0, return_index=True)
        leads = np.zeros(len(texts), bool)
        leads[known_first[lead]] = True
        use = leads[owner]
        values, owner = values[use], owner[use]
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        opens = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
        # a hash is sent once with the number of its documents; who they are stays with the block
        values, sizes = values[opens], np.diff(np.append(opens, len(values)))
        bucket = (((values >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else [], len(bucket)).astype(int)
        docs = np.array([LOW if i is None else i for i in ids], "<i8").tobytes()
        meta = docs + counts.astype("<i8").tobytes() + sums[0].tobytes() + sums[1].tobytes()
        block = (part << 32) | number
        rows = [(-1, block, 0, meta, leads.astype(np.uint8).tobytes(), narrow(owner), narrow(sizes))]
        rows += [(int(bucket[a]), block, int(a), values[a:b].tobytes(), narrow(sizes[a:b]), None, None) for a, b in zip(cuts, cuts[1:])]
        yield _arrays(rows, PACKED)


#: A block's row (bucket -1): ``hashes`` are ids, sizes and digests, ``counts`` the leads, ``owners`` the documents of its hashes, ``sizes`` how many each has.
#: An answer names hashes of the block by the first one's place and the gaps between them.
PACKED = [("bucket", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()),
          ("owners", pa.binary()), ("sizes", pa.binary())]
ANSWER = [("block", pa.int64()), ("meta", pa.binary()), ("leads", pa.binary()), ("owners", pa.binary()), ("sizes", pa.binary()),
          ("first", pa.int64()), ("gaps", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())]
SETS = [("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("single", pa.int64()), ("grams", pa.list_(pa.int64()))]


def _arrays(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


def _ddl(fields: list) -> str:
    return ", ".join(f"{name} {'array<long>' if pa.types.is_list(t) else 'binary' if pa.types.is_binary(t) else 'long'}" for name, t in fields)


def _count(table: pa.Table) -> pa.Table:
    """A bucket: for every block its hashes that other documents have too, with their counts."""
    bucket = table.column("bucket")[0].as_py()
    blocks = table.column("block").to_pylist()
    hashes, numbers = table.column("hashes").to_pylist(), table.column("counts").to_pylist()
    if bucket < 0:
        rest = (table.column(c).to_pylist() for c in ("owners", "sizes"))
        return pa.Table.from_batches([_arrays([(*r, None, None, None, None) for r in zip(blocks, hashes, numbers, *rest)], ANSWER)])
    parts = [np.frombuffer(h, np.uint64) for h in hashes]
    values, number = np.concatenate(parts), np.concatenate([wide(c) for c in numbers])
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    opens = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    counts = np.empty(len(values), np.int64)
    counts[order] = np.repeat(np.add.reduceat(number[order], opens), np.diff(np.append(opens, len(ranked))))
    rows, at = [], 0
    for block, first, part in zip(blocks, table.column("first").to_pylist(), parts):
        some = np.flatnonzero(counts[at:at + len(part)] > 1)
        if len(some):
            rows.append((block, None, None, None, None, first, narrow(np.diff(some, prepend=0)), part[some].tobytes(), narrow(counts[at + some])))
        at += len(part)
    return pa.Table.from_batches([_arrays(rows, ANSWER)])


def _assemble(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """A block: its documents, and the shared n-grams, rare first, of those that may have links."""
        rows = table.to_pylist()
        head = next(r for r in rows if r["meta"] is not None)
        docs, n, d1, d2 = np.frombuffer(head["meta"], "<i8").reshape(4, -1)
        leads = np.frombuffer(head["leads"], np.uint8) > 0
        got = [r for r in rows if r["hashes"] is not None]
        places = np.concatenate([r["first"] + np.cumsum(wide(r["gaps"])) for r in got] or [np.zeros(0, np.int64)])
        sizes = wide(head["sizes"])
        starts, own = (np.cumsum(sizes) - sizes)[places], sizes[places]
        owner = wide(head["owners"])[ranges_within(starts, starts + own)]
        hashes = np.repeat(np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in got] or [np.zeros(0, np.uint64)]), own)
        counts = np.repeat(np.concatenate([wide(r["counts"]) for r in got] or [np.zeros(0, np.int64)]), own)
        single = n - np.bincount(owner, minlength=len(docs))
        may = leads & (docs != LOW) & (n > 0) & (n - Threshold(percent).least(n) + 1 > single)
        use = may[owner]
        hashes, owner, counts = hashes[use], owner[use], counts[use]
        order = np.lexsort((hashes, counts, owner))
        sizes = np.bincount(owner, minlength=len(docs))
        grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(hashes[order].view(np.int64)))
        grams = pa.array([g if m else None for g, m in zip(grams.to_pylist(), may)], pa.list_(pa.int64())) if not may.all() else grams
        return pa.Table.from_arrays([pa.array(docs, mask=docs == LOW), pa.array(n), pa.array(d1), pa.array(d2), pa.array(single), grams],
                                    names=[f for f, _ in SETS])
    return run


def gram_sets(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n (set size), d1 and d2 (digest of the set), single, grams.

    ``grams`` are the n-grams that other documents have too, rare first; NULL where no link is
    possible or an equal set in the block has them.  ``docs`` must give the same rows in the same
    order when a task is repeated, as files do.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * partitions, -(-bytes_of(docs) // BUCKET_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(text_blocks(batches, BLOCK), n, buckets)

    packed = docs.mapInArrow(run, _ddl(PACKED))
    # block rows are dealt by block, hashes by bucket
    deal = F.when(F.col("bucket") < 0, -1 - F.pmod("block", F.lit(buckets))).otherwise(F.col("bucket"))
    # as many tasks as the text asks for, not as many as there are shuffle partitions
    tasks = max(partitions, -(-buckets // BUCKETS_PER_TASK))
    answers = packed.withColumn("deal", deal).repartition(tasks, "deal").groupBy("deal").applyInArrow(_count, _ddl(ANSWER))
    return answers.repartition(tasks, "block").groupBy("block").applyInArrow(_assemble(percent), _ddl(SETS))


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs with both sets in, links out; the suffix filter bounds the overlap before it is counted."""
        for b in batches:
            a, c, na, nc = (b.column(i).to_numpy() for i in range(4))
            left, right = (np.split(x.flatten().to_numpy().view(np.uint64), x.offsets.to_numpy()[1:-1] - x.offsets[0].as_py()) for x in b.columns[4:6])
            need = -(-percent * (na + nc) // (100 + percent))
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = np.sort(left[i]), np.sort(right[i])
                good[i] = overlap_bound(x, y) >= need[i] and len(np.intersect1d(x, y, assume_unique=True)) >= need[i]
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(c[good])], names=["a", "b"])
    return run


def overlap_bound(x: np.ndarray, y: np.ndarray, parts: int = 16) -> int:
    """Upper bound of the overlap of two sorted sets: both are cut at the same values, and a part
    has no more in common than its smaller side has."""
    if not len(x) or not len(y):
        return 0
    probes = y[np.arange(1, parts) * len(y) // parts]
    cx = np.diff(np.concatenate([[0], np.searchsorted(x, probes), [len(x)]]))
    cy = np.diff(np.concatenate([[0], np.searchsorted(y, probes), [len(y)]]))
    return int(np.minimum(cx, cy).sum())


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among distinct pairs (a, b)."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("grams").alias(f"g_{name}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    return full.select("a", "b", "n_a", "n_b", "g_a", "g_b").mapInArrow(_verify(percent), "a long, b long").distinct()


def similar_documents(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    A set holds the distinct n-word sequences of a text, A-Z lower-cased; with fewer words the whole
    sequence; without words, or for a NULL text, it is empty and linked with nothing.  Two
    documents are linked when 100 * shared >= percent * united; component_id is the smallest
    doc_id reachable.  A row with a NULL id has no links and a NULL component.  Rows with equal
    ids are one document, linked by any of its texts.  Other columns are ignored.
    """
    sets = stable(gram_sets(keyed_text(docs, id_col, text_col), n, percent), "gram-sets")
    rule = Threshold(percent)
    key = ["n", "d1", "d2"]
    classes = sets.where("n > 0 and doc_id is not null").groupBy(*key).agg(
        F.min("doc_id").alias("node"), F.min(F.when(F.col("grams").isNotNull(), F.col("doc_id"))).alias("_carrier"))
    classes = stable(classes, "classes")
    carriers = classes.where("_carrier is not null").withColumnRenamed("_carrier", "doc_id")
    nodes = stable(sets.where("grams is not null").join(carriers, [*key, "doc_id"]).select("node", "n", "single", "grams", "d1", "d2")
                   .dropDuplicates(["node", "n", "d1", "d2"]), "nodes")

    prefix = (F.col("n") - F.expr(f"cast((n * {percent} + 99) div 100 as long)") + 1 - F.col("single")).cast("int")
    posted = nodes.select("node", "n", "single", F.posexplode(F.slice("grams", F.lit(1), prefix)).alias("at", "gram"))
    posted = posted.select("gram", "node", "n", "single", (F.col("at") + F.col("single")).alias("pos"),
                           F.floor(F.log("n") / float(np.log(100 / percent))).cast("long").alias("band"))
    posted = stable(posted, "prefixes")

    def may(x: str, y: str) -> Column:
        """Length, single-gram and positional filters."""
        def c(side: str, name: str) -> Column:
            return F.col(f"{side}.{name}")
        rest = F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos"))
        shorter, longer = F.least(c(x, "n"), c(y, "n")), F.greatest(c(x, "n"), c(y, "n"))
        return (shorter * 100 >= longer * percent) & rule.enough(rest, c(x, "n"), c(y, "n"))

    hubs = posted.groupBy("gram", "band").agg(F.min(F.struct("single", "node", "n", "pos")).alias("h"))
    hubs = hubs.select("gram", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "h.node", "h.n", "h.pos")
    first = (posted.alias("x").join(hubs.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.band") == F.col("y.band")))
             .where((F.col("x.node") != F.col("y.node")) & may("x", "y"))
             .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    first = stable(first, "pairs")
    links = stable(_checked(first, nodes, percent), "links")
    group = components(links)

    named = posted.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("gram")
    open_ = stable(named.join(mixed, "gram", "left_semi"), "open-prefixes")
    second = (open_.alias("x").join(open_.alias("y"), "gram")
              .where((F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & may("x", "y"))
              .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
              .join(first, ["a", "b"], "left_anti"))
    more = stable(_checked(second, nodes, percent), "links")
    if not more.isEmpty():
        group = components(links.unionByName(more))

    named_sets = sets.select("doc_id", *key).join(classes.select(*key, "node"), key, "left")
    out = named_sets.join(group, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text and any columns) with the document of the smallest id of every group.

    A document is an id and a text here: texts of one id are dropped only if they are linked, and of
    rows with the same id and text one stays.  Rows with a NULL id stay.
    """
    rows = Positional(docs)
    key = F.when(F.col(rows.id).isNotNull(), F.xxhash64(F.col(rows.id).cast("long"), F.coalesce(F.col(rows.text).cast("string"), F.lit(""))))
    keyed = rows.df.withColumn("_key", key)
    ids = keyed.where("_key is not null").select("_key", F.col(rows.id).cast("long").alias("_id")).distinct()
    groups = similar_documents(keyed, n, percent, "_key", rows.text).where("doc_id is not null").select(F.col("doc_id").alias("_key"), "component_id").distinct()
    mixed = groups.groupBy("component_id").count().where("count > 1").select("component_id")
    members = stable(groups.join(mixed, "component_id", "left_semi").join(ids, "_key"), "group-members")
    first = members.groupBy("component_id").agg(F.min(F.struct("_id", "_key")).alias("_first"))
    losers = members.join(first, "component_id").where(F.struct("_id", "_key") != F.col("_first")).select("_id", "_key")
    kept = (keyed.where("_key is not null").withColumn("_id", F.col(rows.id).cast("long"))
            .join(losers, ["_id", "_key"], "left_anti").dropDuplicates(["_id", "_key"]))
    return rows.restore(kept).unionByName(rows.restore(rows.df.where(F.col(rows.id).isNull())))
