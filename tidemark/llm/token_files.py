"""Token files: frequency-ranked ids in byte-aligned variable-length coding, and their reader.

An id is written as its rank by frequency over all documents.  Four ranks share a control byte
(two bits each: bytes of the rank less one); control bytes and rank bytes are separate streams, so
the reader looks up four lengths for each control byte in a table and gathers all bytes at once.

Files are Parquet tables written by Spark, so they may be in any store: ``blocks`` (shard, block,
start in the shard, doc_ids, n_ids, control, data) and ``ranks`` (rank, id).  Shards are ranges
of doc_id; documents ascend within and across shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keyed_text, text_blocks
from tidemark.llm.ranges import id_bounds, with_range
from tidemark.llm.tokens import WORD_END, Cuts, encoder, end_each
from tidemark.session import stable

#: Ids of a block, unless one document has more.
BLOCK_IDS = 1_000_000
#: Bytes of the four ranks of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
BLOCKS = "shard int, block int, start long, doc_ids binary, n_ids binary, total long, control binary, data binary"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of non-negative 32-bit integers."""
    ranks = ranks.astype("<u4", copy=False)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[:len(ranks)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The integers back, by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def _tokenize(docs: DataFrame, tokenizer: str, end_id: int, cuts: Cuts) -> DataFrame:
    """doc_id, n, ids (zstd over little-endian 32-bit ids, low half and high half apart)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, press = encoder(tokenizer, cuts), zstandard.ZstdCompressor(level=1)
        for ids, texts in text_blocks(batches):
            flat, counts = end_each(*tok.encode(texts), end_id)
            parts = np.split(flat.astype("<u4", copy=False), np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array([press.compress(_halves(p)) for p in parts], pa.binary())],
                names=["doc_id", "n", "ids"])
    return docs.mapInArrow(run, "doc_id long, n long, ids binary")


def _halves(ids: np.ndarray) -> bytes:
    return (ids & 0xFFFF).astype("<u2").tobytes() + (ids >> 16).astype("<u2").tobytes()


def _whole(packed: bytes, unpress: zstandard.ZstdDecompressor) -> np.ndarray:
    low, high = np.frombuffer(unpress.decompress(packed), "<u2").reshape(2, -1).astype(np.uint32)
    return low | high << 16


def _frequencies(tokens: DataFrame) -> list[tuple[int, int]]:
    """(id, count) of every id that occurs: no more rows than the tokenizer has ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, total = zstandard.ZstdDecompressor(), np.zeros(0, np.int64)
        for b in batches:
            for packed in b.column(0).to_pylist():
                now = np.bincount(_whole(packed, unpress))
                if len(now) > len(total):
                    total = np.pad(total, (0, len(now) - len(total)))
                total[:len(now)] += now
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])
    counted = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [(int(r[0]), int(r[1])) for r in counted.collect()]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shards: int | None = None,
          id_col: str = "doc_id", text_col: str = "text", cuts: Cuts = WORD_END) -> None:
    """Encode all documents and write the files under ``path`` (shared by all executors).

    A NULL text is empty: its document has the end id alone.  NULL doc_ids come first; rows with
    the same doc_id follow each other, in the order of their ids' bytes.  Other columns are
    ignored.  No documents: empty files.
    """
    spark = docs.sparkSession
    tokens = stable(_tokenize(keyed_text(docs, id_col, text_col), tokenizer, end_id, cuts), "tokens")
    ranked = sorted(_frequencies(tokens), key=lambda x: (-x[1], x[0]))
    rank_of = np.zeros(max((i for i, _ in ranked), default=0) + 1, np.uint32)
    for r, (i, _) in enumerate(ranked):
        rank_of[i] = r
    bounds = id_bounds(tokens, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        shard, block, start, held = None, 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            ids = np.concatenate([h[1] for h in held])
            control, data = encode_ranks(rank_of[ids])
            known = np.array([h[0] is not None for h in held], np.uint8)
            row = [shard, block, start, np.array([h[0] or 0 for h in held], "<i8").tobytes() + known.tobytes(),
                   np.array([len(h[1]) for h in held], "<i8").tobytes(), len(ids), control, data]
            block, start, held = block + 1, start + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], names=_NAMES)

        size = 0
        for b in batches:
            for doc, packed, part in zip(*(c.to_pylist() for c in b.columns)):
                ids = _whole(packed, unpress)
                if held and (part != shard or size + len(ids) > BLOCK_IDS):
                    yield flush()
                    size = 0
                if part != shard:
                    shard, block, start = part, 0, 0
                held.append((doc, ids))
                size += len(ids)
        if held:
            yield flush()

    sharded = with_range(tokens.select("doc_id", "ids"), bounds).repartitionById(len(bounds) + 1, "range")
    sharded.sortWithinPartitions("range", "doc_id", "ids").mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(r, i) for r, (i, _) in enumerate(ranked)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")


_NAMES = ["shard", "block", "start", "doc_ids", "n_ids", "total", "control", "data"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array<long>), decoded from the files."""
    ranks = sorted((int(r[0]), int(r[1])) for r in spark.read.parquet(f"{path}/ranks").select("rank", "id").collect())
    ids_of = np.array([i for _, i in ranks], np.uint32)
    blocks = spark.read.parquet(f"{path}/blocks")
    sums = sorted((int(r[0]), int(r[1])) for r in blocks.groupBy("shard").agg(F.sum("total")).collect())  # one row a shard
    base, before = {}, 0
    for shard, total in sums:
        base[shard], before = before, before + total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, _, start, docs, n_ids, total, control, data in zip(*(c.to_pylist() for c in b.columns)):
                n = np.frombuffer(n_ids, "<i8")
                doc_ids, known = np.frombuffer(docs[:8 * len(n)], "<i8"), np.frombuffer(docs[8 * len(n):], np.uint8)
                ids = ids_of[decode_ranks(control, data, total)].astype("<u4", copy=False)
                ends = np.cumsum(n)
                parts = [ids[e - k:e] for e, k in zip(ends.tolist(), n.tolist())]
                cols = [pa.array(doc_ids, mask=known == 0), pa.array(base[shard] + start + ends - n, pa.int64()), pa.array(n, pa.int64()),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return blocks.select(*_NAMES).mapInArrow(run, schema)
