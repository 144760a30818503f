"""Quality scores: random-indexing word vectors, pooled, and a two-layer network on top.

Words (runs of letters, digits or signs) are hashed to ``BUCKETS`` rows.  A row's index vector is
sparse and random; its context vector is the sum of the index vectors of the words up to two
places away, over all documents.  That is one matrix of fixed size, summed by Spark.  A document is
the mean and the deviation of the context vectors of its words.  A two-layer numpy network is
fitted on labelled documents and its logits are divided by a temperature fitted on labelled
documents that it has not seen, so that scores are probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Positional, keyed_text, text_blocks
from tidemark.llm.kernels import U, mix, words

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 32, 2, 2
#: The bound of the fit: at most so many labelled documents, those with the smallest hash of the id.
LABELLED = 20_000
HIDDEN, ROUNDS, RATE, DECAY = 32, 400, 0.01, 1e-4
BLOCK = 1_000_000
SLICE = 200_000


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places (BUCKETS x NONZERO) and signs of the nonzero entries of every index vector."""
    h = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(17)).reshape(BUCKETS, NONZERO)
    return (h % U(DIM)).astype(np.int64), np.where((h >> U(40)) & U(1), 1.0, -1.0)


def _buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h, owner = words(texts, by_kind=True)
    return (h >> U(50)).astype(np.int64), owner


def context_sums(texts: list[str], into: np.ndarray) -> None:
    """Add the contexts of all words of the texts to a flat BUCKETS x DIM array."""
    bucket, owner = _buckets(texts)
    place, sign = index_vectors()
    for away in range(1, REACH + 1):
        near = owner[away:] == owner[:-away]
        left, right = bucket[:-away][near], bucket[away:][near]
        for a, b in ((left, right), (right, left)):
            for k in range(NONZERO):
                into += np.bincount(a * DIM + place[b, k], sign[b, k], BUCKETS * DIM)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The unit context vector of every row (BUCKETS x DIM); ``docs`` is (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIM)
        for _, texts in text_blocks(batches, BLOCK):
            context_sums(texts, total)
        rows = total.reshape(BUCKETS, DIM)
        seen = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(rows[seen, d]) for d in range(DIM))],
                                         names=["bucket", *(f"c{d}" for d in range(DIM))])
    schema = "bucket long, " + ", ".join(f"c{d} double" for d in range(DIM))
    sums = docs.mapInArrow(run, schema).groupBy("bucket").agg(*(F.sum(f"c{d}").alias(f"c{d}") for d in range(DIM)))
    table = np.zeros((BUCKETS, DIM), np.float32)
    got = sums.toPandas()  # at most BUCKETS rows
    if len(got):
        rows = got[[f"c{d}" for d in range(DIM)]].to_numpy()
        table[got["bucket"].to_numpy()] = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return table


def pooled(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Mean and deviation of the vectors of each text's words; zeros without words."""
    bucket, owner = _buckets(texts)
    sums, squares = np.zeros((len(texts), DIM)), np.zeros((len(texts), DIM))
    for at in range(0, len(bucket), SLICE):
        vectors, who = table[bucket[at:at + SLICE]], owner[at:at + SLICE]
        opens = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        sums[who[opens]] += np.add.reduceat(vectors, opens, axis=0)
        squares[who[opens]] += np.add.reduceat(vectors * vectors, opens, axis=0)
    n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None]
    mean = sums / n
    return np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean * mean, 0))], axis=1)


@dataclass
class Network:
    """Inputs are standardized, then tanh, then one logit; the score is sigmoid(logit / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray, check: np.ndarray) -> Network:
    """Fit on rows where ``check`` is false, the temperature on the others.  No rows: every score is 0.5."""
    rng = np.random.default_rng(1)
    width = x.shape[1]
    net = Network(x[~check].mean(axis=0) if (~check).any() else np.zeros(width),
                  np.maximum(x[~check].std(axis=0), 1e-6) if (~check).any() else np.ones(width),
                  rng.normal(0, width ** -0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if not (~check).any():
        return net
    a, t = (x[~check] - net.mean) / net.scale, y[~check]
    net.b2 = float(np.log((t.mean() + 1e-3) / (1 - t.mean() + 1e-3)))
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, ROUNDS + 1):
        h = np.tanh(a @ params[0] + params[1])
        off = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - t) / len(t)
        back = np.outer(off, params[2]) * (1 - h * h)
        grads = [a.T @ back + DECAY * params[0], back.sum(axis=0), h.T @ off + DECAY * params[2], np.array([off.sum()])]
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if check.any():
        logits = net.logits(x[check])
        net.temperature = float(min(np.geomspace(0.25, 8, 41), key=lambda s: _loss(logits / s, y[check])))
    return net


def id_hash(col: str = "doc_id"):
    """crc32 of the id as text; 0 for a NULL id."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(0).cast("long"))


def fit_model(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Callable[[list], np.ndarray]:
    """Word vectors from all of ``docs`` and a network from the labelled ones: a function from texts to scores."""
    keyed = keyed_text(docs, id_col, text_col)
    table = context_vectors(keyed)
    known = (labels.select(F.col("doc_id").cast("long").alias("_d"), F.col("quality").cast("double").alias("_y")).dropna()
             .groupBy("_d").agg(F.avg("_y").alias("_y")).orderBy(F.xxhash64("_d"), "_d").limit(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches, BLOCK):
            x = pooled(texts, table).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "x"])

    mine = keyed.join(F.broadcast(known), F.col("doc_id") == F.col("_d"), "left_semi")  # at most ``labelled`` ids
    train = mine.mapInArrow(run, "doc_id long, x array<float>").join(F.broadcast(known), F.col("doc_id") == F.col("_d"))
    train = train.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("_y").alias("y"))  # one row an id
    got = train.select("x", "y", (F.floor(id_hash() / 3) % 5 == 0).alias("check"), "doc_id").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(-1, 2 * DIM)
    net = fit(x, got["y"].to_numpy(float), got["check"].to_numpy(bool))
    return lambda texts: net.score(pooled([t or "" for t in texts], table))


def score_documents(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``.

    ``labels``: doc_id and quality (0 or 1) of the rows to learn from; rows with a NULL are left out
    and an id with both values counts as one half.  At most ``labelled`` of them are used for the
    fit; word statistics and scores cover all documents.  Every fifth labelled id sets the
    temperature.  A NULL or empty text has the score of a document without words; without labels
    every score is 0.5.  Repeated rows are scored alike; other columns are ignored.
    """
    score = fit_model(docs, labels, labelled, id_col, text_col)
    scored = Positional(keyed_text(docs, id_col, text_col)).with_value("score", "double", lambda _, texts: pa.array(score(texts)))
    return scored.select(F.col("c0").alias("doc_id"), "score")


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, labelled: int = LABELLED) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``."""
    score, rows = fit_model(docs, labels, labelled), Positional(docs)
    scored = rows.with_value("score", "double", lambda _, texts: pa.array(score(texts)))
    return rows.restore(scored.where(F.col("score") >= least))
