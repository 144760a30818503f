"""Log probabilities of texts: a word-count base, and a causal attention model on subword ids.

1. Texts are read once.  Words are numbered by the worker, so a known word costs one look-up for
   its subword ids and its hash.  Written to the shared folder: per text its ids and the places of
   its words in its block's list; per block its distinct words with their training counts.
2. Base.  The word lists go, as packed arrays, to buckets of the word's hash.  A bucket adds up
   and answers every block with the counts of its words.
3. Model (``attention``).  Symbols and their weights come from all training ids.  Every window of
   every training text gives targets, with the window before it as context.  After a start
   on a bounded sample, in each round every task trains its own copy on its share of the round's
   texts, and Spark averages the copies by targets; the rounds cover all training texts.
4. Scoring reads the ids again, window by window, and meets the counts at the block.

Through the driver go the counts of subword ids and the parameters, both bounded by the
tokenizer's vocabulary.  A word has one entry a block in its bucket, however often it occurs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import attention
from tidemark.llm.common import bytes_of, keyed_text, text_blocks
from tidemark.llm.kernels import U, words
from tidemark.llm.tokens import BYTE_LEVEL, Encoder, Numbers, Store, unsure
from tidemark.session import stable

BLOCK = 2_000_000
#: Text bytes for each bucket of word hashes.
BUCKET_BYTES = 24_000_000
#: Words that a worker keeps before its numbering starts anew; bounds memory, not results.
MAX_WORDS = 600_000
#: Fixed values of the base: pseudo-count of a word.
EXTRA = 0.1
#: Eighths of the training texts in each round, and the round's learning rate.
SHARES, RATES = (3, 5), (0.006, 0.002)
#: The start before the rounds, made by one task: at most so many texts and ids, a bounded sample; rate and least steps.
START_TEXTS, START_IDS, START_RATE, START_STEPS = 2000, 2_000_000, 0.012, 500
#: Windows of a step, and ids that are mixed before they are dealt into steps.
STEP, MIX_IDS = 384, 2_000_000
#: Of a training text, every so many-th window gives targets: all of them, each with the window before it as context.
EVERY = 1
#: Windows of the smallest step.
LEAST_STEP = 32
#: Numbers in one row of a model on its way to the average, and models that meet at once.
PIECE, MEET = 4096, 512


class _Words:
    """Word -> number in order of first sight, with the word's hash and its subword ids."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, BYTE_LEVEL)
        self.clear()

    def clear(self) -> None:
        """The encoder keeps its pieces, so a word that comes again is only put together."""
        self.store = Store()
        self.hashes = np.zeros(0, np.uint64)

    @property
    def numbers(self) -> Numbers:
        return self.store.numbers

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts in a row, and how many each text has."""
        if len(self.numbers) > MAX_WORDS:
            self.clear()
        # bytes alone: A-Z and the six characters of white space, 0x20 and 0x09 to 0x0D
        found = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        counts = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = found.flatten().dictionary_encode()
        place, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        # words are numbered in order of first sight, as they are in the dictionary; none stands for the empty one
        none = distinct.index("") if "" in distinct else len(distinct)
        of = np.zeros(len(distinct), np.int64)
        of[:none] = np.fromiter(map(self.numbers.__getitem__, distinct[:none]), np.int64, none)
        of[none + 1:] = np.fromiter(map(self.numbers.__getitem__, distinct[none + 1:]), np.int64)
        if none < len(distinct):  # before or after white space at an end of the text, or the text has no word
            gone = place == none
            counts -= np.bincount(np.repeat(np.arange(len(counts)), counts)[gone], minlength=len(counts))
            place = place[~gone]
        self._learn()
        return of[place], counts

    def _learn(self) -> None:
        """Hashes and subword ids of new words, each with a space before it: those of its pieces in a row."""
        new, self.numbers.new = self.numbers.new, []
        for at in range(0, len(new), 50_000):
            some = new[at:at + 50_000]
            self.hashes = np.concatenate([self.hashes, words(some)[0]])
            odd = unsure("\n".join(some))
            ids, sizes = self.encoder._encode([[" " + w] if odd and unsure(w) else self.encoder.find(" " + w) for w in some])
            self.store._add(ids, np.cumsum(sizes) - sizes, sizes)

    def ids(self, numbers: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of all texts in a row, each text with its end id, and their number per text."""
        flat, sizes = self.store._ids_of(numbers, counts)
        return np.insert(flat.astype(np.uint16), np.cumsum(sizes), np.uint16(end)), sizes + 1


_WORDS: dict[str, _Words] = {}

READ = [("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()),
        ("words", pa.binary()), ("ids", pa.binary()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()),
        ("tokens", pa.list_(pa.int32())), ("uses", pa.list_(pa.int64()))]
READ_SCHEMA = ("kind int, part int, block long, place int, doc_id long, held_out boolean, words binary, ids binary, bucket long, hashes binary,"
               " counts binary, tokens array<int>, uses array<long>")
TEXT, LIST, USES = range(3)


def _rows(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def _read(path: str, end: int, buckets: int):
    """(key, text) rows, a key of doc_id and held_out, to rows of texts, word lists and subword counts; ``part`` of a text is its round, -1 if held out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORDS:
            _WORDS[path] = _Words(path)
        known, task = _WORDS[path], TaskContext.get().partitionId()
        number = 0
        rounds = np.repeat(np.arange(len(SHARES)), SHARES)
        for ids, texts in text_blocks(batches, BLOCK):
            block, number = (task << 32) | number, number + 1
            docs, held = [k["doc_id"] for k in ids], np.array([k["held_out"] for k in ids])
            numbers, counts = known.number(texts)
            here = np.zeros(len(known.numbers), bool)
            here[numbers] = True
            uniq = np.flatnonzero(here)
            place = (np.cumsum(here) - 1)[numbers]
            train = np.repeat(~held, counts)
            uses = np.bincount(place[train], minlength=len(uniq))
            hashes = known.hashes[uniq]
            bucket = ((hashes >> U(33)) % U(buckets)).astype(np.int64)
            order = np.lexsort((-uses, bucket))
            at = np.empty(len(uniq), np.int32)
            at[order] = np.arange(len(uniq))
            place = at[place].astype("<i4")
            flat, sizes = known.ids(numbers, counts, end)
            tokens = np.bincount(flat[np.repeat(~held, sizes)], minlength=1)
            seen = np.flatnonzero(tokens)
            out: list[tuple] = [(USES, -1, block, None, None, None, None, None, None, None, None, seen, tokens[seen])]
            bucket, hashes, uses = bucket[order], hashes[order], uses[order].astype("<i4")
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else [], len(bucket)).astype(int)
            out += [(LIST, -1, block, None, None, None, None, None, int(bucket[a]), hashes[a:b].tobytes(), uses[a:b].tobytes(), None, None)
                    for a, b in zip(cuts, cuts[1:])]
            w = np.concatenate([[0], np.cumsum(counts)])
            t = np.concatenate([[0], np.cumsum(sizes)])
            flat = flat.astype("<u2")
            out += [(TEXT, -1 if held[i] else int(rounds[i % len(rounds)]), block, i, docs[i], bool(held[i]), place[w[i]:w[i + 1]].tobytes(),
                     flat[t[i]:t[i + 1]].tobytes(), None, None, None, None, None) for i in range(len(texts))]
            for a in range(0, len(out), 2000):
                yield _rows(out[a:a + 2000], READ)
    return run


def _count(table: pa.Table) -> pa.Table:
    """Word lists of a bucket: for every block the training counts of its words, and the bucket's totals (block -1)."""
    hashes = [np.frombuffer(h, "<u8") for h in table.column("hashes").to_pylist()]
    uses = [np.frombuffer(c, "<i4") for c in table.column("counts").to_pylist()]
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, np.concatenate(uses)).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
    answer = total[place]
    width = "<u4" if total.max(initial=0) < 1 << 32 else "<u8"
    rows = [(b, k, width[2].encode() + answer[a:z].astype(width).tobytes(), None, None) for b, k, a, z in
            zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), cuts, cuts[1:])]
    rows.append((-1, None, None, int(total.sum()), int((total > 0).sum())))
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([r[1] for r in rows], pa.int64()),
                     "answer": pa.array([r[2] for r in rows], pa.binary()), "uses": pa.array([r[3] for r in rows], pa.int64()),
                     "distinct": pa.array([r[4] for r in rows], pa.int64())})


class Symbols:
    """The subword ids of the training texts as symbols in the order of their text, and one more for all other ids."""

    def __init__(self, path: str, uses: dict[int, int], end: int):
        tokenizer = Encoder(path, BYTE_LEVEL).tokenizer
        names = {i: tokenizer.id_to_token(i) or "" for i in uses}
        seen = sorted(uses, key=lambda i: (names[i], i))
        size = max(tokenizer.get_vocab_size(), end + 1, *(i + 1 for i in uses), 1)
        self.of = np.full(1 << 16, len(seen), np.uint16)
        self.of[seen] = np.arange(len(seen))
        self.weight = np.array([uses[i] for i in seen] + [1.0])
        self.begin = int(self.of[end])
        #: log of the number of ids that share the last symbol
        self.others = math.log(max(1, size - len(seen)))


def _texts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of several texts in a row and their numbers, about ``limit`` ids at a time."""
    have: list[np.ndarray] = []
    size = 0
    for b in batches:
        for raw in b.column(0):
            ids = np.frombuffer(raw.as_buffer(), "<u2")
            have.append(ids)
            size += len(ids)
            if size >= limit:
                yield np.concatenate(have), np.array([len(h) for h in have])
                have, size = [], 0
    if have:
        yield np.concatenate(have), np.array([len(h) for h in have])


def _train(params: dict[str, np.ndarray], starts: np.ndarray, of: np.ndarray, begin: int, rate: float, steps: int = 0, most: int | None = None):
    """A task's texts (to about ``most`` ids) to its trained copy of the parameters; they are gone over again until ``steps`` steps are made."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.one_thread()
        mine = {k: v.copy() for k, v in params.items()}
        adam, rng, targets = attention.Adam(mine), np.random.default_rng(5), 0
        for ids, counts in _texts(batches, most or MIX_IDS):
            w = attention.Windows.cut(of[ids], counts, begin)
            pairs = w.every(EVERY)
            step = min(STEP, max(LEAST_STEP, len(pairs) // max(steps, 8)))
            while True:
                pairs = rng.permutation(pairs)
                for a in range(0, len(pairs), step):
                    done = attention.Pass(mine, starts, w, pairs[a:a + step])
                    adam.apply(done.gradients(), rate)
                    targets += len(done.targets)
                if adam.step >= steps:
                    break
            if most:
                break
        if targets:
            flat = np.concatenate([v.ravel() for v in mine.values()]).astype("<f4")
            part = TaskContext.get().partitionId()
            for i, a in enumerate(range(0, len(flat), PIECE)):
                yield _rows([(i, part % MEET, targets, flat[a:a + PIECE].tobytes())], MODEL)
    return run


MODEL = [("piece", pa.int32()), ("deal", pa.int32()), ("targets", pa.int64()), ("numbers", pa.binary())]
MODEL_SCHEMA = "piece int, deal int, targets long, numbers binary"


def _average(table: pa.Table) -> pa.Table:
    """Average of some models' piece by their targets."""
    targets = table.column("targets").to_numpy()
    total, share = 0.0, targets / targets.sum()
    for s, raw in zip(share, table.column("numbers").to_pylist()):
        total = total + s * np.frombuffer(raw, "<f4").astype(np.float64)
    return pa.table({"piece": table.column("piece").slice(0, 1), "deal": table.column("deal").slice(0, 1),
                     "targets": pa.array([int(targets.sum())]), "numbers": pa.array([total.astype("<f4").tobytes()], pa.binary())},
                    schema=pa.schema(MODEL))


def _fit(read: DataFrame, symbols: Symbols) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Parameters after all rounds, and the symbols' groups."""
    starts = attention.balanced(symbols.weight)
    params = attention.initial(starts, symbols.weight)
    texts = read.where((F.col("kind") == TEXT) & (F.col("part") >= 0))
    few = texts.select("ids", F.xxhash64("block", "place").alias("_h"), "block", "place").orderBy("_h", "block", "place").limit(START_TEXTS).select("ids")
    first = few.mapInArrow(_train(params, starts, symbols.of, symbols.begin, START_RATE, START_STEPS, START_IDS), MODEL_SCHEMA)
    rounds = [texts.where(F.col("part") == part).select("ids") for part in range(len(RATES))]
    for part, rate in enumerate([None, *RATES]):
        models = first if part == 0 else rounds[part - 1].mapInArrow(_train(params, starts, symbols.of, symbols.begin, rate), MODEL_SCHEMA)
        some = models.groupBy("piece", "deal").applyInArrow(_average, MODEL_SCHEMA)
        got = some.groupBy("piece").applyInArrow(_average, MODEL_SCHEMA).select("piece", "numbers").collect()
        if got:
            flat = np.concatenate([np.frombuffer(r[1], "<f4") for r in sorted(got)])
            at = 0
            for k, v in params.items():
                params[k] = flat[at:at + v.size].reshape(v.shape).copy()
                at += v.size
    return params, starts


SCORED = [("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("words", pa.binary()), ("score", pa.float64())]


def _score(params: dict[str, np.ndarray], starts: np.ndarray, of: np.ndarray, begin: int, others: float):
    last = len(params["embed"]) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.one_thread()
        scorer = attention.Scorer(params, starts)
        for b in batches:
            at = b.schema.get_field_index("ids")
            texts = _texts(iter([pa.RecordBatch.from_arrays([b.column(at)], names=["ids"])]), MIX_IDS)
            scores = []
            for ids, counts in texts:
                symbols = of[ids]
                logs = scorer(attention.Windows.cut(symbols, counts, begin))
                edges = np.concatenate([[0], np.cumsum(symbols == last)])
                ends = np.cumsum(counts)
                scores.append((logs - others * (edges[ends] - edges[ends - counts])) / math.log(10))
            values = np.concatenate(scores) if scores else np.zeros(0)
            keep = [b.column(b.schema.get_field_index(n)) for n, _ in SCORED[:-1]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(values)], names=[n for n, _ in SCORED])
    return run


RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _base(tokens: int, distinct: int, ends: int):
    """Texts and answers of a block to rows of results."""
    low = math.log10(tokens + EXTRA * (distinct + 1))

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        lists = answers.sort_by("bucket").column("answer").to_pylist()
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(a, "<u" + chr(a[0]), offset=1).astype(np.int64) for a in lists)])
        logs = np.log10(counts + EXTRA) - low
        places = [np.frombuffer(w, "<i4") for w in texts.column("words").to_pylist()]
        sizes = np.array([len(p) for p in places], np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *places])
        owner = np.repeat(np.arange(len(places)), sizes)
        base = np.bincount(owner, logs[flat], len(places)) + math.log10(ends + EXTRA) - low
        seen = np.bincount(owner, counts[flat] > 0, len(places)).astype(np.int64) + (ends > 0)
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(sizes + 1),
                         "n_known": pa.array(seen), "train_tokens": pa.array(np.full(len(places), tokens)), "base_score": pa.array(base),
                         "score": texts.column("score")})
    return run


def score_texts(docs: DataFrame, held_out, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: a condition; texts that meet it are scored and not learned from (a NULL counts as held out).  ``tokenizer``: a
    byte-level BPE file; ``end``: the id that ends a text.  Texts are their words, A-Z lower-cased:
    runs of characters that are no white space; and one end.  ``base_score`` adds log10 of (count +
    0.1) / (train_tokens + 0.1 * (distinct + 1)) over the words and the end, with counts from
    training texts.  ``score`` is the model's log10 probability of the same words and end, as the
    ids of each word with a space before it.

    A NULL or empty text is its end alone.  Repeated rows are learned and scored as often as they
    occur; other columns are ignored.  Without training texts every id is as likely as another.  No rows, no result.
    """
    spark = docs.sparkSession
    keyed = keyed_text(docs, id_col, text_col)
    buckets = max(1, math.ceil(bytes_of(keyed) / BUCKET_BYTES))
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    held = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    cores = spark.sparkContext.defaultParallelism
    if held.rdd.getNumPartitions() < cores:  # few splits, so little text: one row group is one task
        held = held.repartition(cores)
    read = stable(held.mapInArrow(_read(tokenizer, end, buckets), READ_SCHEMA), "lm-texts", "zstd")
    lists = read.where(F.col("kind") == LIST).select("block", "bucket", "hashes", "counts")
    answers = stable(lists.groupBy(F.col("bucket").alias("_b")).applyInArrow(_count, "block long, bucket long, answer binary, uses long, distinct long"), "lm-counts", "zstd")
    uses = {int(r[0]): int(r[1]) for r in read.where(F.col("kind") == USES).select(F.explode(F.arrays_zip("tokens", "uses")).alias("t"))
            .groupBy("t.tokens").agg(F.sum("t.uses")).collect()}  # at most the tokenizer's vocabulary
    total = answers.where("block = -1").agg(F.sum("uses"), F.sum("distinct")).first()
    ends = uses.get(end, 0)
    tokens, distinct = int(total[0] or 0) + ends, int(total[1] or 0) + (ends > 0)
    symbols = Symbols(tokenizer, uses, end)
    params, starts = _fit(read, symbols)
    texts = read.where(F.col("kind") == TEXT).select("block", "place", "doc_id", "held_out", "words", "ids")
    scored = texts.mapInArrow(_score(params, starts, symbols.of, symbols.begin, symbols.others),
                              "block long, place int, doc_id long, held_out boolean, words binary, score double")
    known = answers.where("block >= 0").select("block", "bucket", "answer")
    return scored.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_base(tokens, distinct, ends), RESULT)
