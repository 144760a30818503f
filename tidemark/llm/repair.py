"""Conversation repair: faults of messages, and the cheapest edits to a well-formed dialogue.

1. Equal messages of a conversation become one row with a count, and get a place in one global
   order of (conversation, turn, role, digest of the text).  Texts stay behind.
2. Units of consecutive places are tasks of even size, however long a conversation is.  A unit cuts
   its rows into lanes of one conversation each; a lane is a cost matrix and its counts.
3. The lanes of a conversation meet as one short row each: matrices give every lane its cost-to-go.
4. Units solve their lanes (``paths``): for each state that a lane may begin in, its audit and exit.
5. The lanes meet again and choose their audits from the first state on.
6. Texts and audits are sorted by conversation and read as a stream into one digest each.

A hot conversation is many units and one row per ``LANE`` messages in steps 3 and 5 (less than
the audit string in its result).  Only its digest is made by one task, because SHA-256 reads in order; that
task holds one batch of rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ready
from tidemark.llm.order import ranked
from tidemark.llm.paths import AT_END, INITIALS, LETTERS, NEXT, NONE, TAILS, entries, least, matrices
from tidemark.session import stable

UNIT, LANE = 1 << 16, 1 << 10
#: Rows that one task of steps 3 and 5 takes on average.
GROUP_ROWS = 200_000
#: Fixed values.
BLANK_TEXT = " "
WHITE = r" \u0009\u000a\u000b\u000c\u000d"
ROLES = {1: "user", 2: "assistant"}
KEYS = ["known", "conv"]
#: Pairs of initials that may follow each other, as 4 * first + second.
LEGAL = np.array([4 * INITIALS[a] + INITIALS[b] for a, b in ("su", "ua", "au")])


def digest_key() -> Column:
    """CRC-32 of ``conv_id:turn``; a NULL is one space."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    return F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary"))


def damage(messages: DataFrame) -> DataFrame:
    """Messages with planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it
    the user's.  A NULL role or text is one space before that.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           *(F.coalesce(F.col(c).cast("string"), F.lit(BLANK_TEXT)).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("_kind", digest_key() % 20).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_n")).drop("_n")


def _turns(messages: DataFrame) -> DataFrame:
    """Distinct messages with their number of copies, and what a fault depends on."""
    rows = messages.select(
        F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(BLANK_TEXT)).alias(c) for c in ("role", "text")))
    rows = rows.groupBy(*KEYS, "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    end = F.expr(f"right(trim(trailing '{WHITE}' from text), 1)")
    first = F.substring("role", 1, 1)
    initial = F.lit(3)
    for letter, code in INITIALS.items():
        initial = F.when(first == letter, code).otherwise(initial)
    return (rows.withColumn("mark", F.sha2("text", 256)).withColumn("initial", initial.cast("int"))
            .withColumn("end", end).select("*", (F.col("end") == "").alias("blank"), (~F.col("end").isin(".", "!", "?")).alias("cut")).drop("end"))


def _flagged(turns: DataFrame) -> DataFrame:
    """Places and faults of the distinct messages, without their texts."""
    placed = ranked(turns.select(*KEYS, "turn", "role", "mark", "copies", "initial", "blank", "cut"), [], [*KEYS, "turn", "role", "mark"]).drop("n")
    firsts = placed.groupBy(*KEYS, "role", "mark").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    rows = placed.join(firsts, "at", "left")
    again = ~F.col("blank") & F.col("first").isNull()
    return stable(rows.select("*", again.alias("again"), F.floor(F.col("at") / UNIT).alias("unit")).drop("first"), "message-flags")


def _column(t: pa.Table, name: str, fill=0) -> np.ndarray:
    return t.column(name).combine_chunks().fill_null(fill).to_numpy(zero_copy_only=False)


class _Unit:
    """The rows of a unit in order, cut into lanes."""

    def __init__(self, table: pa.Table):
        self.table = t = table.sort_by("at")
        n = t.num_rows
        self.at, self.conv, self.known = _column(t, "at"), _column(t, "conv"), _column(t, "known", False)
        self.new = np.append(True, (self.conv[1:] != self.conv[:-1]) | (self.known[1:] != self.known[:-1]))[:n]
        begin = np.maximum.accumulate(np.where(self.new, np.arange(n), 0))
        self.head = (np.arange(n) - begin) % LANE == 0
        self.starts = np.flatnonzero(self.head)
        self.lane = np.cumsum(self.head) - 1
        self.initial, self.copies = _column(t, "initial").astype(np.int64), _column(t, "copies")
        self.blank, self.again, self.cut = (_column(t, c, False).astype(bool) for c in ("blank", "again", "cut"))
        self.entries = entries(self.initial, self.blank | self.again, self.cut & ~self.blank & ~self.again, self.copies, self.lane, len(self.starts))

    def per_lane(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.int64), self.starts)


LANE_ROWS = ("known boolean, conv long, at long, unit long, turn long, role string, mark string, costs array<long>, blank long, duplicate long,"
             " truncated long, illegal long, head int, tail int, turns long, low long, high long")


def _lanes(table: pa.Table) -> pa.Table:
    """One row per lane: its first message's key, cost matrix and counts."""
    u = _Unit(table)
    copies, more = u.copies, u.copies - 1
    pair = np.append(False, ~np.isin(4 * u.initial[:-1] + u.initial[1:], LEGAL)) & ~u.head
    turn_null = u.table.column("turn").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    turn = _column(u.table, "turn")
    fresh = ~turn_null & np.append(True, (turn[1:] != turn[:-1]) | turn_null[:-1] | u.head[1:])
    # NULL turns come first, so a lane's turns ascend from its first that is not NULL
    last = np.append(u.starts[1:], len(u.lane)) - 1
    first_known = np.minimum(u.starts + u.per_lane(turn_null), last)
    keys = u.table.take(pa.array(u.starts)).select(["known", "conv", "at", "unit", "turn", "role", "mark"])
    m = matrices(u.entries).reshape(-1, 16)
    out = {
        "costs": pa.array(list(m), pa.list_(pa.int64())),
        "blank": u.per_lane(u.blank * copies),
        "duplicate": u.per_lane(np.where(u.blank, 0, more + u.again)),
        "truncated": u.per_lane(u.cut & ~u.blank & ~u.again),
        "illegal": u.per_lane(pair + more),
        "head": u.initial[u.starts].astype(np.int32), "tail": u.initial[last].astype(np.int32),
        "turns": u.per_lane(fresh),
        "low": pa.array(turn[first_known], mask=turn_null[last]), "high": pa.array(turn[last], mask=turn_null[last])}
    for name, values in out.items():
        keys = keys.append_column(name, values if isinstance(values, pa.Array) else pa.array(values))
    return keys


def _conversations(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Lanes sorted by conversation and place; which ones begin a conversation, and their number from its end."""
    t = table.sort_by([("known", "ascending"), ("conv", "ascending"), ("at", "ascending")])
    conv, known = _column(t, "conv"), _column(t, "known", False)
    new = np.append(True, (conv[1:] != conv[:-1]) | (known[1:] != known[:-1]))[:len(conv)]
    ends = np.append(np.flatnonzero(new)[1:], len(conv))
    from_end = np.repeat(ends, np.diff(np.append(np.flatnonzero(new), len(conv)))) - 1 - np.arange(len(conv))
    return t, new, from_end


TOGO = ("known boolean, conv long, at long, unit long, goal array<long>, first boolean, cost long, gaps long, blank long, duplicate long, truncated long,"
        " illegal long")


def _costs_to_go(table: pa.Table) -> pa.Table:
    """Every lane's cost-to-go at its end; on a conversation's first lane also its cost and counts."""
    t, new, from_end = _conversations(table)
    m = np.stack(t.column("costs").combine_chunks().flatten().to_numpy().reshape(-1, 4, 4)) if t.num_rows else np.zeros((0, 4, 4), np.int64)
    goal = np.tile(AT_END, (len(new), 1))
    order = np.argsort(from_end, kind="stable")
    edges = np.searchsorted(from_end[order], np.arange(int(from_end.max(initial=-1)) + 2))
    for a, b in zip(edges[1:], edges[2:]):  # all lanes that are k-th from their conversation's end
        i = order[a:b]
        goal[i] = (m[i + 1] + goal[i + 1][:, None, :]).min(axis=2)
    starts = np.flatnonzero(new)

    def total(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(new), np.int64)
        out[starts] = np.add.reduceat(x, starts)
        return out
    count = {c: total(_column(t, c)) for c in ("blank", "duplicate", "truncated")}
    head, tail = _column(t, "head"), _column(t, "tail")
    joint = np.append(False, ~np.isin(4 * tail[:-1] + head[1:], LEGAL)) & ~new
    low, high = _column(t, "low"), _column(t, "high")
    known_turn = t.column("low").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    shared = np.append(False, known_turn[:-1] & known_turn[1:] & (high[:-1] == low[1:])) & ~new
    distinct = total(_column(t, "turns") - shared)
    big = np.iinfo(np.int64)
    least_turn, most_turn = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
    least_turn[starts] = np.minimum.reduceat(np.where(known_turn, low, big.max), starts)
    most_turn[starts] = np.maximum.reduceat(np.where(known_turn, high, big.min), starts)
    gaps = np.where(distinct > 0, most_turn - least_turn + 1 - distinct, 0)
    cost = (m[:, NONE, :] + goal).min(axis=1)
    out = t.select(["known", "conv", "at", "unit"])
    for name, values in {"goal": pa.array(list(goal), pa.list_(pa.int64())), "first": new, "cost": cost, "gaps": gaps, **count,
                         "illegal": total(_column(t, "illegal") + joint)}.items():
        out = out.append_column(name, values if isinstance(values, pa.Array) else pa.array(values))
    return out


OPTIONS = "known boolean, conv long, at long, state int, exit int, audit string"


def _options(rows: pa.Table, goals: pa.Table) -> pa.Table:
    """The least audit of every lane from each state that it may begin in."""
    u = _Unit(rows)
    g = goals.sort_by("at")
    goal = g.column("goal").combine_chunks().flatten().to_numpy().reshape(-1, 4)
    first = _column(g, "first", False).astype(bool)
    lanes = np.repeat(np.arange(len(first)), np.where(first, 1, 4))
    states = np.concatenate([np.arange(1 if f else 4) for f in first]) if len(first) else np.zeros(0, np.int64)
    found = least(u.entries, goal, lanes, states)
    keys = g.select(["known", "conv", "at"]).take(pa.array(lanes))
    return (keys.append_column("state", pa.array(states.astype(np.int32))).append_column("exit", pa.array(found.exits.astype(np.int32)))
            .append_column("audit", pa.array([a.decode() for a in found.audits], pa.string())))


def _chosen(table: pa.Table) -> pa.Table:
    """Of every lane the option that begins where the lane before it ended; the last one gets the closing inserts."""
    t = table.sort_by([("known", "ascending"), ("conv", "ascending"), ("at", "ascending"), ("state", "ascending")])
    keys = list(zip(t.column("known").to_pylist(), t.column("conv").to_pylist()))
    ats, states, exits = (t.column(c).to_pylist() for c in ("at", "state", "exit"))
    take: list[int] = []
    tails: list[str] = []
    state, now = NONE, None
    for i, key in enumerate(keys):
        if key != now:
            state, now, lane = NONE, key, None
        if ats[i] != lane and states[i] == state:
            take.append(i)
            state, lane = exits[i], ats[i]
            tails.append("")
            if len(tails) > 1 and keys[take[-2]] != key:
                tails[-2] = TAILS[exits[take[-2]]]
    if take:
        tails[-1] = TAILS[exits[take[-1]]]
    out = t.take(pa.array(take, pa.int64()))
    audits = [a + b for a, b in zip(out.column("audit").to_pylist(), tails)]
    return out.select(["known", "conv", "at", "state"]).append_column("audit", pa.array(audits, pa.string()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lanes (kind 0) and messages (kind 1) in, a digest of the repaired text of every conversation out."""
    now, sha, state, letters, at, any_yet = None, None, NONE, b"", 0, False
    done: list[tuple] = []
    insert, delete, keep = LETTERS[1], LETTERS[0], LETTERS[2]

    def say(role: str, text: str) -> None:
        nonlocal any_yet
        sha.update((("\n" if any_yet else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        any_yet = True

    def inserts() -> None:
        nonlocal at, state
        while at < len(letters) and letters[at] == insert:
            state = int(NEXT[state])
            say(ROLES[1 if state == 2 else 2], "")
            at += 1

    for b in batches:
        known, conv, kind, role, text, copies, initial, begin, audit = (c.to_pylist() for c in b.columns)
        for i in range(b.num_rows):
            key = (known[i], conv[i])
            if key != now:
                if now is not None:
                    inserts()
                    done.append((*now, sha.hexdigest()))
                now, sha, any_yet = key, hashlib.sha256(), False
            if kind[i] == 0:
                letters, at, state = audit[i].encode(), 0, begin[i]
                continue
            inserts()
            letter = letters[at]
            at += copies[i]  # the other copies are deleted
            if letter == delete:
                continue
            if letter == keep:
                state = initial[i] + 1
                say(role[i], text[i])
            else:
                state = int(NEXT[state])
                say(ROLES[1 if state == 2 else 2], text[i])
        if done:
            yield _digest_rows(done)
            done = []
    if now is not None:
        inserts()
        yield _digest_rows([(*now, sha.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.string())], names=[*KEYS, "repaired_sha256"])


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repairs(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``messages``: conv_id, turn, role, text; other columns are ignored.  Messages are taken by turn
    (NULL first), then role, then the digest of the text; the columns mean:

    * gaps: turns missing between the least and the greatest, NULL turns aside; 0 without turns.
    * blank (only white space), duplicate (same role and text before), truncated (the last
      character that is no white space is not ``.``, ``!`` or ``?``): each message counts for its first fault.
    * illegal: neighbours whose role initials are not su, ua or au.
    * audit: the initials (Delete, Insert, Keep, Rerole) of the cheapest edits that make the
      initials ``(s?(ua)+)?``, and cost: theirs.  Keep costs 0, rerole and insert 3, delete 4; a
      truncated message that stays costs 3 more; blank and duplicate ones must go.  Of several cheapest the least audit.
    * repaired_sha256: of the repaired ``role:text`` lines.

    A NULL role or text is one space; a NULL conv_id is a conversation of its own; repeated rows
    are duplicates; texts of any length are read whole.  No messages, no rows.
    """
    spark = ready(messages).sparkSession
    turns = stable(_turns(messages), "messages")
    flags = _flagged(turns)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(flags.count() / GROUP_ROWS))

    def by_conversation(df: DataFrame):
        return df.groupBy(F.pmod(F.xxhash64(*KEYS), F.lit(tasks)).alias("_task"))

    needs = flags.select("at", "unit", *KEYS, "turn", "role", "mark", "initial", "copies", "blank", "again", "cut")
    lanes = stable(needs.groupBy("unit").applyInArrow(_lanes, LANE_ROWS), "lanes")
    columns = [c.split()[0] for c in LANE_ROWS.split(", ")]
    goals = stable(by_conversation(lanes.select(*[c for c in columns if c not in ("role", "mark", "turn")])).applyInArrow(_costs_to_go, TOGO), "goals")
    options = (needs.select("at", "unit", *KEYS, "initial", "copies", "blank", "again", "cut").groupBy("unit")
               .cogroup(goals.select(*KEYS, "at", "unit", "goal", "first").groupBy("unit")).applyInArrow(_options, OPTIONS))
    chosen = stable(by_conversation(options).applyInArrow(_chosen, "known boolean, conv long, at long, state int, audit string"), "audits")

    lane_keys = lanes.select(*KEYS, "at", "turn", "role", "mark").join(chosen, [*KEYS, "at"])
    stream = (turns.select(*KEYS, "turn", "role", "mark", F.lit(1).alias("kind"), "text", "copies", "initial",
                           F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("audit"))
              .unionByName(lane_keys.select(*KEYS, "turn", "role", "mark", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"),
                                            F.lit(None).cast("long").alias("copies"), F.lit(None).cast("int").alias("initial"), "state", "audit")))
    stream = stream.repartition(tasks, *KEYS).sortWithinPartitions(*KEYS, "turn", "role", "mark", "kind")
    digests = stream.select(*KEYS, "kind", "role", "text", "copies", "initial", "state", "audit").mapInArrow(_digests, "known boolean, conv long, repaired_sha256 string")
    audits = chosen.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("at", "audit"))).alias("a")).select(
        *KEYS, F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"))
    return (goals.where("first").select(*KEYS, *COUNTS).join(audits, KEYS).join(digests, KEYS)
            .select(F.when(F.col("known"), F.col("conv")).alias("conv_id"), *COUNTS, "audit", "repaired_sha256"))


def damaged_and_repaired(messages: DataFrame) -> DataFrame:
    """``repairs`` of the ``damage`` of ``messages``, one row for every conversation of the input.

    A conversation that lost all its rows has zeros, an empty audit and the digest of nothing.
    """
    found = repairs(damage(messages)).withColumnRenamed("conv_id", "_c")
    every = messages.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
