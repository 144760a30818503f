"""Multi-party perspective rotation: the same dialogue once for every participant.

From a participant's perspective their own messages are the assistant's, other speakers are
users with a name, and the mask marks the characters the assistant wrote.  DataFrame functions
only.

Size: a dialogue is one text per perspective, stored in parts of ``turns_per_part`` turn numbers,
so a conversation that holds a third of all rows is many groups.  Parts joined in order are the
whole text; offsets count from its beginning, from running sums of the parts' lengths, which are
one short row for each part.  Repeated rows meet in map-side sets, not in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rendered form.
SYSTEM, UNKNOWN = "system", "unknown"
END = "<|end|>\n"
TURNS_PER_PART = 64


def _head(role: Column, perspective: Column) -> Column:
    return (F.when(role == SYSTEM, F.lit("<|system|>\n"))
            .when(role == perspective, F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n"))))


def perspectives(messages: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """One row per conversation, participant and part of the dialogue's text.

    ``messages``: conv_id, turn, role, text; other columns are ignored.  Result: conv_id,
    perspective, part, start (characters before this part), n_messages, text, spans (array of start
    and end, in characters of the whole text, of what this participant said; start included, end not).

    * Participants are all roles but ``system``, whose messages are system messages for everyone;
      a conversation of system messages alone has no participant and no row.
    * A NULL or empty role is the speaker ``unknown``; a NULL text is empty; a NULL conv_id is a
      conversation of its own.  A NULL turn comes first, in part -1.
    * Messages are ordered by turn, then role, then text; a repeated row counts once.
    * Part k holds turns k * turns_per_part up to the next part; every participant of the
      conversation gets every part, with no span where they were silent.  ``turns_per_part`` only
      says how the text is stored: the parts' texts in a row, and their spans, do not depend on it.
    * No message, no rows.
    """
    m = messages.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.when(F.col("role") != "", F.col("role")), F.lit(UNKNOWN)).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    m = m.withColumn("part", F.coalesce(F.floor(F.col("turn") / turns_per_part), F.lit(-1)).cast("long"))
    parts = m.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("said"))
    # a NULL turn sorts last in arrays, but then it has a part of its own
    people = m.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective")).distinct()
    rows = parts.join(people, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")

    def size(x: Column) -> Column:
        return F.length(_head(x["role"], F.col("perspective"))) + F.length(x["text"]) + F.lit(len(END))
    # the lengths alone meet by dialogue, texts do not
    sizes = rows.select("conv_id", "perspective", "part", F.aggregate("said", F.lit(0).cast("long"), lambda n, x: n + size(x)).alias("_size"))
    order = Window.partitionBy("conv_id", "perspective").orderBy("part")
    starts = sizes.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("part").alias("_n"),
                          (F.sum("_size").over(order) - F.col("_size")).alias("start"))
    rows = rows.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("part") == F.col("_n"))).drop("_c", "_p", "_n")

    def segment(x: Column) -> Column:
        head = _head(x["role"], F.col("perspective"))
        return F.struct(F.concat(head, x["text"], F.lit(END)).alias("all"), F.length(head).alias("head"),
                        F.length(x["text"]).alias("body"), (x["role"] == F.col("perspective")).alias("own"))

    spans_type = "array<struct<start:bigint,end:bigint>>"

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["head"]
        own = F.array(F.struct(start.alias("start"), (start + s["body"]).alias("end")))
        return F.struct((acc["at"] + F.length(s["all"])).alias("at"),
                        F.when(s["own"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).cast(spans_type).alias("spans"))

    zero = F.struct(F.col("start").alias("at"), F.array().cast(spans_type).alias("spans"))
    rows = rows.withColumn("segments", F.transform("said", segment))
    return rows.select(
        "conv_id", "perspective", "part", "start", F.size("said").cast("long").alias("n_messages"),
        F.concat_ws("", F.transform("segments", lambda s: s["all"])).alias("text"),
        F.aggregate("segments", zero, step, lambda acc: acc["spans"]).alias("spans"))
