"""A Merkle manifest of a dataset: a tree for each value of a column, and a tree of their roots.

A node is the SHA-256, as hex text, of the concatenated digests of up to ``FAN`` children.  The
leaves of a tree are cut into aligned blocks of ``BLOCK``.  A block keeps each level as one string
of fixed-width digests: runs of children are substrings, the next level is the hashes of the
runs, and a node's siblings are the substrings to its left and right in its run.  The blocks'
own nodes are the leaves of the next round, until a tree has one block; what a block learns from
the rounds above it is one row, joined before its leaves are told apart.

Size: no task sees more than a block or a range of (tree, leaf), so one tree may hold most rows.
A proof grows with the logarithm of the tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ready
from tidemark.llm.order import ranked
from tidemark.session import stable

#: Children of a node, characters of a digest.
FAN, WIDTH = 8, 64
#: Levels that a block holds.
LEVELS = 3
BLOCK = FAN ** LEVELS
RUN = FAN * WIDTH
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TREE = ["_known", "_tree"]


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def fold(node: Column, steps: Column) -> Column:
    """The root that follows from a node and its steps (left and right siblings, level by level)."""
    return F.aggregate(steps, node, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _blocks(nodes: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Blocks of (tree, pos, n, d): runs of every level, and the block's node ``d``.

    While a tree has several nodes (``n`` of them here), a last run of one is hashed too.
    """
    items = F.array_sort(F.collect_list(F.struct("pos", "d", *keep)))
    blocks = (nodes.groupBy(*TREE, "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(items.alias("items"))
              .withColumn("level", F.expr("array_join(transform(items, x -> x.d), '')")))
    for k in range(LEVELS):
        blocks = (blocks
                  .withColumn(f"runs{k}", F.expr(f"transform(sequence(0, (length(level) - 1) div {RUN}), k -> substring(level, int(k) * {RUN} + 1, {RUN}))"))
                  .withColumn("level", F.expr(f"if(n > {FAN ** k}, array_join(transform(runs{k}, r -> sha2(r, 256)), ''), level)")))
    return blocks.withColumnRenamed("level", "d")


def _step(k: int) -> str:
    """SQL of the step of item ``i`` at level ``k`` of its block; none once the tree has one node."""
    node = f"(i div {FAN ** k})"
    run = f"runs{k}[int({node} div {FAN})]"
    at = f"int({node} % {FAN}) * {WIDTH}"
    return (f"if(n > {FAN ** k}, array(named_struct('left', substring({run}, 1, {at}), 'right', substring({run}, {at} + {WIDTH + 1}, {RUN}))),"
            " cast(array() as array<struct<left:string,right:string>>))")


def _rounds(nodes: DataFrame, most: int, keep: Sequence[str] = ()) -> list[DataFrame]:
    """Blocks of the leaves, of the blocks' nodes, and so on; ``most``: nodes of the largest tree."""
    rounds = [stable(_blocks(nodes, keep), "merkle")]
    while most > BLOCK:
        parents = rounds[-1].select(*TREE, F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), "d")
        rounds.append(stable(_blocks(parents, ()), "merkle"))
        most = -(-most // BLOCK)
    return rounds


def _down(rounds: list[DataFrame], tops: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """tree, pos, d, ``keep``, ``names`` and steps of every leaf; ``tops``: tree, steps above its root and ``names``."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        own = keep if blocks is rounds[0] else ()
        steps = ", ".join(_step(k) for k in range(LEVELS))
        fields = "".join(f", '{c}', x.{c}" for c in ("pos", "d", *own))
        rows = F.expr(f"transform(items, (x, i) -> named_struct('steps', concat({steps}, above){fields}))")
        found = blocks.join(above, [*TREE, "block"]).select(*TREE, *names, F.inline(rows))
        above = found.select(*TREE, F.col("pos").alias("block"), F.col("steps").alias("above"), *names)
    return found


def _placed(leaves: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Leaves with ``pos`` in their tree and its size ``n``; the size of the largest tree."""
    placed = ranked(leaves, TREE, order, "pos")
    return placed, (placed.agg(F.max("n")).first()[0] or 0)


def manifest(leaves: DataFrame, by: str, order: str, digest_col: str = "leaf", keep: Sequence[str] = ()) -> DataFrame:
    """One row per leaf: ``by``, ``order``, position, leaf, ``keep``, steps, subroot, root.

    ``leaves`` has a digest per row.  Rows with equal ``by`` are one tree, NULL too; its leaves
    ascend by ``order`` (NULLs first, ties by the digest, so repeated rows are leaves of their own).
    The root is of the tree of all subroots, ordered by ``by`` (NULL first, then by bytes).
    ``steps`` is an array of (left, right): the digests beside the node in its run, level by level
    from the leaf via the subroot to the root; ``fold(leaf, steps)`` is the root.

    A tree with one leaf has it as its subroot, a single tree's subroot is the root, and without
    leaves there are no rows.  Columns that are not named here are ignored.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    rows = ready(leaves).select(
        F.col(by).isNotNull().alias("_known"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("_tree"),
        F.col(order).alias("_order"), F.col(digest_col).alias("d"), *[F.col(c).alias(k) for c, k in zip(keep, names)])
    own = ["_order", *names]
    trees = _rounds(*_placed(rows, ["_order", "d"]), own)
    roots = trees[-1].select(F.lit(True).alias("_known"), F.lit("").alias("_tree"),
                             F.col("_known").alias("_o1"), F.col("_tree").alias("_o2"), "d")
    top = _rounds(*_placed(roots, ["_o1", "_o2"]), ["_o1", "_o2"])
    none = F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("above")
    subroots = _down(top, top[-1].select(*TREE, none, F.col("d").alias("root")), ["root"], ["_o1", "_o2"])
    tops = subroots.select(F.col("_o1").alias("_known"), F.col("_o2").alias("_tree"), F.col("steps").alias("above"),
                           F.col("d").alias("subroot"), "root")
    return _down(trees, tops, ["subroot", "root"], own).select(
        F.when(F.col("_known"), F.col("_tree")).alias(by), F.col("_order").alias(order), F.col("pos").alias("position"),
        F.col("d").alias(digest_col), *[F.col(k).alias(c) for c, k in zip(keep, names)], "steps", "subroot", "root")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, lang, leaf, and the leaf ``changed`` of the same row with the text's A-Z lower-cased where ``tampered``.

    A NULL text stays NULL; a NULL in ``tampered`` is false.
    """
    rows = docs.select(*(F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS),
                       F.coalesce(tampered, F.lit(False)).alias("_t"))
    lower = leaf(*(F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS))
    own = leaf(*map(F.col, FIELDS))
    return rows.select("doc_id", "lang", own.alias("leaf"), F.when(F.col("_t"), lower).alias("changed"))


def verified_documents(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of ``docs``, and the root folded from the tampered copy.

    ``folded_root`` follows from the leaf of the tampered row and the siblings of the original
    one; ``verified`` says that it is the root.  A row with a NULL id is a leaf like others and is
    not tampered with.  Repeated rows are leaves of their own; no rows, no result.
    """
    rows = manifest(document_leaves(docs, tampered), "lang", "doc_id", keep=("changed",))
    folded = fold(F.coalesce("changed", "leaf"), F.col("steps"))
    return (rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
