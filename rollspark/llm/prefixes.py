"""Trie of the conversations' prefixes, with totals of its subtrees rolled up in bands of depth.

A node is a distinct sequence of the first d turns (role and text) of a conversation; the
root, d = 0, is the empty one. Its members are the conversations that begin with it.

A node's identity is a sum over its turns of hashes keyed by the turn's position, so
prefixes of a conversation are running sums: a conversation is cut into blocks of
``BLOCK`` turns, blocks are summed first and then the turns inside each, so no task
holds a whole conversation. (Four sums of 32 bits of two XXH64 each.)

Totals of subtrees go up by bands of ``BAND`` levels. A row of a turn carries the ids
of the turns above it in its band and that of the band's anchor, the node right above. Within a
band a node adds its own number to each of those, at most ``BAND`` rows for a node,
however deep it is. A band's lowest level is the next band's anchors: it
adds not its own number but the total of its whole subtree. Those totals come from the
tree of anchors alone, which has a ``BAND``-th of the levels, in the same way. So there
are log(depth) rounds to base ``BAND``, not one for each level or band.

Turns are ordered by turn, null first, those of an equal number by hashes of role and
text; null role or text is empty. Rows without a conversation id belong to no conversation and are left out.
Repeated rows are turns of their own. No rows give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollspark.llm.common import attach, store
from rollspark.operators.skew import group_ordinal

BAND = 16
BLOCK = BAND**3
SHARED = 100  # fixed value: a conversation begins with turns of the last one divisible by it
MOST = 6  # fixed value: it takes fewer than this many
PIECE_BITS = 12  # of the conversation ids that are joined at once
FIRST = -(1 << 63)
SUMS = ["_s0", "_s1", "_s2", "_s3"]


def ordered(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, pos (from 1), two hashes of role and text, and chars of each turn. Texts go no further."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    hashes = [F.xxhash64(F.lit(seed), role, F.length(role), text).alias(name) for seed, name in ((1, "h1"), (2, "h2"))]
    rows = turns.filter(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("long").alias("conv_id"),
        F.coalesce(F.col(turn).cast("long"), F.lit(FIRST)).alias("_turn"),
        F.col(turn).isNotNull().alias("_has_turn"),
        *hashes,
        F.length(text).cast("long").alias("chars"),
    )
    placed = group_ordinal(rows, ["conv_id"], "_turn", "pos", ties=["_has_turn", "h1", "h2"])
    return placed.select("conv_id", (F.col("pos") + 1).alias("pos"), "h1", "h2", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored turns with their first turns exchanged for those of the shared conversation, and the ids of all conversations.

    A conversation may have no turn in the first table.
    """
    lengths = store(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_len")), "prefix-lengths")
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(MOST)).alias("_h")
    base = (F.col("conv_id") - F.col("conv_id") % SHARED).alias("_base")
    talks = lengths.select("conv_id", base, taken)
    bases = lengths.filter(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("_base"), F.col("_len").alias("_base_len"))
    talks = talks.join(bases, "_base", "left").withColumn("_got", F.least("_h", F.coalesce("_base_len", F.lit(0))))
    talks = store(talks.select("conv_id", "_base", "_h", "_got"), "prefix-talks")
    first = turns.filter((F.col("conv_id") % SHARED == 0) & (F.col("pos") < MOST)).withColumnsRenamed({"conv_id": "_base"})
    asked = talks.filter("_got > 0").select("conv_id", "_base", F.explode(F.sequence(F.lit(1).cast("long"), "_got")).alias("pos"))
    heads = asked.join(first, ["_base", "pos"]).select("conv_id", "pos", "h1", "h2", "chars")
    own = turns.join(talks, "conv_id").filter(F.col("pos") > F.col("_h"))
    own = own.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_got")).alias("pos"), "h1", "h2", "chars")
    return heads.unionByName(own), talks.select("conv_id")


def _root() -> Column:
    return F.lit("root").cast("binary")


def _id(sums: list[Column]) -> Column:
    """128 bits of a prefix, from its four sums."""
    return F.unhex(F.md5(F.concat_ws(",", *sums)))


def paths(turns: DataFrame) -> DataFrame:
    """Each rebuilt turn as a step of its conversation's path.

    conv_id, depth, id, parent, chars of its text, last (no turn follows), chain (ids
    above it in its band and its own), anchor.
    """
    keyed = [F.xxhash64(F.lit(seed), "pos", "h1", "h2") for seed in (1, 2)]
    pieces = [piece for h in keyed for piece in (F.shiftrightunsigned(h, 32), h.bitwiseAND(0xFFFFFFFF))]
    block = F.floor((F.col("pos") - 1) / BLOCK).alias("_block")
    rows = store(turns.select("conv_id", "pos", "chars", block, *[p.alias(s) for p, s in zip(pieces, SUMS)]), "prefix-hashes")
    blocks = rows.groupBy("conv_id", "_block").agg(*[F.sum(s).alias(s) for s in SUMS], F.max("pos").alias("_end"))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    before = blocks.select("conv_id", "_block", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}b") for s in SUMS], F.max("_end").over(whole).alias("_end"))
    inside = Window.partitionBy("conv_id", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(store(before, "prefix-blocks"), ["conv_id", "_block"]).select(
        "conv_id", "_block", "pos", "chars", "_end", *[(F.sum(s).over(inside) + F.col(f"{s}b")).alias(f"{s}t") for s in SUMS], *SUMS
    )
    steps = summed.select(
        "conv_id",
        "_block",
        F.col("pos").alias("depth"),
        _id([F.col(f"{s}t") for s in SUMS]).alias("id"),
        F.when(F.col("pos") == 1, _root()).otherwise(_id([F.col(f"{s}t") - F.col(s) for s in SUMS])).alias("parent"),
        "chars",
        (F.col("pos") == F.col("_end")).alias("last"),
    )
    return _chained(steps, ["conv_id", "_block"]).drop("_block")


def _chained(steps: DataFrame, within: list[str]) -> DataFrame:
    """Adds the chain and the anchor of each step of a path; a band is small, and so is its window."""
    band = F.floor((F.col("depth") - 1) / BAND)
    upto = Window.partitionBy(*within, "_band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    banded = steps.withColumn("_band", band)
    return banded.withColumn("chain", F.collect_list("id").over(upto)).withColumn("anchor", F.first("parent").over(upto)).drop("_band")


def _anchors(steps: DataFrame) -> DataFrame:
    """The paths of the tree of anchors, a level for each band."""
    upper = steps.filter(F.col("depth") % BAND == 0).select("conv_id", (F.col("depth") / BAND).cast("long").alias("depth"), "id", F.col("anchor").alias("parent"))
    return _chained(upper, ["conv_id"])


def rolled(nodes: DataFrame, steps: DataFrame, values: list[str], depth: int) -> DataFrame:
    """Totals over subtrees of all nodes but the root: id and ``values``.

    Stored ``nodes`` have id, depth, chain, anchor and values of their own; ``steps`` are
    the paths of conversations on this tree, ``depth`` is its deepest level.
    """
    own = nodes.select("id", "depth", "chain", *values)
    if depth > BAND:
        # What a band's upper levels give their anchor, then the anchors' own tree.
        inner = nodes.filter(F.col("depth") % BAND != 0).groupBy(F.col("anchor").alias("id")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        upper = _anchors(steps)
        tree = upper.groupBy("id", "depth", "chain", "anchor").agg(F.count(F.lit(1)).alias("_n"))
        lowest = nodes.filter(F.col("depth") % BAND == 0).select("id", *values).join(inner, "id", "left")
        weighed = lowest.select("id", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        tree = store(tree.drop("_n").join(weighed, "id"), "prefix-anchors")
        totals = rolled(tree, store(upper, "prefix-paths"), values, depth // BAND)
        whole = totals.select("id", *[F.col(v).alias(f"_{v}") for v in values])
        own = own.join(whole, "id", "left").select("id", "depth", "chain", *[F.coalesce(f"_{v}", v).alias(v) for v in values])
    spread = own.select(F.explode("chain").alias("id"), *values)
    return store(spread.groupBy("id").agg(*[F.sum(v).alias(v) for v in values]), "prefix-totals")


def _ends(steps: DataFrame, turnless: DataFrame) -> DataFrame:
    """id and ends_sha256 of nodes at which conversations end.

    The ids of a node are joined piece by piece, each at most 2**``PIECE_BITS`` of them; only nodes of
    several pieces pass a digest that reads one piece after the other.
    """
    ends = steps.filter("last").select("id", "conv_id").unionByName(turnless.select(_root().alias("id"), "conv_id"))
    piece = F.shiftright("conv_id", PIECE_BITS).alias("_piece")
    joined = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = store(ends.groupBy("id", piece).agg(joined.alias("_ids")), "prefix-ends")
    counts = store(pieces.groupBy("id").agg(F.count(F.lit(1)).alias("_n")), "prefix-pieces")
    single = pieces.join(counts.filter("_n = 1"), "id", "left_semi").select("id", F.sha2("_ids", 256).alias("ends_sha256"))
    several = pieces.join(counts.filter("_n > 1"), "id", "left_semi").repartition("id").sortWithinPartitions("id", "_piece")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], names=["id", "ends_sha256"])

        for batch in batches:
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != at:
                    if at is not None:
                        yield done()
                    at, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if at is not None:
            yield done()

    return single.unionByName(several.select("id", "_ids").mapInArrow(digests, "id binary, ends_sha256 string"))


def trie(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """13. A row for each node of the trie of rebuilt conversations.

    conv_id (its smallest member), depth, parent_conv_id (that of its parent; null for
    the root), n_convs (members), n_children, n_leaves (childless nodes of its subtree),
    saved_tokens (over its subtree, the code points of each last text for every member
    but one), ends_sha256 (digest of the members that end there, in order, joined by commas).
    """
    whole, talks = rebuilt(store(ordered(turns, conversation, turn, role, text), "prefix-turns"))
    steps = store(paths(whole), "prefix-steps")
    of_node = steps.groupBy("id", "depth", "parent", "chars", "chain", "anchor").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    of_node = store(of_node, "prefix-plain")
    children = store(of_node.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children")), "prefix-children")
    counted = of_node.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = counted.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars"))
    nodes = store(nodes, "prefix-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = rolled(nodes, steps, ["n_leaves", "saved_tokens"], deepest)
    leaves, saved, first = nodes.agg(F.sum("n_leaves"), F.sum("saved_tokens"), F.count_if(F.col("depth") == 1)).first()
    long = lambda value: F.lit(value).cast("long")
    members = talks.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = members.select(
        _root().alias("id"), F.lit(None).cast("binary").alias("parent"), "conv_id", long(0).alias("depth"), "n_convs",
        long(first).alias("n_children"), long(leaves or 1).alias("n_leaves"), long(saved or 0).alias("saved_tokens"),
    )
    below = nodes.select("id", "parent", "conv_id", "depth", "n_convs", "n_children").join(totals, "id")
    turnless = talks.join(steps.filter("depth = 1").select("conv_id"), "conv_id", "left_anti")
    named = below.unionByName(root).join(_ends(steps, turnless), "id", "left")
    named = store(named.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "prefix-trie")
    parents = named.filter("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    found = attach(named.withColumnRenamed("n_children", "_children"), store(parents, "prefix-parents"), "parent", "n_children")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("_children").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256")
