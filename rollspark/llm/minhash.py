"""Near-duplicate groups by one-permutation MinHash, optimal densification, banded buckets and stars of candidates.

A text's set is that of its distinct word shingles, by their 64-bit hashes. One hash
serves all minima: its upper half says in which bin a shingle falls, the least lower
half of a bin is its value. An empty bin takes the value of the filled bin that comes
first in an order of its own, a fixed random permutation of all bins, so it
picks evenly among the filled ones and independently of other empty bins (optimal
densification). Each ``ROWS`` bins make a bucket; two sets of similarity s share none
of the ``BANDS`` buckets with probability (1 - s**ROWS)**BANDS, 3e-7 at 0.8.

Equal sets are one node. A bucket gives a star, not its pairs: each node meets one hub,
the member of its buckets that comes first in one order of all nodes, so near copies
of one text mostly meet the same few hubs. Nodes that links lead to belong together. A
bucket stays open while it has members that do not. Members of open buckets are
compared by sketches, the lowest byte of each bin: sets of similarity s agree in
a share s of them, and pairs that agree in fewer than six standard deviations below
that cannot be alike (sets of fewer than ``SMALL`` shingles, which may share a bin by
chance: in fewer than half). Sets of up to ``PRINTED`` shingles are compared by 16 bits of each
as well, which shows at least what two of them share, so that nothing that is alike is left out. First each member meets the one of another group that its
sketch agrees with best, again and again while the pairs left are many for their
members (at most ``TURNS`` times); then all pairs that are left do. Large buckets are cut into
blocks that are compared two by two. All pairs that meet are confirmed on the full sets. So no
pair that shares a bucket goes unseen, unless its two sets belong together already.

Null and blank texts have the empty set, which links with nothing, not even another
one. Repeated rows link. Keys may repeat or be null: rows are told apart by a stored
number; a group is named by its least non-null key, null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rollspark.llm.common import attach, sized, slices, store
from rollspark.llm.simhash import components, links, print_of, shingle_hashes

WIDTH = 4  # words
PERCENT = 80
BANDS, ROWS = 64, 7
SMALL = 64
PRINTED = 1024
TURNS = 4
FEW = 256  # pairs left for each member
BLOCK = 1024  # members that are held and compared at once
DEVIATIONS = 6
GIVEN = 256  # texts whose buckets or sets a Python worker gives out together; sets are larger than their texts


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


class Bins:
    """The bins of one permutation, and the order in which each looks for a filled one."""

    def __init__(self):
        self.n = BANDS * ROWS
        self.order = np.random.default_rng(7).permuted(np.tile(np.arange(self.n, dtype=np.int16), (self.n, 1)), axis=1)
        self.rank = np.empty_like(self.order)  # of a bin, for each bin that looks
        np.put_along_axis(self.rank, self.order.astype(np.int64), np.arange(self.n, dtype=np.int16)[None, :], axis=1)

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """A value for each bin, of a set that is not empty and sorted."""
        bins = ((shingles >> np.uint64(32)) * np.uint64(self.n)) >> np.uint64(32)
        begins = np.concatenate([[0], np.flatnonzero(bins[1:] != bins[:-1]) + 1])
        filled = bins[begins].astype(np.int64)
        least = np.minimum.reduceat(shingles.astype(np.uint32), begins)
        values, known = np.zeros(self.n, np.uint32), np.zeros(self.n, bool)
        values[filled], known[filled] = least, True
        empty = np.flatnonzero(~known)
        if len(filled) * 8 > self.n:  # most find one soon
            near = self.order[empty, :8]
            met = known[near]
            found = met.any(axis=1)
            values[empty[found]] = values[near[found, met[found].argmax(axis=1)]]
            empty = empty[~found]
        if len(empty):
            values[empty] = least[self.rank[empty[:, None], filled[None, :]].argmin(axis=1)]
        return values


def buckets(shingles: np.ndarray, bins: Bins) -> np.ndarray:
    """The bucket of each band; none for the empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    bands = bins.values(shingles).reshape(BANDS, ROWS).astype(np.uint64)
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for row in range(ROWS):
        mixed = (mixed ^ bands[:, row]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def sketch(shingles: np.ndarray, bins: Bins) -> bytes:
    return bins.values(shingles).astype(np.uint8).tobytes()


def least_agreement(percent: int) -> int:
    """Bins in which sketches of sets of this similarity agree at least."""
    s, n = percent / 100, BANDS * ROWS
    # Bins are a sample of the shingles, which adds up to as much again as a third of the bins' own variance.
    return int(n * (s - DEVIATIONS * (s * (1 - s) * 4 / 3 / n) ** 0.5))


def _signatures(width: int, printed: bool):
    kind = pa.struct([("digest", pa.binary()), ("n_shingles", pa.int64()), ("buckets", pa.list_(pa.int64())), ("_print", pa.int64())])

    @F.arrow_udf("struct<digest: binary, n_shingles: long, buckets: array<long>, _print: long>")
    def signatures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bins = Bins()
        for texts in (texts for batch in batches for texts in slices(batch, GIVEN)):
            digests, sizes, found, prints = [], [], [], []
            for text in texts:
                hashes = shingle_hashes(text, width)
                own = np.unique(np.array(hashes, np.uint64))
                prints.append(print_of(hashes) if printed else 0)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sizes.append(len(own))
                found.append(buckets(own, bins))
            ends = np.cumsum([0, *map(len, found)])
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
            columns = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            columns.append(pa.array(np.array(prints, np.uint64).view(np.int64)))
            yield pa.StructArray.from_arrays(columns, fields=list(kind))

    return signatures


def _sets(width: int):
    kind = pa.struct([("set", pa.list_(pa.int64())), ("sketch", pa.binary()), ("prints", pa.binary())])

    @F.arrow_udf("struct<set: array<long>, sketch: binary, prints: binary>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bins = Bins()
        for texts in (texts for batch in batches for texts in slices(batch, GIVEN)):
            found = [shingle_set(text, width) for text in texts]
            ends = np.cumsum([0, *map(len, found)])
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))
            prints = [own.astype(np.uint16).tobytes() if len(own) <= PRINTED else b"" for own in found]
            columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array([sketch(own, bins) for own in found], pa.binary()), pa.array(prints, pa.binary())]
            yield pa.StructArray.from_arrays(columns, fields=list(kind))

    return sets


def _compared(percent: int, best: bool):
    """Pairs of members of a bucket, of different groups, that may be alike by their sketches and sizes; with ``best`` one for a member.

    Rows come sorted by bucket, and the two blocks that are compared there.
    """
    least, half = least_agreement(percent), BANDS * ROWS // 2

    def shared(row: int, other: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """At most how many shingles each of the other sets shares with that of the row."""
        known = np.zeros(1 << 16, bool)
        known[np.frombuffer(prints[row], np.uint16)] = True
        flat = np.frombuffer(b"".join(prints[other].tolist()), np.uint16)
        ends = np.cumsum([len(x) // 2 for x in prints[other].tolist()])
        return np.diff(np.concatenate([[0], np.cumsum(known[flat])[ends - 1]]))

    def pairs_of(nodes, groups, sides, sizes, bins, prints) -> pa.RecordBatch:
        left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)  # 2: a block with itself
        printed = sizes <= PRINTED
        a, b = [], []
        for row in left:
            other = right[(groups[right] != groups[row]) & (best | (sides[right] == 1) | (right > row))]
            fewer, more = np.minimum(sizes[other], sizes[row]), np.maximum(sizes[other], sizes[row])
            other = other[fewer * 100 >= more * percent]
            agree = (bins[other] == bins[row]).sum(axis=1)
            near = agree >= np.where(np.minimum(sizes[other], sizes[row]) < SMALL, half, least)
            other, like = other[near], agree[near] / bins.shape[1]
            told = np.flatnonzero(printed[other]) if printed[row] else np.zeros(0, np.int64)
            if len(told):
                both = shared(row, other[told], prints)
                like[told] = both / (sizes[row] + sizes[other[told]] - both)
                near = np.ones(len(other), bool)
                near[told] = like[told] * 100 >= percent - 1e-6
                other, like = other[near], like[near]
            if best and len(other):
                other = other[[like.argmax()]]
            a.append(np.full(len(other), row))
            b.append(other)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b))
        swap = nodes[a] > nodes[b]
        return pa.RecordBatch.from_arrays([pa.array(np.where(swap, nodes[b], nodes[a])), pa.array(np.where(swap, nodes[a], nodes[b]))], names=["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        for batch in batches:
            bucket, one, two, side, node, group, size = (batch.column(i).to_numpy() for i in range(7))
            bins = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(len(batch), -1)
            prints = np.array([*batch.column(8).to_pylist(), None], object)[:-1]
            new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
            cuts = [0, *new.tolist(), len(batch)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                here = (int(bucket[begin]), int(one[begin]), int(two[begin]))
                if here != at and held:
                    yield pairs_of(*(np.concatenate(x) for x in zip(*held)))
                    held.clear()
                at = here
                held.append((node[begin:end], group[begin:end], side[begin:end], size[begin:end], bins[begin:end], prints[begin:end]))
        if held:
            yield pairs_of(*(np.concatenate(x) for x in zip(*held)))

    return compared


def _in_blocks(open_: DataFrame, sets: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b) left in open buckets: rows of bucket, node, group and the bucket's size ``_n``."""
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    copied = open_.select("bucket", "node", "group", own.alias("_own"), other.alias("_other"))
    side = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    placed = copied.select("bucket", F.least("_own", "_other").alias("one"), F.greatest("_own", "_other").alias("two"), side.alias("side"), "node", "group")
    sketches = sets.select("node", F.size("set").alias("size"), "sketch", "prints")
    shown = placed.join(sketches, "node").select("bucket", "one", "two", "side", "node", "group", "size", "sketch", "prints")
    dealt = shown.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    return dealt.mapInArrow(_compared(percent, best), "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike. All sides are stored tables, so Spark splits the pairs of a common hub."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("set").alias(f"_{end}")), end)
    both = F.size(F.array_intersect("_a", "_b")).cast("long")
    return pairs.filter(both * 100 >= (F.size("_a") + F.size("_b") - both) * percent).select("a", "b")


def _by_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints ``_print`` link by the pivot tables of 8: the first nodes of two fingerprints, and that of each with the others."""
    prints = store(nodes.groupBy("_print").agg(F.min("node").alias("_hub"), F.count(F.lit(1)).alias("_n")), "minhash-prints")
    near = links(prints.select("_print"), "_print")
    for end in ("a", "b"):
        near = near.join(prints.select(F.col("_print").alias(end), F.col("_hub").alias(f"_{end}")), end)
    near = near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    equal = attach(nodes.select("_print", "node"), prints, "_print", "_n").filter("node <> _hub").select(F.col("_hub").alias("a"), F.col("node").alias("b"))
    return store(near.unionByName(equal).distinct(), "minhash-near")


def _linked(members: DataFrame, rows: DataFrame, width: int, percent: int, near: DataFrame | None = None) -> DataFrame:
    """Node and ``group`` of nodes that share a bucket or are in a stored pair of ``near``.

    ``members`` are stored pairs of bucket and node, ``rows`` hold the texts.
    """
    n = members.count()
    # Numbers alone, so that Spark aggregates by hashing.
    rank = F.xxhash64("node")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_rank"), F.min_by("node", rank).alias("_hub"))
    shared = store(sized(shared.filter("_n > 1"), n), "minhash-shared")
    open_ = store(sized(members.join(shared, "bucket"), n), "minhash-open")
    n = open_.count()
    star = store(sized(open_.groupBy("node").agg(F.min_by("_hub", "_rank").alias("_hub")), n), "minhash-star")
    met = star.select("node")
    if near is not None:
        met = met.union(near.select("a")).union(near.select("b")).distinct()
    texts = rows.join(met.select(F.col("node").alias("_row")), "_row").select(F.col("_row").alias("node"), _sets(width)("_text").alias("_made"))
    sets = store(texts.select("node", "_made.*"), "minhash-sets")
    pairs = star.filter("node <> _hub").select(F.col("_hub").alias("a"), F.col("node").alias("b"))
    groups = met.select("node", F.col("node").alias("group"))
    if near is not None:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(near).distinct()
        groups = store(groups, "minhash-groups")
    last = False
    for turn in range(TURNS + 2):
        links = store(_confirmed(pairs, sets, percent), "minhash-links")
        if not links.isEmpty():
            named = links
            for end in ("a", "b"):
                named = named.join(groups.select(F.col("node").alias(end), F.col("group").alias(f"_{end}")), end)
            joined = components(named.select(F.col("_a").alias("a"), F.col("_b").alias("b")), "minhash-components")
            joined = joined.withColumnsRenamed({"node": "group", "component": "_to"})
            groups = groups.join(joined, "group", "left").select("node", F.coalesce("_to", "group").alias("group"))
            groups = store(sized(groups, n), "minhash-groups")
        if last:
            break
        now = store(sized(open_.join(groups, "node").select("bucket", "node", "group"), n), "minhash-now")
        of_group = now.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("_c"))
        members_, squares = F.sum("_c"), F.sum(F.col("_c") * F.col("_c"))
        cross = ((members_ * members_ - squares) / 2).cast("long").alias("_cross")
        still = store(sized(of_group.groupBy("bucket").agg(members_.alias("_n"), cross).filter("_cross > 0"), n), "minhash-still")
        left, size = still.agg(F.sum("_cross"), F.sum("_n")).first()
        if not left:
            break
        last = turn == TURNS or (turn > 0 and left <= FEW * size)
        left_open = sized(now.join(still.select("bucket", "_n"), "bucket"), n)
        pairs = store(_in_blocks(left_open, sets, percent, not last), "minhash-pairs")
    return groups


def group(rows: DataFrame, width: int = WIDTH, percent: int = PERCENT, printed: bool = False) -> DataFrame:
    """Stored ``rows`` with number ``_row`` and ``_text``: the other columns, ``n_shingles`` and ``group``.

    ``group`` is the number of a row of the group; null for empty sets. With ``printed``, nodes whose SimHash
    fingerprints link are candidates too, confirmed with the others.
    """
    signed = rows.select("*", _signatures(width, printed)("_text").alias("_made")).drop("_text")
    signed = signed.select("*", "_made.*").drop("_made", *([] if printed else ["_print"]))
    signed = store(signed, "minhash-signatures")
    # Rows of one digest have the same buckets.
    of_node = [F.min("_row").alias("node"), F.count(F.lit(1)).alias("_n"), *([F.min("_print").alias("_print")] if printed else [])]
    nodes = signed.filter("n_shingles > 0").groupBy("digest", "buckets").agg(*of_node)
    nodes = store(nodes, "minhash-nodes")
    members = store(nodes.select(F.explode("buckets").alias("bucket"), "node"), "minhash-members")
    near = _by_prints(nodes) if printed else None
    found = _linked(members, rows.select("_row", "_text"), width, percent, near)
    named = nodes.join(found, "node", "left").select("digest", "_n", F.coalesce("group", "node").alias("group"))
    return attach(signed.drop("buckets", "_print"), store(named, "minhash-names"), "digest", "_n").drop("digest")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """11. Key, n_shingles, component_id (least key of the group) and kept (the key is that one) of each row.

    A row of an empty set is its own group. ``kept`` is false for null keys.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    grouped = store(group(store(rows, "minhash-rows"), width, percent), "minhash-grouped")
    names = grouped.groupBy("group").agg(F.min("_key").alias("_least"), F.count(F.lit(1)).alias("_n")).filter(F.col("group").isNotNull())
    named = attach(grouped, store(names, "minhash-least"), "group", "_n")
    component = F.when(F.col("group").isNull(), F.col("_key")).otherwise(F.col("_least"))
    return named.select(
        F.col("_key").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("_key") == component, F.lit(False)).alias("kept"),
    )
