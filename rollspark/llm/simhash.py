"""Near-duplicate groups by SimHash and tables of distances to reference fingerprints.

A text's fingerprint has a bit set where over half of its shingles' hashes have
it. Two fingerprints link if at most ``DISTANCE`` bits differ; documents form a
group if links lead from one to the other.

Only distinct fingerprints are compared. Six blocks of bits make twenty choices
of three; of two fingerprints at most three bits apart, some three blocks agree, so
they meet in a bucket of that choice and those bits. Every bucket has the table of
its members' Hamming distances to ``PIVOTS`` reference fingerprints. By the
triangle inequality two members are at least as far apart as their largest
difference in the table; pairs with more than ``DISTANCE`` there are discarded and
only the survivors are compared bit by bit. A bucket gives a spanning forest of its
links, found by walking from member to member, not its pairs: no link between
groups is lost, and a group of many thousands gives no more edges than it has members.

Null and empty texts have fingerprint zero and link like any other. Repeated rows
have equal fingerprints, so they share a group. Rows with a null key get a
fingerprint and the component of their group, whose name is the smallest non-null
key (null if there is none).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rollspark.llm.common import attach, sized, slices, store, unused

DISTANCE = 3
SHINGLE = 3
PIVOTS = 16
BLOCKS = (11, 11, 11, 11, 10, 10)  # bits
CHOICES = list(combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE))
GROUP = 1 << 16  # shingles whose bits are counted at once


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode()) for i in range(n)], np.uint64)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> list[int]:
    """XXH64 with seed 42 of each shingle of words, lower-cased A-Z, parted by one space. Repeats stay."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [hashed(b" ".join(words), 42)]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = (ends - [len(w) + 1 for w in words]).tolist()
    return [hashed(line[b:e], 42) for b, e in zip(begins, (ends[width - 1 :] - 1).tolist())]


def print_of(shingles: list[int]) -> int:
    """Fingerprint of the hashes of a text's shingles. Bits of a text of any length are counted in pieces."""
    hashes = np.array(shingles, ">u8")
    if not len(hashes):
        return 0
    set_ = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), GROUP):
        set_ += np.unpackbits(hashes[begin : begin + GROUP].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(set_ * 2 > len(hashes)).view(">u8")[0])


def fingerprint_of(texts: list[str | None], width: int = SHINGLE) -> np.ndarray:
    """Fingerprints of whole texts."""
    return np.array([print_of(shingle_hashes(text, width)) for text in texts], np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = SHINGLE) -> DataFrame:
    """8. Adds the fingerprint of each whole text as a long, its 64 bits in order."""

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [fingerprint_of(texts, width) for texts in slices(batch)]
            yield pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64), pa.int64())

    return docs.withColumn(out, prints(text))


def walk(members: np.ndarray, pivots: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints, as pairs of places.

    Each walk takes a member and looks among those not yet reached. They are kept
    in the order of their first distance, so that only a stripe of them is looked at.
    """
    table = np.bitwise_count(members[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    members, table = members[order], table[order]
    left = np.arange(len(members))
    edges, waiting = [], []
    while len(left) or waiting:
        if not waiting:
            waiting.append(left[0])
            left = left[1:]
        at = waiting.pop()
        mine = table[at]
        low, high = np.searchsorted(table[left, 0], [mine[0] - distance, mine[0] + distance + 1])
        near = np.arange(low, high)
        for pivot in range(1, table.shape[1]):
            if len(near) < 2:
                break
            near = near[np.abs(table[left[near], pivot] - mine[pivot]) <= distance]
        near = near[np.bitwise_count(members[left[near]] ^ members[at]) <= distance]
        if len(near):
            reached = left[near]
            edges += [(int(order[at]), int(order[r])) for r in reached]
            waiting += reached.tolist()
            left = np.delete(left, near)
    return edges


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each bucket; rows come sorted by bucket, whose members are together."""
    pivots = reference_fingerprints()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def edges(choice, bits, members) -> pa.RecordBatch:
        cuts = np.flatnonzero((choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])) + 1
        cuts = np.concatenate([[0], cuts, [len(bits)]])
        sizes = np.diff(cuts)
        pairs = cuts[:-1][sizes == 2]
        table = np.bitwise_count(members[pairs][:, None] ^ pivots[None, :]).astype(np.int8)
        other = np.bitwise_count(members[pairs + 1][:, None] ^ pivots[None, :]).astype(np.int8)
        pairs = pairs[np.abs(table - other).max(axis=1, initial=0) <= DISTANCE]
        pairs = pairs[np.bitwise_count(members[pairs] ^ members[pairs + 1]) <= DISTANCE]
        a, b = [members[pairs]], [members[pairs + 1]]
        for begin, size in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = members[begin : begin + size]
            if found := walk(own, pivots):
                left, right = np.array(found).T
                a.append(own[left])
                b.append(own[right])
        ends = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last bucket may go on in the next batch
        if last:
            held.append(tuple(x[:last] for x in now))
            yield edges(*(np.concatenate(x) for x in zip(*held)))
            held = []
        held.append(tuple(x[last:] for x in now))
    if held:
        yield edges(*(np.concatenate(x) for x in zip(*held)))


def links(distinct: DataFrame, column: str = "fingerprint") -> DataFrame:
    """8. Links (a, b) among distinct fingerprints that join all that linked pairs join; none twice in a bucket."""
    shifts = np.cumsum([0, *BLOCKS])[:-1]
    block = [((1 << width) - 1) << int(shift) for width, shift in zip(BLOCKS, shifts)]
    masks = []
    for choice in CHOICES:
        mask = sum(block[c] for c in choice)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    copies = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col(column).bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)]))
    keyed = distinct.select(F.col(column).alias("member"), copies.alias("bucket")).select("bucket.choice", "bucket.bits", "member")
    dealt = keyed.repartition("choice", "bits").sortWithinPartitions("choice", "bits")
    return dealt.mapInArrow(_forest, "a long, b long")


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """Smallest node that links lead to, for each node of at least one edge.

    Alternating stars: each round, every node joins its larger neighbours, then
    all its neighbours, to the smallest of them, so that paths shrink by half.
    Rounds are written to the shared folder; nothing but a count comes to the driver.
    """
    n = edges.count()
    now = store(sized(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), n), name)
    state = None
    while True:
        n = now.count()
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store(sized(both.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("_n")), 2 * n), name)
        # Large star: neighbours greater than the node go to the least of node and neighbours.
        large = store(sized(attach(now, least, "b", "_n").select("a", F.least("least", "b").alias("b")).distinct(), n), name)
        # Small star: the node and its smaller neighbours go to the least of those.
        least = store(sized(large.groupBy("a").agg(F.min("b").alias("least")), n), name)
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
        following = store(sized(small.filter("a != b").distinct(), n), name)
        sums = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == state:
            return following.select(F.col("a").alias("node"), F.col("b").alias("component"))
        now, state = following, tuple(sums)


def group(rows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Rows with ``_key`` and ``_text``: the other columns and ``fingerprint``, ``component_id`` and ``group``."""
    prints = store(fingerprints(rows, "_text", "fingerprint", width).drop("_text"), "prints")
    groups = store(prints.groupBy("fingerprint").agg(F.min("_key").alias("_least"), F.count(F.lit(1)).alias("_n")), "print-groups")
    found = components(links(groups.select("fingerprint")), "print-links")
    joined = groups.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    joined = joined.withColumn("_root", F.coalesce("component", "fingerprint"))
    names = joined.groupBy("_root").agg(F.min("_least").alias("component_id"))
    # Members of a group are distinct fingerprints, far fewer than its rows.
    named = store(joined.join(names, "_root").select("fingerprint", "component_id", F.col("_root").alias("group"), "_n"), "print-names")
    return attach(prints, named, "fingerprint", "_n")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """8. Key, fingerprint (long), component_id (smallest key of the group) and group (its smallest fingerprint) of each row."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return group(rows, width).select(F.col("_key").alias(key), "fingerprint", "component_id", "group")


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE,
    grouped: Callable[[DataFrame, int], DataFrame] = group,
) -> DataFrame:
    """8. One row of each group: that with the smallest key, then the least hash of its text, then the first as stored.

    Keys need not be distinct; rows with a null key come after all others of their
    group. ``grouped`` adds ``group`` to rows with ``_row``, ``_key`` and ``_text``.
    """
    row, gone = unused(docs, "_row"), unused(docs, "_gone")
    numbered = store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(row).alias("_row"), F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    order = F.struct(F.col("_key").isNull().alias("_null"), "_key", "_hash", "_row")
    grouped = store(grouped(rows, width).select("group", "_row", order.alias("_order")), "grouped")
    firsts = grouped.groupBy("group").agg(F.min("_order").alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    firsts = store(firsts.select("group", F.col("_least._row").alias("_first"), "_n"), "firsts")
    # Only numbers of rows that go meet the table, far fewer than its rows; null for rows alone in their group.
    others = attach(grouped.drop("_order"), firsts, "group", "_n").filter(F.col("_row") != F.col("_first"))
    return numbered.join(others.select(F.col("_row").alias(gone)), F.col(row) == F.col(gone), "left_anti").select(*docs.columns)
