"""Document fingerprints as invertible Bloom lookup sketches.

A text is a set of paragraph digests: of its lines, and of parts of lines of more
than ``LINE`` words, which end after words that a hash picks, so that an edit moves
no later border. The n-th repeat of a paragraph has a digest of its own. Each digest
is added to one cell in each third of the sketch; a cell has a count, a sum of
digests and a sum of their checks. The difference of two sketches holds what only
one of the texts has. Peeling recovers it: a cell with one digest left gives it
away and it is taken from its other cells. If cells remain, both sketches are built
anew, larger by ``GROWTH``, until all is recovered. (Digests that never peel, as two equal
ones of unequal paragraphs, are told by the lists of digests, once a sketch has ``AMPLE``
times as many cells as there are digests.)

White space within lines does not count. Null and empty texts have no paragraphs
and the empty sketch; two such texts are alike. Repeated rows have equal sketches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rollspark.llm.common import share, slices

LINE = 8
CUT = 6  # parts of long lines have about so many words
CELLS = 48
GROWTH = 4
AMPLE = 64
WINDOW = 1 << 20  # letters of consecutive texts that are compared at once
PARTITION_BYTES = 32 << 20

CELL = np.dtype([("count", "<i4"), ("digests", "<u8"), ("checks", "<u8")])


def paragraphs(text: str | None) -> np.ndarray:
    """Digests of the paragraphs of a whole text, all distinct."""
    parts: list[bytes] = []
    for line in (text or "").encode().split(b"\n"):
        words = line.split()
        if len(words) <= LINE:
            if words:
                parts.append(b" ".join(words))
            continue
        begin = 0
        for end, word in enumerate(words, 1):
            if zlib.crc32(word) % CUT == 0 or end == len(words):
                parts.append(b" ".join(words[begin:end]))
                begin = end
    seen: Counter = Counter()
    digests = np.empty(len(parts), np.uint64)
    for i, part in enumerate(parts):
        digests[i] = xxhash.xxh64_intdigest(part, seen[part])
        seen[part] += 1
    return digests


def _mixed(digests: np.ndarray, by: int) -> np.ndarray:
    x = (digests ^ (digests >> np.uint64(29))) * np.uint64(by)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def checks(digests: np.ndarray) -> np.ndarray:
    return _mixed(digests, 0xBF58476D1CE4E5B9) >> np.uint64(24)


def places(digests: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each digest in each third."""
    third = cells // 3
    odd = (0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
    return [i * third + ((_mixed(digests, o) >> np.uint64(40)) % np.uint64(third)).astype(np.int64) for i, o in enumerate(odd)]


class Sketches:
    """Sketches of many texts side by side, or differences of pairs of them."""

    def __init__(self, texts: int, cells: int):
        self.cells = cells
        self.count = np.zeros(texts * cells, np.int64)
        self.digests = np.zeros(texts * cells, np.uint64)
        self.checks = np.zeros(texts * cells, np.uint64)

    def add(self, owner: np.ndarray, digests: np.ndarray, times: np.ndarray) -> None:
        """Add each digest to the sketch of its owner, 1 or -1 times."""
        times_ = times.astype(np.int64)
        signed = times_.astype(np.uint64)  # -1 wraps: sums are modulo 2**64
        check = checks(digests)
        for place in places(digests, self.cells):
            at = owner * self.cells + place
            np.add.at(self.count, at, times_)
            np.add.at(self.digests, at, digests * signed)
            np.add.at(self.checks, at, check * signed)

    def packed(self) -> list[bytes]:
        out = np.zeros(len(self.count), CELL)
        out["count"], out["digests"], out["checks"] = self.count, self.digests, self.checks
        return [row.tobytes() for row in out.reshape(-1, self.cells)]

    def subtract(self, other: Sketches) -> None:
        self.count -= other.count
        self.digests -= other.digests
        self.checks -= other.checks

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and sign of all that can be recovered, and which sketches are empty after that."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.arange(len(self.count))
        while len(look):
            look = look[np.abs(self.count[look]) == 1]
            sign = self.count[look]
            digest = self.digests[look] * sign.astype(np.uint64)
            pure = checks(digest) * sign.astype(np.uint64) == self.checks[look]
            owner = look[pure] // self.cells
            digest, sign = digest[pure], sign[pure]
            if not len(owner):
                break
            order = np.lexsort((digest, owner))  # one digest may be alone in several cells
            owner, digest, sign = owner[order], digest[order], sign[order]
            first = np.ones(len(owner), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
            owner, digest, sign = owner[first], digest[first], sign[first]
            found.append((owner, digest, sign))
            self.add(owner, digest, -sign)
            look = np.unique(np.concatenate([owner * self.cells + p for p in places(digest, self.cells)]))
        left = (self.count != 0) | (self.digests != 0) | (self.checks != 0)
        empty = ~left.reshape(-1, self.cells).any(axis=1)
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, t) for t in (np.int64, np.uint64, np.int64)]
        return *parts, empty


def _sketches(digests: list[np.ndarray], cells: int) -> Sketches:
    made = Sketches(len(digests), cells)
    owner = np.repeat(np.arange(len(digests)), [len(d) for d in digests])
    made.add(owner, np.concatenate([np.zeros(0, np.uint64), *digests]), np.ones(len(owner), np.int64))
    return made


def subtracted(left: bytes, right: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """Digests that only the left, or only the right of two packed sketches has; None if they hold too few cells for that."""
    one, two = (np.frombuffer(x, CELL) for x in (left, right))
    sketches = Sketches(1, len(one))
    sketches.count = one["count"].astype(np.int64) - two["count"]
    sketches.digests, sketches.checks = one["digests"] - two["digests"], one["checks"] - two["checks"]
    _, digest, sign, empty = sketches.peel()
    return (digest[sign > 0], digest[sign < 0]) if empty[0] else None


def differences(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests that only the left, or only the right text of each pair has, recovered from sketches."""
    only: tuple[list, list] = ([np.zeros(0, np.uint64)] * len(left), [np.zeros(0, np.uint64)] * len(left))
    open_ = np.arange(len(left))
    while len(open_):
        sketches = _sketches([left[i] for i in open_], cells)
        sketches.subtract(_sketches([right[i] for i in open_], cells))
        owner, digest, sign, empty = sketches.peel()
        order = np.argsort(owner, kind="stable")
        owner, digest, sign = owner[order], digest[order], sign[order]
        cuts = np.searchsorted(owner, np.arange(len(open_) + 1))
        for place in np.flatnonzero(empty).tolist():
            mine = slice(cuts[place], cuts[place + 1])
            only[0][open_[place]] = digest[mine][sign[mine] > 0]
            only[1][open_[place]] = digest[mine][sign[mine] < 0]
        open_ = open_[~empty]
        for i in [i for i in open_.tolist() if cells > AMPLE * (len(left[i]) + len(right[i]) + 1)]:
            only[0][i], only[1][i] = np.setdiff1d(left[i], right[i]), np.setdiff1d(right[i], left[i])
            open_ = open_[open_ != i]
        cells *= GROWTH
    return only


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Share of the paragraphs of both texts that both have; 1 for two texts without any."""
    apart = np.array([len(a) + len(b) for a, b in zip(*differences(left, right))])
    both = np.array([len(a) + len(b) for a, b in zip(left, right)])
    return np.where(both > 0, 1 - apart / np.maximum(both, 1), 1.0)


def sketches_of(digests: list[np.ndarray], cells: int = CELLS) -> list[bytes]:
    return _sketches(digests, cells).packed()


def fingerprints(docs: DataFrame, text: str = "text", out: str = "sketch") -> DataFrame:
    """10. Adds the sketch of each whole text: CELLS cells of count, sum of digests and sum of checks."""

    @F.arrow_udf("binary")
    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([s for texts in slices(batch) for s in sketches_of([paragraphs(t) for t in texts])], pa.binary())

    return docs.withColumn(out, sketched(text))


RESULT = (
    "key {key}, n_chars long, edited_sha256 string, sketch binary, edited_sketch binary, "
    "lost long, gained long, near_edited double, near_next double"
)


def _compared(rows: list[tuple], following: list[str], paragraphs_: list[np.ndarray]) -> list[list]:
    """Columns of RESULT for documents, given the texts that follow and all paragraphs, the last follower's too."""
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for (_, t), n in zip(rows, following)]
    own, of_next, of_edited = paragraphs_[:-1], paragraphs_[1:], [paragraphs(e) for e in edited]
    lost, gained = differences(own, of_edited)
    both = np.array([max(1, len(a) + len(b)) for a, b in zip(own, of_edited)])
    apart = np.array([len(a) + len(b) for a, b in zip(lost, gained)])
    return [
        [k for k, _ in rows],
        [len(t) for _, t in rows],
        [hashlib.sha256(e.encode()).hexdigest() for e in edited],
        sketches_of(own),
        sketches_of(of_edited),
        [len(x) for x in lost],
        [len(x) for x in gained],
        (1 - apart / both).tolist(),
        likeness(own, of_next).tolist(),
    ]


def versions(docs: DataFrame, key: str = "doc_id", text: str = "text", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """10. Each text against an edited version and against the next document, by sketches.

    Next is the one with the next smaller key, after the last the first; of equal keys that with the larger hash of
    its text comes later, null keys come last. The edited text has its last third replaced by the beginning of the
    next. ``lost`` and ``gained`` count the paragraph digests recovered from the difference to the edited text.

    Rows are dealt once, by ranges of the numeric key, and pass in order. The ranges begin at keys of the table, and
    the row at the beginning of a range is also dealt to the range before it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    ranges = max(1, -(-size // partition_bytes))
    shares = [(i + 1) / ranges for i in range(ranges)]
    found = rows.agg(F.percentile_approx("key", shares, max(10_000, 20 * ranges))).first()[0] or []
    heads = sorted(set(found), reverse=True)
    last = max(len(heads) - 1, 0)
    shared = share(spark, np.array(heads[::-1], np.int64))

    @F.arrow_udf("int")
    def range_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ascending = shared()
        for keys in batches:
            inside = len(ascending) - 1 - np.searchsorted(ascending, keys.fill_null(0).to_numpy(), "left")
            yield pa.array(np.where(keys.is_null().to_numpy(False), last, np.maximum(inside, 0)).astype(np.int32))

    before = spark.createDataFrame([(h, (i - 1) if i else last) for i, h in enumerate(heads)] or [(None, None)], "_head long, before int")
    placed = rows.withColumn("range", range_of("key"))
    placed = placed.join(F.broadcast(before), F.col("key") == F.col("_head"), "left")
    copies = F.when(F.col("before").isNull(), F.array(F.struct("range", F.lit(False).alias("guest"))))
    copies = copies.otherwise(F.array(F.struct("range", F.lit(False).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(True).alias("guest"))))
    dealt = placed.select("key", "text", F.explode(copies).alias("to")).select("key", "text", "to.range", "to.guest")
    dealt = dealt.repartitionById(last + 1, "range")
    dealt = dealt.sortWithinPartitions("range", "guest", F.desc_nulls_last("key"), F.xxhash64("text"))
    if not heads:  # only null keys, if any: the first of them follows the last
        dealt = dealt.unionByName(dealt.orderBy(F.xxhash64("text")).limit(1).withColumn("guest", F.lit(True))).coalesce(1)
        dealt = dealt.sortWithinPartitions("guest", F.xxhash64("text"))
    kind = RESULT.format(key=rows.schema["key"].dataType.simpleString())
    names = [part.split()[0] for part in kind.split(", ")]
    types = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        digests: list[np.ndarray] = []
        letters, ended = 0, False

        def batch_of(columns: list[list]) -> pa.RecordBatch:
            arrays = [pa.array(columns[0], key_type), *[pa.array(c, t) for c, t in zip(columns[1:], types)]]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, t, guest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if ended:
                    break
                held.append((k, t))
                digests.append(paragraphs(t))
                letters += len(t)
                ended = guest
                if (letters >= WINDOW or ended) and len(held) > 1:
                    yield batch_of(_compared(held[:-1], [x for _, x in held[1:]], digests))
                    held, digests, letters = held[-1:], digests[-1:], len(t)

    return dealt.select("key", "text", "range", "guest").mapInArrow(passed, kind).withColumnRenamed("key", key)
