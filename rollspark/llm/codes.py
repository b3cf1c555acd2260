"""Codes of vectors by codebooks that are fitted in exact integers.

A component x becomes the integer floor(``SCALE`` * x). Vectors are cut into
``PARTS`` consecutive parts (equal ones; if the length is no multiple, the first parts
are one longer). Each part has a codebook that starts as that part of the ``ENTRIES``
rows with the smallest keys, and is moved ``ROUNDS`` times: every part goes to its nearest
entry, then each used entry becomes the floor of its parts' mean.

Nearest means least squared distance, exact. Dot products of parts and entries are
matrix products in float64: integers are broken into limbs of so many bits that a sum
of products of two limbs stays below 2**53, so that every such product is exact;
shifted, they add up to the dot product in int64. The first least distance wins.

The vectors stay on Spark: a task gives count and sums of the parts of each entry,
which Spark adds. Only codebooks, ``ENTRIES`` times the length of a vector, reach the
driver and travel to the tasks.

Rows whose vector is null or has null, NaN or infinite components are dropped.
Keys may repeat or be null: equal keys are ordered by their vectors, rows with null
keys never start a codebook. Vectors of another length than the first row of the
codebook, and vectors with a component so large that distances might leave int64 (from
2**22 on at 4,096 components), keep their row, with null as code and error, and move no
entry. An empty vector has the codes of entry 0 and error 0. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rollspark.llm.common import share, store

# Those of the codes' definition.
SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 1 << 12  # vectors whose distances are held at once


def limb_bits(length: int) -> int:
    """Bits of a limb: ``length`` products of two limbs sum to less than 2**53."""
    return (53 - max(length, 1).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Values as sums of limb i times 2**(i * bits), the limbs as float64; all but the last are not negative."""
    found = []
    while True:
        if not values.size or np.abs(values).max() < 1 << bits:
            return [*found, values.astype(np.float64)]
        found.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of the rows of two integer matrices, as int64."""
    bits = limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    right = [x.T for x in limbs(b, bits)]
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y).astype(np.int64) << ((i + j) * bits)
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first nearest entry of each part, and its squared distance."""
    own, theirs = (parts * parts).sum(axis=1), (entries * entries).sum(axis=1)
    places, least = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for begin in range(0, len(parts), BLOCK):
        there = slice(begin, begin + BLOCK)
        apart = theirs - 2 * dots(parts[there], entries)
        places[there] = apart.argmin(axis=1)
        least[there] = apart[np.arange(len(apart)), places[there]] + own[there]
    return places, least


def bounds(length: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return [0, *np.cumsum([length // parts + (i < length % parts) for i in range(parts)]).tolist()]


def greatest(length: int) -> int:
    """Components of this size or more might leave int64: the whole distance is at most length * (2 * size)**2."""
    return 1 << ((62 - max(length, 1).bit_length()) // 2 - 1)


def matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("_v")).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), length)


def integers(vector: str) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(vector: str) -> Column:
    """Not null, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def _moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round. Counts and sums are added up by Spark; a task sends at most one of each entry."""
    entries, length = books.shape
    cuts = bounds(length)
    shared = share(vectors.sparkSession, books)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared()
        counts = np.zeros((PARTS, entries), np.int64)
        sums = np.zeros((entries, length), np.int64)
        for batch in batches:
            rows = matrix(batch, length)
            for p in range(PARTS):
                own = rows[:, cuts[p] : cuts[p + 1]]
                places, _ = nearest(own, now[:, cuts[p] : cuts[p + 1]])
                counts[p] += np.bincount(places, minlength=entries)
                order = np.argsort(places, kind="stable")
                used, begins = np.unique(places[order], return_index=True)
                if own.size:
                    sums[used, cuts[p] : cuts[p + 1]] += np.add.reduceat(own[order], begins)
        for p in range(PARTS):
            used = np.flatnonzero(counts[p])
            at = np.arange(cuts[p], cuts[p + 1])
            place = np.concatenate([[-1], at])[None, :]  # -1: the count
            shape = (len(used), place.shape[1])
            value = np.concatenate([counts[p][used][:, None], sums[used][:, at]], axis=1)
            columns = [np.full(value.size, p), np.broadcast_to(used[:, None], shape).ravel(), np.broadcast_to(place, shape).ravel(), value.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "place", "value"])

    made = vectors.select("_v").mapInArrow(totals, "part long, entry long, place long, value long")
    rows = made.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).toArrow()  # at most (length + PARTS) * ENTRIES rows
    part, entry, place, value = (rows.column(c).to_numpy() for c in ("part", "entry", "place", "value"))
    counts, sums = np.zeros((PARTS, entries), np.int64), np.zeros_like(books)
    is_count = place < 0
    counts[part[is_count], entry[is_count]] = value[is_count]
    sums[entry[~is_count], place[~is_count]] = value[~is_count]
    out = books.copy()
    for p in range(PARTS):
        used, there = np.flatnonzero(counts[p]), slice(cuts[p], cuts[p + 1])
        out[used, there] = sums[used, there] // counts[p][used][:, None]  # floors
    return out


def fit(vectors: DataFrame, key: str = "_key") -> np.ndarray:
    """Codebooks side by side, a row for each entry, from stored ``vectors`` with ``_v`` and a key; no rows without keys."""
    first = vectors.filter(F.col(key).isNotNull()).select(key, "_v").orderBy(key, "_v").limit(ENTRIES).toArrow().column("_v").to_pylist()
    length = len(first[0]) if first else 0
    kept = [v for v in first if len(v) == length and max(map(abs, v), default=0) < greatest(length)]
    books = np.array(kept, np.int64).reshape(len(kept), length)
    if len(books):
        within = vectors.filter(fits("_v", length))
        for _ in range(ROUNDS):
            books = _moved(within, books)
    return books


def fits(vector: str, length: int) -> Column:
    """Of the codebook's length, and small enough for exact distances."""
    large = greatest(length)
    return (F.size(vector) == length) & F.forall(vector, lambda x: (x < large) & (x > -large))


def assign(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds ``code`` (two hex digits for each part) and ``error`` (squared distance); drops ``_v``."""
    entries, length = books.shape
    cuts = bounds(length)
    shared = share(vectors.sparkSession, books)
    kind = pa.struct([("code", pa.string()), ("error", pa.int64())])

    @F.arrow_udf("struct<code: string, error: long>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        now = shared()
        digits = np.array([f"{i:02x}" for i in range(ENTRIES)])
        for batch in batches:
            here = batch.is_valid().to_numpy(zero_copy_only=False)
            rows = batch.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(here.sum()), length)
            code, error = np.zeros(len(rows), "<U1").astype(object), np.zeros(len(rows), np.int64)
            code[:] = ""
            for p in range(PARTS):
                places, apart = nearest(rows[:, cuts[p] : cuts[p + 1]], now[:, cuts[p] : cuts[p + 1]])
                code = code + digits[places].astype(object)
                error += apart
            codes, errors = np.full(len(batch), None, object), np.zeros(len(batch), np.int64)
            codes[here], errors[here] = code, error
            yield pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, mask=~here)], fields=list(kind))

    wanted = F.when(fits("_v", length), F.col("_v")) if entries else F.lit(None).cast("array<long>")
    return vectors.withColumn("_coded", coded(wanted)).select("*", "_coded.*").drop("_coded", "_v")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    cuts = bounds(books.shape[1])
    numbers = [str(x) for p in range(PARTS) for x in books[:, cuts[p] : cuts[p + 1]].ravel().tolist()]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """12. Key, code, error, label_error (error summed over rows of an equal label, nulls together) and codebooks_sha256 of each kept row."""
    kept = rows.filter(usable(vector)).select(F.col(key).alias("_key"), F.col(label).alias("_label"), integers(vector).alias("_v"))
    vectors = store(kept, "codes-vectors")
    books = fit(vectors)
    coded = store(assign(vectors, books), "codes-coded")
    sums = store(coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error")), "codes-labels")
    # Both sides are stored, so Spark splits the rows of a common label.
    joined = coded.join(sums, F.col("_label").eqNullSafe(F.col("_of")), "left")
    return joined.select(F.col("_key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
