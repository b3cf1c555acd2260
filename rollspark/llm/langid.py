"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to ``ORDER``: how often each byte
followed each context in texts of that language. A byte that a context has seen
costs its share there; any other costs the context's escape and then what the
next shorter context asks, down to eight bits for a byte never seen. (Escapes as
in method C: distinct successors over all successors and distinct ones; no
exclusion.) The statistics are frozen after training, so the cost of a byte after
its last ``ORDER`` bytes is a constant, kept in one table per order for all
languages. A text's language is the one with the shortest exact code length over
the whole text; equal lengths go to the first language in sorted order.

The trees are fitted on a bounded sample, ``per_language`` distinct rows (key and text) of each
language taken in the order of their hashes; a text of more than ``TEXT_BYTES`` teaches by slices
spread evenly over it. Null texts and texts without a
letter are ``und`` with score 0, and so is everything if nothing can be learnt from.
Repeated rows are judged alike; a column with the name of the new one is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollspark.llm.common import share, slices, unused

ORDER = 4
UNKNOWN = "und"
SHORT = 64
BLOCK = 1 << 17  # bytes of text that are scored at once
TEXT_BYTES = 1 << 18  # that one text of the sample teaches
SLICES = 16
LETTER = re.compile(r"[^\W\d_]")


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each behind ORDER zero bytes, and where each text with its zero bytes begins (and the end)."""
    parts = [bytes(ORDER) + t for t in texts]
    begins = np.cumsum([0, *map(len, parts)])
    return np.frombuffer(b"".join(parts), np.uint8), begins


def grams(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """For positions begin to end: the byte (lowest) and the ORDER bytes before it as one number."""
    keys = data[begin:end].astype(np.uint64)
    for back in range(1, ORDER + 1):
        if begin >= back:
            earlier = data[begin - back : end - back]
        else:
            earlier = np.concatenate([np.zeros(min(back - begin, end - begin), np.uint8), data[: max(end - back, 0)]])
        keys |= earlier.astype(np.uint64) << np.uint64(8 * back)
    return keys


def of_order(keys: np.ndarray, k: int) -> np.ndarray:
    return keys & np.uint64((1 << 8 * (k + 1)) - 1)


class Index:
    """Place of a number in a list of distinct numbers, for whole arrays: a hash table with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(8, int(4 * max(len(keys), 1) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.mask = (1 << self.bits) - 1
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several the last stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the numbers, -1 for those not in the list."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found[open_] = self.slots[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found


class Trees:
    """Frozen context trees of all languages as cost tables in bits."""

    def __init__(self, counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]):
        """counts: by language and order, the distinct numbers of context and byte, and how often each occurs."""
        self.languages = sorted({language for language, _ in counts})
        n = len(self.languages)
        self.pairs, self.costs, self.contexts, self.escapes = [], [], [], []
        for k in range(ORDER + 1):
            by = [counts.get((x, k), (np.zeros(0, np.uint64), np.zeros(0))) for x in self.languages]
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *[b[0] for b in by]]))
            above = np.unique(keys >> np.uint64(8))
            escapes = np.zeros((len(above), n))
            seen, bits = np.zeros((len(keys), n), bool), np.zeros((len(keys), n))
            for j, (own, times) in enumerate(by):
                times = times.astype(np.float64)
                context = np.searchsorted(above, own >> np.uint64(8))
                total = np.bincount(context, times, len(above))
                distinct = np.bincount(context, minlength=len(above))
                known = distinct > 0
                escapes[known, j] = np.log2((total + distinct)[known] / distinct[known])
                place = np.searchsorted(keys, own)
                seen[place, j] = True
                bits[place, j] = np.log2((total + distinct)[context] / times)
            if not seen.all():
                shorter = self._cost(keys, k - 1) + escapes[np.searchsorted(above, keys >> np.uint64(8))]
                bits = np.where(seen, bits, shorter)
            self.pairs.append(Index(keys))
            self.contexts.append(Index(above))
            self.costs.append(bits.astype(np.float32))
            self.escapes.append(escapes.astype(np.float32))

    def _cost(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Bits in each language of the byte of each number after its k bytes before."""
        if k < 0:
            return np.full((len(keys), len(self.languages)), 8, np.float32)
        own = of_order(keys, k)
        place = self.pairs[k].find(own)
        cost = self.costs[k][place] if len(self.costs[k]) else np.zeros((len(keys), len(self.languages)), np.float32)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            cost[miss] = self._cost(keys[miss], k - 1)
            context = self.contexts[k].find(own[miss] >> np.uint64(8))
            known = context >= 0
            cost[miss[known]] += self.escapes[k][context[known]]
        return cost

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Code length in bits of each whole text in each language."""
        data, begins = joined([(t or "").encode() for t in texts])
        total = np.zeros((len(texts), len(self.languages)))
        for begin in range(0, len(data), BLOCK):
            end = min(begin + BLOCK, len(data))
            cost = self._cost(grams(data, begin, end), ORDER)
            first = int(np.searchsorted(begins, begin, "right")) - 1
            last = int(np.searchsorted(begins, end, "left"))
            for text in range(first, last):  # zero bytes in front of a text cost nothing
                start = min(begins[text] + ORDER, end)
                if start > begin:
                    cost[max(begins[text], begin) - begin : start - begin] = 0
            cuts = np.maximum(begins[first:last], begin) - begin
            total[first:last] += np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)
        return total

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its probability given the text, and its bits for a byte."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits = self.lengths(texts)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        size = np.array([max(1, len((t or "").encode())) for t in texts])
        lettered = np.array([t is not None and LETTER.search(t) is not None for t in texts], bool)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return names, np.where(lettered, score, 0.0), np.where(lettered, least / size, 0.0)


def taught(text: str) -> list[bytes]:
    """What is learnt of a text of the sample: all of it, or slices spread evenly over a long one."""
    data = text.encode()
    if len(data) <= TEXT_BYTES:
        return [data]
    size = TEXT_BYTES // SLICES
    return [data[begin : begin + size] for begin in np.linspace(0, len(data) - size, SLICES).astype(np.int64).tolist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of context and byte in each language and order, for the rows of a task, some at a time."""
    held: dict[str, list[bytes]] = {}

    def counted(language: str) -> Iterator[pa.RecordBatch]:
        data, begins = joined(held.pop(language))
        inside = np.ones(len(data), bool)
        for begin in begins[:-1]:
            inside[begin : begin + ORDER] = False
        keys = grams(data, 0, len(data))[inside]
        for k in range(ORDER + 1):
            found, times = np.unique(of_order(keys, k), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([language] * len(found), pa.string()),
                    pa.array(np.full(len(found), k, np.int32)),
                    pa.array(found.astype(np.int64)),
                    pa.array(times.astype(np.int64)),
                ],
                names=["lang", "k", "gram", "n"],
            )

    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(language, []).extend(taught(text))
            if sum(map(len, held[language])) >= 8 * TEXT_BYTES:
                yield from counted(language)
    for language in list(held):
        yield from counted(language)


def sampled(docs: DataFrame, learn: Column, key: str, text: str, lang: str, per_language: int) -> DataFrame:
    """``lang`` and ``text`` of at most ``per_language`` rows of each language, distinct by key and text, in the order of their hashes."""
    usable = docs.filter(learn & F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    usable = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("_hash"))
    narrow = usable.select("lang", "_hash")
    # Hashes are even over all longs, so the least of a language's are below a bound that leaves about
    # four times the sample: what is ranked does not grow with the table, nor with repeats of a row. The model
    # holds a tree for each language, so their list fits wherever the model does.
    sizes = narrow.groupBy("lang").agg((F.approx_count_distinct("_hash") / (4 * per_language)).alias("_share"))
    bound = F.when(F.col("_share") <= 1, F.lit((1 << 63) - 1)).otherwise(F.lit(-float(1 << 63)) + float(1 << 64) / F.col("_share"))
    least = narrow.join(F.broadcast(sizes), "lang").filter(F.col("_hash") <= bound).select("lang", "_hash").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))
    chosen = least.withColumn("_at", place).filter(F.col("_at") <= per_language).drop("_at")  # so many rows of each language at most
    return usable.join(F.broadcast(chosen), ["lang", "_hash"], "left_semi").groupBy("lang", "_hash").agg(F.first("text").alias("text")).drop("_hash")


def train(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400
) -> Trees:
    """5. Context trees from a sample of the rows where ``learn`` holds and key, text and language are not null.

    ``per_language`` bounds the sample of each language, ``TEXT_BYTES`` what one text adds to it; only the sample's
    counts reach the driver.
    """
    sample = sampled(docs, learn, key, text, lang, per_language)
    counted = sample.mapInArrow(_count, "lang string, k int, gram long, n long")
    rows = counted.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages, ks = np.array(rows["lang"].to_pylist(), object), rows["k"].to_numpy()
    found, times = rows["gram"].to_numpy().astype(np.uint64), rows["n"].to_numpy()
    counts = {}
    for language in set(languages):
        for k in range(ORDER + 1):
            own = (languages == language) & (ks == k)
            counts[language, k] = found[own], times[own]
    return Trees(counts)


def identify(docs: DataFrame, trees: Trees, text: str = "text", out: str = "language") -> DataFrame:
    """5. Adds a struct of ``lang``, ``score`` (the language's probability) and ``bits`` (a byte of the text) to each row."""
    shared = share(docs.sparkSession, trees)

    @F.arrow_udf("struct<lang: string, score: double, bits: double>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared()
        for batch in batches:
            parts = [model.judge(texts) for texts in slices(batch)]
            names = [name for part in parts for name in part[0]]
            score, bits = (np.concatenate([np.zeros(0), *[part[i] for part in parts]]) for i in (1, 2))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=["lang", "score", "bits"])

    return docs.withColumn(out, judged(text))


def keep_known(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """5. Rows in one of the languages: not ``und``, and coded in fewer bits than the text has.

    A text that no tree codes better than as plain bytes is in none of the languages. Texts of fewer than ``SHORT``
    bytes prove nothing by that, as one rare name is enough, and stay.
    """
    out = unused(docs, "_language")
    known = (F.col(f"{out}.lang") != UNKNOWN) & ((F.col(f"{out}.bits") < 8) | (F.octet_length(text) < SHORT))
    return identify(docs, trees, text, out).filter(known).select(*docs.columns)
