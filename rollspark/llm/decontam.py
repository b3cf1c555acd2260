"""Benchmark decontamination: size-partitioned MinHash containment search.

Which documents hold a benchmark item? An item counts as held if at least
``THRESHOLD`` of its distinct shingles of ``SHINGLE`` words stand in the document,
however long that is. Items are partitioned by the number of their shingles, in
powers of two. Items of a partition of up to u shingles have a bottom-k MinHash
signature, the k smallest hashes of their shingles, k = u - ceil(THRESHOLD * u) + 1:
a document that holds the item lacks fewer than k of its shingles, so at least one
of the signature stands in it, and no held item is missed. Candidates are verified
by exact containment on the shingles themselves.

Words are runs of non-space characters, A-Z in lower case. An item of fewer than
SHINGLE words is one shingle, the whole sequence; documents are then cut at its width
too, for the widths that occur, so it is found wherever it stands. Items and
documents without a word, or null, match nothing. Rows that share a key count as one document, and null is a key like any
other; items that share a key are one item for each width. Extra columns are ignored.

Only DataFrame and SQL functions: texts are tokenised and hashed where they are
read, and what meets there is the signatures. They are broadcast if counted to be
at most ``BROADCAST_ROWS``; beyond that the join is left to Spark's own choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollspark.llm.common import store, unused

SHINGLE = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 1_000_000  # rows of two longs and an int

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[\\x20\\x09-\\x0D]+")
    return F.array_remove(parts, "")


def shingled(rows: DataFrame, keep: list[str], text: str, width: int = SHINGLE) -> DataFrame:
    """One row per shingle of each row, repeats included: the ``keep`` columns and the shingle's words as w0, w1, ...

    A text of fewer words is one shingle with nulls behind.
    """
    at = rows.select(*keep, words(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    n = F.greatest(F.size("_w") - (width - 1), F.lit(1))
    # The words shifted by 0, 1, ... side by side.
    shifted = [F.slice("_w", i + 1, n).alias(f"w{i}") for i in range(width)]
    return at.select(*keep, F.inline(F.arrays_zip(*shifted)))


def _hash(width: int) -> Column:
    return F.xxhash64(*[f"w{i}" for i in range(width)])


def _text(width: int) -> Column:
    return F.concat_ws(" ", *[f"w{i}" for i in range(width)])


def signatures(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Bottom-k signatures (_item, _hash) of items given as distinct (_item, _n, _hash), k by the partition of their size.

    Ranks stay within an item, a short text.
    """
    lower = F.floor(F.log2(F.col("_n") + F.lit(0.5)))
    upper = F.pow(F.lit(2.0), lower + 1) - 1
    k = upper - F.ceil(upper * threshold - 1e-9) + 1
    ranked = shingles.groupBy("_item", "_n").agg(F.sort_array(F.collect_set("_hash")).alias("_hashes"))
    return ranked.select("_item", F.explode(F.slice("_hashes", F.lit(1), F.greatest(k, F.lit(1)).cast("int"))).alias("_hash"))


def _held(rows: DataFrame, items: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs of ``_key`` and ``_item`` with ``_shared`` and ``_n``, for items (_item, _text) of at least ``width`` words."""
    of_items = shingled(items, ["_item"], "_text", width).select("_item", _text(width).alias("_shingle"), _hash(width).alias("_hash")).distinct()
    sizes = of_items.groupBy("_item").agg(F.count(F.lit(1)).alias("_n"))
    of_items = store(of_items.join(sizes, of_items["_item"].eqNullSafe(sizes["_item"])).drop(sizes["_item"]), "items")
    sketch = store(signatures(of_items, threshold), "signatures")
    few = sketch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    hashed = shingled(rows, ["_key"], "_text", width).select("_key", _hash(width).alias("_hash"))
    met = hashed.join(F.broadcast(sketch) if few else sketch, "_hash")
    candidates = store(met.select("_key", "_item").distinct(), "candidates")

    # Exact verification: only texts of candidate documents, only shingles of their items.
    wanted = candidates.select(F.col("_key").alias("_wanted")).distinct()
    again = shingled(rows.join(wanted, F.col("_key").eqNullSafe(F.col("_wanted")), "left_semi"), ["_key"], "_text", width)
    again = again.select("_key", _text(width).alias("_shingle"))
    sure = of_items.select("_item", "_n", "_shingle")
    few = few and sure.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = again.join(F.broadcast(sure) if few else sure, "_shingle").distinct()
    counted = found.groupBy("_key", "_item", "_n").agg(F.count(F.lit(1)).alias("_shared")).filter(F.col("_shared") >= F.col("_n") * threshold - 1e-9)
    pairs = candidates.withColumnsRenamed({"_key": "_k", "_item": "_i"})
    return counted.join(pairs, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_item").eqNullSafe(F.col("_i")), "left_semi")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE,
) -> DataFrame:
    """3. Pairs of document key and item with ``shared`` and ``shingles`` (distinct, of the item) and their ratio ``containment``."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    items = benchmark.select(F.col(item).alias("_item"), F.col(item_text).alias("_text"))
    n = F.least(F.size(words(F.col("_text"))), F.lit(width))
    # At most ``width`` numbers. Items of one width and more go together.
    widths = sorted({r["n"] for r in items.select(n.alias("n")).distinct().collect()} - {0}) or [width]
    verified = None
    for own in widths:
        found = _held(rows, items.filter(n == own), own, threshold)
        verified = found if verified is None else verified.unionByName(found)
    return verified.select(
        F.col("_key").alias(key),
        F.col("_item").alias(item),
        F.col("_shared").alias("shared"),
        F.col("_n").alias("shingles"),
        (F.col("_shared") / F.col("_n")).alias("containment"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """3. Rows of documents that hold no item."""
    name = unused(docs, "_held")
    held = contaminated(docs, benchmark, key, text).select(F.col(key).alias(name)).distinct()
    return docs.join(held, F.col(key).eqNullSafe(F.col(name)), "left_anti")
