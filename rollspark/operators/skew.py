"""Joins and running sums that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollspark.session import fresh_dir

# Only keys with more than SPLIT_ROWS rows are worth splitting, and of these only such with more than
# 1/SPLITS of all rows, so that there are at most SPLITS of them.
SPLITS = 1024
SPLIT_ROWS = 100_000
TRACKED = 16  # counters of the sketch for each of these: its error is 3.5/16 of such a key's rows

BLOCK_ROWS = 1 << 18
BLOCKS = 1 << 16  # blocks are made so large that about so many do
SAMPLE_ROWS = 1 << 22
DIGIT_BITS = 5
LONG_BITS = 64


def _local(spark, **columns: list[int]) -> DataFrame:
    """A small table of longs."""
    return spark.createDataFrame(pa.table({name: pa.array(values, pa.int64()) for name, values in columns.items()}))


def equi_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, salt: Sequence[str] = ()
) -> DataFrame:
    """Join on equal keys, null matching null, and on a salt that is never null. Keeps the left key columns."""
    shared = [*keys, *salt]
    others = [c for c in right.columns if c not in shared]
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in shared], *others)
    matches = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col(k) == F.col(f"_r_{k}") for k in salt]
    return left.join(renamed, reduce(lambda a, b: a & b, matches), how).drop(*[f"_r_{k}" for k in shared])  # no-op in a semi join


def pair_up(left: DataFrame, right: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Inner join on equal keys; ``strict`` raises when a row of ``left`` has no partner instead of leaving it out."""
    if not strict:
        return left.join(right, list(keys))
    joined = left.join(right.withColumn("_partner", F.lit(True)), list(keys), "left")
    found = F.coalesce("_partner", F.raise_error(F.lit(f"a row has no partner by {', '.join(keys)}")).cast("boolean"))
    # A filter on the check, so that it is computed whatever columns are read.
    return joined.filter(found).drop("_partner")


def mark_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], mark: str, strict: bool = False) -> DataFrame:
    """All rows of ``left`` with their partner's columns, null without one, and whether there is one in ``mark``."""
    joined = left.join(right.withColumn(mark, F.lit(True)), list(keys), "left")
    missing = F.raise_error(F.lit(f"a row has no partner by {', '.join(keys)}")).cast("boolean") if strict else F.lit(False)
    return joined.withColumn(mark, F.coalesce(mark, missing))


@dataclass(frozen=True)
class HeavyKeys:
    """Keys with many rows by the hash of their columns, and about how many rows each has.

    Taken once from a narrow table, it serves all joins of rows with these keys. Hashes that two keys share do no harm.
    """

    counts: dict[int, int]

    def __bool__(self) -> bool:
        return bool(self.counts)

    def holds(self, hashed: Column) -> Column:
        return hashed.isin(list(self.counts))


def hash_of(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def heavy_keys(rows: DataFrame, keys: Sequence[str], split_rows: int = SPLIT_ROWS, splits: int = SPLITS) -> HeavyKeys:
    """The keys with more than ``split_rows`` rows and more than 1/``splits`` of all rows.

    Each task keeps a sketch of its frequent keys, and the sketches are merged: one pass
    over the key columns, no shuffle by key, at most ``splits`` hashes to the driver.
    The counts are estimates, none of a heavy key is missed. This runs at once.
    """
    top = F.expr(f"approx_top_k(_key, {splits}, {splits * TRACKED})")
    found = rows.select(hash_of(keys).alias("_key")).agg(top.alias("top"), F.count(F.lit(1)).alias("n")).first()
    least = max(split_rows, found["n"] // splits)
    # A count may be too low by the sketch's error.
    return HeavyKeys({r["item"]: r["count"] for r in found["top"] or [] if r["count"] + 3.5 * found["n"] / (splits * TRACKED) > least})


def skew_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
    heavy: HeavyKeys | None = None,
    split_rows: int = SPLIT_ROWS,
    splits: int = SPLITS,
) -> DataFrame:
    """N:1 join of ``rows`` to a computed ``lookup``, unique on ``keys``.

    Adaptive execution splits skewed joins of plain tables by itself, but not
    when one side comes straight out of an aggregate or a window. Here rows of a
    heavy key are spread over pieces of about ``split_rows`` by a hash of
    ``spread_by`` (the row key; all columns if not given), and its one lookup
    row is copied to each piece. Every other key joins as usual in piece 0, and
    without heavy keys it is a plain join. ``heavy`` saves the look for them.
    """
    keys = list(keys)
    if heavy is None:
        heavy = heavy_keys(rows, keys, split_rows, splits)
    if not heavy:
        return equi_join(rows, lookup, keys, how)
    # At most ``splits`` rows.
    pieces = F.broadcast(_local(rows.sparkSession, _hash=list(heavy.counts), _pieces=[-(-n // split_rows) for n in heavy.counts.values()]))
    spread = F.xxhash64(*[F.col(c) for c in (spread_by or rows.columns)])
    salt = F.when(F.col("_pieces").isNotNull(), F.pmod(spread, F.col("_pieces"))).otherwise(0).cast("int")
    salted = rows.withColumn("_hash", hash_of(keys)).join(pieces, "_hash", "left").select(*rows.columns, salt.alias("_salt"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)).cast("int") - 1))
    copied = lookup.withColumn("_hash", hash_of(keys)).join(pieces, "_hash", "left").select(*lookup.columns, copies.alias("_salt"))
    return equi_join(salted, copied, keys, how, ["_salt"]).drop("_salt")


def with_group_stats(
    rows: DataFrame,
    keys: Sequence[str],
    aggregates: dict[str, Column],
    heavy: HeavyKeys | None = None,
    split_rows: int = SPLIT_ROWS,
    splits: int = SPLITS,
) -> DataFrame:
    """Attach aggregates (fixed-size values) of each row's group to the row.

    A window over the group, which reads and shuffles the rows once. Rows of heavy groups are
    not shuffled at all: their few aggregates combine before the shuffle and come back to
    them as a broadcast of at most ``splits`` rows. ``heavy`` saves the look for them.
    """
    keys = list(keys)
    if heavy is None:
        heavy = heavy_keys(rows, keys, split_rows, splits)
    window = Window.partitionBy(*keys)
    windowed = {name: column.over(window) for name, column in aggregates.items()}
    if not heavy:
        return rows.withColumns(windowed)
    is_hot = heavy.holds(hash_of(keys))
    hot = rows.filter(is_hot)
    stats = hot.groupBy(*keys).agg(*[column.alias(name) for name, column in aggregates.items()])
    return rows.filter(~is_hot).withColumns(windowed).unionByName(equi_join(hot, F.broadcast(stats), keys, "left"))


def sum_over_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Running sum of ``_value`` within ``keys``, over rows cut into ordered pieces by ``_block``.

    The total of a group's earlier blocks enters each block as one more row in
    front of it, so that a single shuffle by group and block does. Totals of a
    group's blocks meet in one window. Uses up ``_value`` and ``_block``.
    """
    keys = list(keys)
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_block", F.sum("_total").over(earlier).alias("_value"))
    carried = before.filter(F.col("_value").isNotNull()).withColumn("_row", F.lit(0))
    both = rows.withColumn("_row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    inside = (
        Window.partitionBy(*keys, "_block").orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return both.withColumn(out, F.sum("_value").over(inside)).filter(F.col("_row") == 1).drop("_value", "_block", "_row")


def arrival_number(rows: DataFrame, order: str) -> Column:
    """The order column as a long: whole numbers as they are, timestamps in microseconds, dates in days."""
    kind = rows.schema[order].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(order).cast("timestamp"))
    if kind == "date":
        return F.unix_date(order).cast("long")
    if kind in ("byte", "short", "integer", "long"):
        return F.col(order).cast("long")
    raise TypeError(f"{order} must be a whole number, a timestamp or a date, not {kind}")


def _prefix(level: int) -> Column:
    """Leading ``level`` digits of a number; no digit is the whole group."""
    bits = max(LONG_BITS - DIGIT_BITS * level, 0)
    return F.shiftright("_number", bits) if level else F.lit(0).cast("long")


def crowded_ranges(numbers: DataFrame, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS) -> list[list[tuple[int, int]]] | None:
    """Which ranges of a group's numbers hold more than a block of rows, level by level; none if the whole table is one block.

    ``numbers`` has the group's hash ``_group`` and ``_number``. Ranges are those of
    equal leading digits; a crowded one is looked into by its next digit. They are
    found on a sample of at most about ``sample_rows`` rows, chosen by hash, and
    there are at most BLOCKS of them in a level. This runs at once.
    """
    total = numbers.count()
    if total <= block_rows:
        return None
    block_rows = max(block_rows, total // BLOCKS)
    stride = max(1, total // sample_rows)
    sample = numbers.filter(F.pmod(F.xxhash64("_number", "_group"), F.lit(stride)) == 0) if stride > 1 else numbers
    spark = numbers.sparkSession
    path = fresh_dir(spark, "numbers")
    sample.write.parquet(path)
    left = spark.read.schema(sample.schema).parquet(path)
    levels = []
    for level in range(-(-LONG_BITS // DIGIT_BITS) + 1):
        counts = left.groupBy("_group", _prefix(level).alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
        found = counts.filter(F.col("_n") * stride > block_rows).collect()  # at most BLOCKS and what the sample errs
        if not found:
            break
        levels.append([(r["_group"], r["_prefix"]) for r in found])
        left = left.withColumn("_prefix", _prefix(level)).join(F.broadcast(_ranges(spark, levels[-1])), ["_group", "_prefix"]).drop("_prefix")
    return levels


def _ranges(spark, ranges: list[tuple[int, int]]) -> DataFrame:
    groups, prefixes = zip(*ranges)
    return _local(spark, _group=list(groups), _prefix=list(prefixes))


def in_blocks(rows: DataFrame, keys: Sequence[str], number: Column, levels: list[list[tuple[int, int]]]) -> DataFrame:
    """Adds ``_block``, the least number of the row's block. A block is the widest range that is not crowded."""
    spark = rows.sparkSession
    placed = rows.withColumn("_group", hash_of(keys)).withColumn("_number", number)
    block = F.lit(-(1 << (LONG_BITS - 1))).cast("long")
    for level, ranges in enumerate(levels):
        crowded = F.broadcast(_ranges(spark, ranges).withColumnRenamed("_prefix", f"_p{level}").withColumn(f"_crowded{level}", F.lit(True)))
        placed = placed.withColumn(f"_p{level}", _prefix(level)).join(crowded, ["_group", f"_p{level}"], "left")
        bits = max(LONG_BITS - DIGIT_BITS * (level + 1), 0)
        block = F.when(F.col(f"_crowded{level}"), F.shiftleft(F.shiftright("_number", bits), bits)).otherwise(block)
    return placed.withColumn("_block", block).select(*rows.columns, "_block")


def running_sum(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    block_rows: int = BLOCK_ROWS,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` in the order of ``order``.

    ``order`` is a whole number of any size and sign, a timestamp or a date, not
    null and unique within its group; ``ties`` name columns that order equals. A table of
    more than ``block_rows`` rows is cut: each group into ranges of numbers that hold about that many
    rows at most, however the numbers lie, so that no window grows with the group. (Rows of one
    and the same number stay together.) Rows are counted, and a sample looked at, at once.
    """
    keys = list(keys)
    number = F.coalesce(arrival_number(rows, order), F.raise_error(F.lit(f"{order} must not be null")).cast("long"))
    levels = crowded_ranges(rows.select(hash_of(keys).alias("_group"), number.alias("_number")), block_rows)
    if not levels:
        checked = rows.withColumn("_number", number)
        window = Window.partitionBy(*keys).orderBy("_number", *ties).rowsBetween(Window.unboundedPreceding, 0)
        return checked.withColumn(out, F.sum(value).over(window)).drop("_number")
    blocked = in_blocks(rows.withColumn("_value", value), keys, number, levels)
    return sum_over_blocks(blocked, keys, [order, *ties], out)


def group_ordinal(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str,
    block_rows: int = BLOCK_ROWS,
    ties: Sequence[str] = (),
) -> DataFrame:
    """G1. 0-based position of each row within its group, in arrival order."""
    counted = running_sum(rows, keys, order, F.lit(1).cast("long"), out, block_rows, ties)
    return counted.withColumn(out, F.col(out) - 1)
