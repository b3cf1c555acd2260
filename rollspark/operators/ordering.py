"""Seeded global order without a global sort.

The order hash is uniform, so its leading digits cut the rows into ``BLOCKS``
even pieces. Each piece is numbered on its own and shifted by the rows before
it; the table of shifts has at most ``BLOCKS`` rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rollspark.functions.determinism import hash_block, int_div, order_hash
from rollspark.operators.skew import equi_join, sum_over_blocks

SHORT_HEAD = 10_000
STORED_ROWS = 1 << 16  # of a block of a stored order
STORED_BLOCKS = 1 << 14


def _hashed(rows: DataFrame, key: str | Sequence[str], seed, by: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    keys = [key] if isinstance(key, str) else list(key)
    hashed = rows.withColumn("_hash", order_hash(seed, *[F.col(k) for k in by or keys]))
    return hashed.withColumn("_block", hash_block(F.col("_hash"))), ["_hash", *keys]


def hash_ordinal(
    rows: DataFrame,
    key: str | Sequence[str],
    seed,
    out: str = "ordinal",
    upto: Column | int | None = None,
    only: Column | int | None = None,
    hashed: Sequence[str] | None = None,
) -> DataFrame:
    """0-based position of each row in the seeded order of its unique ``key``.

    ``hashed`` names the columns that are hashed if they are not the whole key.

    With ``upto`` only the first that many rows are returned, with ``only`` the
    row at that one position; rows of other blocks are gone before anything is
    shuffled.
    """
    placed, order = _hashed(rows, key, seed, hashed)
    counts = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    # One window over at most BLOCKS rows.
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_block", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    if only is not None:
        only = only if isinstance(only, Column) else F.lit(only)
        shifts = shifts.filter((F.col("_shift") <= only) & (only < F.col("_shift") + F.col("_n")))
    shifts = shifts.drop("_n")
    if upto is not None:
        upto = upto if isinstance(upto, Column) else F.lit(upto)
        shifts = shifts.filter(F.col("_shift") < upto)
    placed = placed.join(F.broadcast(shifts), "_block")
    inside = Window.partitionBy("_block").orderBy(*order)
    numbered = placed.withColumn(out, F.row_number().over(inside) - 1 + F.col("_shift"))
    if upto is not None:
        numbered = numbered.filter(F.col(out) < upto)
    if only is not None:
        numbered = numbered.filter(F.col(out) == only)
    numbered = numbered.withColumn(out, F.col(out).cast("long"))
    return numbered.drop("_hash", "_block", "_shift")


def hash_ordinal_within(
    rows: DataFrame,
    within: Sequence[str],
    key: str | Sequence[str],
    seed,
    out: str = "ordinal",
    cut: tuple[Column, Column] | None = None,
) -> DataFrame:
    """As ``hash_ordinal``, numbered anew for each value of ``within``.

    ``cut`` is a condition that holds for one of these values, and how many of
    its first rows are wanted: blocks behind them are gone before the shuffle. A
    few more rows may come back, those of the block in which the last one lies.
    """
    hashed, order = _hashed(rows, key, seed)
    if cut is not None:
        where, wanted = cut
        counts = hashed.filter(where).groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
        # One window over at most BLOCKS rows.
        earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        begins = counts.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
        last = begins.filter(F.col("_shift") < wanted).agg(F.max("_block")).scalar()
        hashed = hashed.filter(F.when(where, F.col("_block") <= last).otherwise(F.lit(True)))
    numbered = sum_over_blocks(hashed.withColumn("_value", F.lit(1).cast("long")), within, order, out)
    return numbered.withColumn(out, F.col(out) - 1).drop("_hash")


def _tie(rows: DataFrame) -> Column:
    """Orders rows of one key by what they hold; columns that cannot be hashed do not count."""
    return F.xxhash64(*[F.col(f.name) for f in rows.schema.fields if "map" not in f.dataType.simpleString()])


def seeded_head(rows: DataFrame, n: int, key: str | Sequence[str], seed, out: str = "position") -> DataFrame:
    """A8. First ``n`` rows of the seeded shuffle, with their position.

    Rows of a repeated key follow one another, in the order of a hash of the whole row.
    A short head is a top-n of hashes and keys per task and a merge, and the
    rows are looked up by key and place within the key, so that whole rows never meet
    in one task; a long one goes by blocks. Both give the same rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    tied = rows.withColumn("_tie", _tie(rows))
    if n > SHORT_HEAD:
        return hash_ordinal(tied, [*keys, "_tie"], seed, out, upto=n, hashed=keys).drop("_tie")
    order = ["_hash", *keys, "_tie"]
    head = tied.select(order_hash(seed, *[F.col(k) for k in keys]).alias("_hash"), *keys, "_tie").orderBy(*order).limit(max(n, 0))
    # Windows over at most SHORT_HEAD rows of hash and key.
    position = (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_tie"))
    placed = head.select(*keys, place.alias("_place"), position.alias(out))
    # Only the rows of the head, and others that equal its last of a key in all columns, meet to be numbered.
    lasts = head.groupBy(*keys).agg(F.max("_tie").alias("_last"))
    wanted = equi_join(tied, F.broadcast(lasts), keys, "inner").filter(F.col("_tie") <= F.col("_last")).drop("_last")
    numbered = wanted.withColumn("_place", place)
    return equi_join(numbered, F.broadcast(placed), [*keys, "_place"], "inner").drop("_place", "_tie")


@dataclass(frozen=True)
class StoredOrder:
    """A9, A10, C1. A seeded order written once: rows with their ``position``, in a folder for each block of it.

    ``first`` has the position of each block's first row, and ``size`` the number of
    rows, so size, place and batches are known without a look at the rows.
    """

    spark: SparkSession
    path: str
    first: tuple[int, ...]
    size: int

    @classmethod
    def write(
        cls, rows: DataFrame, key: str | Sequence[str], seed, path: str, block_rows: int = STORED_ROWS, most: int = STORED_BLOCKS
    ) -> StoredOrder:
        """Blocks are runs of ``block_rows`` positions, or longer ones if there were more than ``most`` of them."""
        spark = rows.sparkSession
        size = rows.count()
        length = max(block_rows, -(-size // most))
        numbered = hash_ordinal(rows, key, seed, "position").withColumn("block", int_div(F.col("position"), length))
        numbered.repartition("block").sortWithinPartitions("block", "position").write.partitionBy("block").parquet(f"{path}/rows")
        first = tuple(range(0, size, length))
        # The schema, for an order without rows too, and what the blocks are.
        numbered.limit(0).write.parquet(f"{path}/shape")
        _small(spark, first, size).write.parquet(f"{path}/blocks")
        return cls(spark, path, first, size)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoredOrder:
        found = spark.read.parquet(f"{path}/blocks").collect()  # one row for each block, and one for the size
        return cls(spark, path, tuple(sorted(r["first"] for r in found if r["first"] >= 0)), next(r["size"] for r in found if r["first"] < 0))

    def rows(self) -> DataFrame:
        """All rows with ``position`` and ``block``."""
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/shape").schema).parquet(f"{self.path}/rows")

    def at(self, *positions: int) -> DataFrame:
        """A9. The rows at these positions, negative ones from the end; none for one that is out of range. Reads their blocks alone."""
        wanted = [p + self.size if p < 0 else p for p in positions]
        blocks = sorted({bisect_right(self.first, p) - 1 for p in wanted if 0 <= p < self.size})
        return self.rows().filter(F.col("block").isin(blocks) & F.col("position").isin(wanted)).drop("block")

    def batches(self, batch_size: int, first: int = 0, upto: int | None = None) -> DataFrame:
        """C1. The rows of batches ``first`` up to ``upto``, with ``batch_no`` and ``batch_idx``; reads the blocks that hold them."""
        begin, end = first * batch_size, self.size if upto is None else min(upto * batch_size, self.size)
        low, high = bisect_right(self.first, begin) - 1, bisect_right(self.first, max(end - 1, 0)) - 1
        at = F.col("position")
        inside = self.rows().filter(F.col("block").between(low, high) & (at >= begin) & (at < end))
        batch_idx = F.pmod(at, F.lit(batch_size)).cast("int")
        return inside.withColumn("batch_no", int_div(at, batch_size)).withColumn("batch_idx", batch_idx).drop("block", "position")


def _small(spark: SparkSession, first: Sequence[int], size: int) -> DataFrame:
    return spark.createDataFrame([(f, None) for f in first] + [(-1, size)], "first long, size long").coalesce(1)
