"""Shared helpers: stored tables, held-out splits, joins on hot keys, column names that clash with nothing."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollspark.session import fresh_dir

# A key with more than 1/HEAVY of all rows is heavy. By that definition there are
# fewer than HEAVY such keys, whatever the size of the table.
HEAVY = 2048
TASK_ROWS = 1 << 18


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Narrow rows of numbers in as many tasks as their number asks for, which may be far fewer than a shuffle has."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(modulus))


def unused(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}{n}"
    return name


def attach(rows: DataFrame, lookup: DataFrame, key: str, count: str) -> DataFrame:
    """Left join of ``rows`` to ``lookup``, a stored table with one row per non-null key and its number of rows in ``count``.

    Rows of heavy keys meet a broadcast of fewer than HEAVY rows and are never
    shuffled; of every other key at most 1/HEAVY of all rows meet in one task.
    """
    total = lookup.agg(F.sum(count)).first()[0] or 0
    heavy = lookup.filter(F.col(count) * HEAVY > F.lit(total)).drop(count)
    light = lookup.filter(F.col(count) * HEAVY <= F.lit(total)).drop(count)
    hot = rows.join(F.broadcast(heavy), key)
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    return hot.unionByName(cold)


def slices(batch: pa.Array, rows: int = 1024) -> Iterator[list]:
    """Values of an Arrow batch, some rows at a time: long texts are not all held twice."""
    for begin in range(0, len(batch), rows):
        yield batch.slice(begin, rows).to_pylist()


def share(spark: SparkSession, model: object) -> Callable[[], object]:
    """Broadcast of a model of bounded size; call the result in a task to get it. Its class travels with it."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(packed.value)
