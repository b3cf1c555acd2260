"""Sharding by an external shuffle in two passes.

First pass: a seeded hash of all its columns scatters every record into one of the buckets,
uniformly, so that each is about ``bucket_bytes`` long and fits into memory. Second
pass: every bucket is shuffled by Fisher-Yates (Spark's ``shuffle`` of an array) and
written. Buckets on end are one random order of all records, cut into shards of
consecutive records whose numbers differ by one at most. A bucket reaches into few
shards, so there are about as many files as buckets and shards together.

Bucket b is partition b of the scatter, and its records are sorted before they are
shuffled, so a lost task gives the same order again, and the same seed, key and
number of buckets the same shards on any cluster.

Null and empty texts and null keys are records like any other, and keys need not be
distinct. Records that are equal in all columns would meet in one bucket: those that
take more than 1/``PARTS`` of one are stored with a number each and scattered by that
too, so their order depends on how the input is dealt. Maps have no hash and do not
count for equality. Sizes are of all columns. An empty table gives no records. All
columns are kept, within ``record``, and clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollspark.functions.determinism import int_div
from rollspark.llm.common import store
from rollspark.session import fresh_dir

ROW_BYTES = 16  # of a record besides its texts
BUCKET_BYTES = 32 << 20
PARTS = 4


def _bytes(docs: DataFrame) -> Column:
    """Bytes of a record: ROW_BYTES, and what its texts and nested columns hold."""
    size = F.lit(ROW_BYTES).cast("long")
    for name, kind in docs.dtypes:
        held = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(held), F.lit(0))
        elif "<" in kind or kind == "variant":
            size += F.coalesce(F.octet_length(F.to_json(F.struct(held))), F.lit(0))
    return size


def shard(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES, path: str | None = None,
) -> DataFrame:
    """1. Write the records in random order as ``shards`` shards, and read them back: ``shard``, ``slot`` and ``record``.

    The files go to ``path``, by default a new folder in the shared one, with a folder for each shard.
    """
    plain = [c for c, kind in docs.dtypes if c not in (key, text) and "map<" not in kind and "variant" not in kind]
    own = F.xxhash64(F.lit(seed), key, text, *[F.col(f"`{c}`") for c in plain])
    equal = docs.select(own.alias("_own"), _bytes(docs).alias("_size")).groupBy("_own").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_size"))
    equal = store(equal, "equal-records")
    total, size = equal.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))

    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    rows = docs.select(record, own.alias("_own"), F.xxhash64(text).alias("_text"), F.lit(0).cast("long").alias("_number"))
    # Fewer than PARTS for each bucket, by their definition.
    often = equal.filter((F.col("_n") > 1) & (F.col("_size") * PARTS > bucket_bytes)).select("_own")
    if buckets > 1 and often.limit(1).count():
        numbered = rows.join(F.broadcast(often), "_own", "left_semi").withColumn("_number", F.monotonically_increasing_id())
        rows = rows.join(F.broadcast(often), "_own", "left_anti").unionByName(store(numbered, "equal-numbered"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "_own", "_number"), F.lit(buckets)).cast("int")
    rank = F.xxhash64(F.lit(seed + 1), "_own", "_number")
    counts = rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per bucket, and a bucket is a task: one window over these is as small as the scheduler's own list.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))

    records = rows.select("record", bucket.alias("_bucket"), rank.alias("_rank"), "_text")
    scattered = records.repartitionById(buckets, "_bucket").sortWithinPartitions("_bucket", "_rank", "_text")
    gathered = scattered.groupBy("_bucket").agg(F.collect_list("record").alias("_records"))
    shuffled = gathered.select("_bucket", F.posexplode(F.shuffle("_records", F.lit(seed))).alias("_at", "record"))
    at = F.col("_at") + F.col("_offset")
    each, more = divmod(total, shards)
    longer = more * (each + 1)  # records in shards that hold one more than the others
    of_longer = F.struct(int_div(at, each + 1).alias("shard"), (at % (each + 1)).alias("slot"))
    rest = at - longer
    of_rest = F.struct((more + int_div(rest, max(each, 1))).alias("shard"), (rest % max(each, 1)).alias("slot"))
    place = F.when(at < longer, of_longer).otherwise(of_rest)
    placed = shuffled.join(F.broadcast(offsets), "_bucket").select(place.alias("_place"), "record")
    placed = placed.select(F.col("_place.shard").cast("int").alias("shard"), F.col("_place.slot").cast("long").alias("slot"), "record")
    path = path or fresh_dir(docs.sparkSession, "shards")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    schema = placed.select("slot", "record", "shard").schema
    return docs.sparkSession.read.schema(schema).parquet(path)
