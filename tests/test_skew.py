"""Hot keys: the same results whether or not a key is split."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import Window, functions as F

from rollspark.operators import skew


@pytest.fixture(scope="module")
def rows(spark):
    # One key, a null one at that, holds over a third of the rows.
    rng = random.Random(1)
    keys = [None if rng.random() < 0.4 else rng.randrange(40) for _ in range(3000)]
    data = [(i, k, float(rng.randrange(3)), i * 37) for i, k in enumerate(keys)]
    return spark.createDataFrame(data, "id int, k int, v double, seq long").repartition(7)


def grouped(rows):
    groups = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r["seq"]):
        groups[r["k"]].append(r)
    return groups


@pytest.mark.parametrize("split_rows", [10, 100, skew.SPLIT_ROWS])
def test_group_stats(rows, split_rows):
    joined = skew.with_group_stats(
        rows, ["k"], {"n": F.count(F.lit(1)), "total": F.sum("v"), "nothing": F.max(F.lit(None).cast("int"))},
        split_rows=split_rows,
    )
    assert joined.columns == ["id", "k", "v", "seq", "n", "total", "nothing"]
    got = joined.collect()
    groups = grouped(rows)
    assert len(got) == 3000
    for r in got:
        assert r["n"] == len(groups[r["k"]])
        assert r["total"] == sum(x["v"] for x in groups[r["k"]])
        assert r["nothing"] is None


def test_heavy_keys_are_found_and_no_others(spark, rows):
    one = skew.heavy_keys(rows, ["k"], 100)
    hashed = {r["h"]: r["k"] for r in rows.select("k", skew.hash_of(["k"]).alias("h")).distinct().collect()}
    assert [hashed[h] for h in one.counts] == [None]
    many = spark.range(200_000).select((F.col("id") % 50_000).alias("k"), F.lit("x").alias("s"))
    skewed = many.unionAll(many.limit(30_000).select(F.lit(-1).cast("long"), "s")).unionAll(many.limit(900).select(F.lit(-2).cast("long"), "s"))
    hashed = {r["h"]: r["k"] for r in skewed.select("k", skew.hash_of(["k", "s"]).alias("h")).distinct().collect()}
    found = skew.heavy_keys(skewed.repartition(8), ["k", "s"], 100)
    assert sorted(hashed[h] for h in found.counts) == [-2, -1]
    assert all(n <= 31_000 for n in found.counts.values())
    assert not skew.heavy_keys(many, ["k"], 100) and not skew.heavy_keys(many.limit(0), ["k"], 100)


@pytest.mark.parametrize("split_rows", [10, 100, skew.SPLIT_ROWS])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join(spark, rows, split_rows, how):
    lookup = rows.filter("k is null or k % 3 > 0").groupBy("k").agg(F.concat(F.lit("about "), F.max("k")).alias("text"))
    got = skew.skew_join(rows, lookup, ["k"], how, ["id"], split_rows=split_rows).collect()
    matched = [r["id"] for r in rows.collect() if r["k"] is None or r["k"] % 3 > 0]
    assert sorted(r["id"] for r in got) == (sorted(matched) if how == "inner" else list(range(3000)))
    for r in got:
        expected = f"about {r['k']}" if r["k"] is not None and r["k"] % 3 > 0 else None
        assert r["text"] == expected


@pytest.fixture
def plain_shuffles(spark):
    """No broadcast joins and no adaptive help, so that partitions are what the plan makes of them."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "32",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def largest_partition(df):
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def test_heavy_rows_are_spread(rows, plain_shuffles):
    """No partition of the join holds the hot key, with its 1,200 rows, as a whole."""
    lookup = rows.groupBy("k").agg(F.max("v").alias("top"))
    assert largest_partition(skew.skew_join(rows, lookup, ["k"], "inner", ["id"])) > 1100
    assert largest_partition(skew.skew_join(rows, lookup, ["k"], "inner", ["id"], split_rows=100)) < 500
    stats = {"m": F.avg("v")}
    assert largest_partition(skew.with_group_stats(rows, ["k"], stats)) > 1100
    assert largest_partition(skew.with_group_stats(rows, ["k"], stats, split_rows=100)) < 500
    assert largest_partition(skew.group_ordinal(rows, ["k"], "seq", "at", block_rows=200)) < 500


def scans(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len([line for line in plan.splitlines() if "FileScan" in line])


def test_rows_are_read_once(rows, spark, tmp_path):
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    stats = {"m": F.avg("v"), "s": F.stddev_pop("v")}
    assert scans(skew.with_group_stats(stored, ["k"], stats)) == 1
    # Rows of heavy groups are read twice, by themselves.
    assert scans(skew.with_group_stats(stored, ["k"], stats, split_rows=100)) <= 3
    lookup = spark.range(40).select(F.col("id").cast("int").alias("k"))
    assert scans(skew.skew_join(stored, lookup, ["k"], "left", ["id"])) == 1
    assert scans(skew.skew_join(stored, lookup, ["k"], "left", ["id"], split_rows=100)) == 1


def test_heavy_keys_are_handed_on(rows, spark, monkeypatch):
    heavy = skew.heavy_keys(rows, ["k"], 100)
    monkeypatch.setattr(skew, "heavy_keys", None)  # not looked for again
    assert skew.with_group_stats(rows, ["k"], {"n": F.count(F.lit(1))}, heavy).count() == 3000
    assert skew.skew_join(rows, rows.groupBy("k").agg(F.max("v").alias("top")), ["k"], "inner", ["id"], heavy).count() == 3000


@pytest.mark.parametrize("bits", [0, 9, 20])
def test_running_sum_and_ordinal(rows, bits):
    summed = skew.running_sum(rows, ["k"], "seq", F.col("v"), "total", 1 << bits)
    got = skew.group_ordinal(summed, ["k"], "seq", "at", 1 << bits)
    assert got.columns == ["id", "k", "v", "seq", "total", "at"]
    by_id = {r["id"]: r for r in got.collect()}
    assert len(by_id) == 3000
    for group in grouped(rows).values():
        total = 0.0
        for at, r in enumerate(group):
            total += r["v"]
            assert (by_id[r["id"]]["at"], by_id[r["id"]]["total"]) == (at, total)


@pytest.mark.parametrize("block_rows", [1, 3, 1 << 18])
def test_order_may_be_any_whole_number_or_time(spark, block_rows):
    numbers = [-(1 << 63), -(1 << 40), -1, 0, 5, 1 << 40, 1_760_000_000_000_000, (1 << 63) - 1]
    df = spark.createDataFrame([(1, n) for n in numbers], "k int, seq long")
    got = {r["seq"]: r["at"] for r in skew.group_ordinal(df, ["k"], "seq", "at", block_rows).collect()}
    assert got == {n: i for i, n in enumerate(numbers)}
    times = df.filter("seq between 0 and 1760000000000000").withColumn("t", F.timestamp_micros("seq"))
    got = {r["seq"]: r["at"] for r in skew.group_ordinal(times, ["k"], "t", "at", block_rows).collect()}
    assert got == {0: 0, 5: 1, 1 << 40: 2, 1_760_000_000_000_000: 3}


def test_order_of_another_kind_is_an_error(spark):
    with pytest.raises(TypeError, match="whole number"):
        skew.group_ordinal(spark.createDataFrame([(1, "a")], "k int, seq string"), ["k"], "seq", "at")
    with pytest.raises(Exception, match="must not be null"):
        skew.group_ordinal(spark.createDataFrame([(1, None)], "k int, seq long"), ["k"], "seq", "at").collect()


@pytest.mark.parametrize("kind", ["random", "micros", "dense", "clustered"])
def test_blocks_hold_rows_not_numbers(spark, kind):
    """Totals of blocks are few, and no block is much larger than asked for, however the numbers lie."""
    n, block_rows = 200_000, 4096
    i = F.col("id")
    number = {
        "random": F.xxhash64("id"),
        "micros": F.lit(1_760_000_000_000_000) + i * 1_000_003,
        "dense": i,
        "clustered": F.when(i % 2 == 0, i).otherwise((i % 7) * F.lit(1 << 50) + i),
    }[kind]
    rows = spark.range(n).select(F.when(i % 3 == 0, 0).otherwise(i % 50).cast("int").alias("k"), number.cast("long").alias("seq"))
    numbers = rows.select(skew.hash_of(["k"]).alias("_group"), F.col("seq").alias("_number"))
    for sample_rows in (1 << 22, 50_000):
        levels = skew.crowded_ranges(numbers, block_rows, sample_rows)
        blocks = skew.in_blocks(rows, ["k"], F.col("seq"), levels).groupBy("k", "_block").count()
        counted, largest = blocks.agg(F.count(F.lit(1)), F.max("count")).first()
        assert counted - 50 < 40 * n / block_rows and largest < 1.5 * block_rows
    got = skew.group_ordinal(rows, ["k"], "seq", "at", block_rows)
    wrong = got.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("seq")) - 1).filter("rn <> at")
    assert wrong.count() == 0 and got.count() == n


def test_a_table_of_one_block_is_not_cut(rows):
    plan = skew.group_ordinal(rows, ["k"], "seq", "at")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Window") < 3


def test_plain_join_of_a_hot_key_is_split_by_adaptive_execution(spark):
    """J1, J3 and J6 count on this."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    from rollspark.operators.selection import attach_tests

    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
        rows = spark.range(0, 60000, 1, 16).select("id", key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
        problems = spark.range(60000).select(F.col("id").alias("k"), F.lit("x").alias("test"))
        joined = attach_tests(rows, problems, ["k"])
        assert joined.groupBy("test").count().collect()[0]["count"] == 60000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
