import hashlib

import pytest
from pyspark.sql import functions as F

from rollspark.functions.determinism import uniform
from rollspark.operators import batching, ordering


def ordered(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_order_does_not_depend_on_partitions(spark, partitions):
    rows = spark.range(2000).withColumnRenamed("id", "k").repartition(partitions)
    got = [r["k"] for r in ordering.hash_ordinal(rows, "k", 42).orderBy("ordinal").collect()]
    assert got == ordered(range(2000), 42)


@pytest.mark.parametrize("n", [0, 1, 300, 5000])
def test_heads(spark, monkeypatch, n):
    rows = spark.range(2000).withColumnRenamed("id", "k").repartition(5)
    expected = list(enumerate(ordered(range(2000), 7)[:n]))
    for short in (10_000, -1):  # top-n, then by blocks
        monkeypatch.setattr(ordering, "SHORT_HEAD", short)
        head = ordering.seeded_head(rows, n, "k", 7)
        assert sorted((r["position"], r["k"]) for r in head.collect()) == expected


def test_order_within(spark):
    rows = spark.range(900).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g")).repartition(5)
    got = ordering.hash_ordinal_within(rows, ["g"], "k", 42).collect()
    for g in range(3):
        ours = [r["k"] for r in sorted(got, key=lambda r: r["ordinal"]) if r["g"] == g]
        assert ours == ordered(range(g, 900, 3), 42)


def test_uniform_is_even(spark):
    stats = spark.range(20000).select(uniform(1, F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= stats[0] < 0.01 and 0.99 < stats[1] < 1 and abs(stats[2] - 0.5) < 0.01


@pytest.mark.parametrize("n,size", [(10, 3), (9, 3), (1, 4), (0, 2)])
def test_micro_batches(spark, n, size):
    rows = spark.range(n).withColumnRenamed("id", "problem_id")
    got = sorted((r["batch_no"], r["batch_idx"], r["problem_id"]) for r in batching.micro_batches(rows, size, 42).collect())
    assert got == [(i // size, i % size, k) for i, k in enumerate(ordered(range(n), 42))]


@pytest.mark.parametrize("n,size,steps,acc,rank", [(5, 2, 4, 2, 0), (5, 2, 1, 1, 1), (4, 2, 3, 2, 0), (0, 2, 3, 2, 0)])
def test_epochs(spark, n, size, steps, acc, rank):
    rows = spark.range(n).withColumnRenamed("id", "problem_id").repartition(3)
    got = batching.epoch_schedule(rows, size, steps, acc, 42, rank).collect()
    expected, draw, epoch = [], 0, 0
    while n and draw < steps * acc:
        order = ordered(range(n), f"{42 + rank}:{epoch}")
        for b in range(0, n, size):
            if draw < steps * acc:
                for i, k in enumerate(order[b : b + size]):
                    expected.append((draw // acc, draw % acc, i, k, epoch))
                draw += 1
        epoch += 1
    assert sorted((r["step"], r["acc"], r["batch_idx"], r["problem_id"], r["epoch"]) for r in got) == sorted(expected)


def test_fan_out(spark):
    got = batching.fan_out(spark.range(2), 3).collect()
    assert sorted(map(tuple, got)) == [(i, g) for i in range(2) for g in range(3)]
    with pytest.raises(ValueError):
        batching.fan_out(spark.range(2), 0)


def test_pad_batch(spark):
    rows = spark.createDataFrame(
        [(0, 0, [1, 2, 3], 1), (1, 0, [4], 0), (2, 1, [5, 6], 4)], "seq int, b int, ids array<int>, prompt_len int"
    )
    got = {r["seq"]: r for r in batching.pad_batch(rows, ["b"], eos_id=9).collect()}
    assert [got[i]["ids"] for i in range(3)] == [[1, 2, 3], [4, 9, 9], [5, 6]]
    assert [got[i]["attention_mask"] for i in range(3)] == [[1, 1, 1], [1, 0, 0], [1, 1]]
    assert [got[i]["loss_mask"] for i in range(3)] == [[0, 1, 1], [0, 0, 0], [0, 0]]
    assert batching.pad_batch(rows, ["b"]).filter("seq = 1").first()["ids"] == [4, 0, 0]


def test_depth_is_a_clamped_poisson(spark):
    depth, backward = batching.sample_depth(F.col("id"))
    got = spark.range(20000).select(depth.alias("d"), backward.alias("b"))
    share = {r["d"]: r["count"] / 20000 for r in got.groupBy("d").count().collect()}
    assert min(share) == 1 and max(share) <= 8
    assert abs(share[1] - 0.406) < 0.015 and abs(share[2] - 0.2707) < 0.015
    assert got.filter("b != ceil(d / 2)").count() == 0


def test_heads_of_repeated_keys_are_the_same_short_and_long(spark, monkeypatch):
    rows = [(i % 3, i % 7, f"t{i % 5}") for i in range(60)] + [(1, 1, "same")] * 9
    df = spark.createDataFrame(rows, "k int, v int, t string").repartition(4)
    for n in (0, 1, 3, 20, 45, 69, 100):
        short = sorted(tuple(r) for r in ordering.seeded_head(df, n, "k", 1).collect())
        with monkeypatch.context() as patch:
            patch.setattr(ordering, "SHORT_HEAD", -1)
            long = sorted(tuple(r) for r in ordering.seeded_head(df, n, "k", 1).collect())
        assert short == long
        assert sorted(r[3] for r in short) == list(range(min(n, len(rows))))


def files_read(df):
    return df.select(F.input_file_name()).distinct().count()


def test_a_stored_order_is_read_by_blocks(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("t")).repartition(5)
    order = ordering.StoredOrder.write(rows, "k", 7, str(tmp_path / "order"), block_rows=100)
    ids = ordered(range(2000), 7)
    again = ordering.StoredOrder.open(spark, order.path)
    assert again == order and order.size == 2000 and len(order.first) == 20
    got = again.at(5, -1, 0, 2000, -2001)
    assert {r["position"]: r["k"] for r in got.collect()} == {0: ids[0], 5: ids[5], 1999: ids[-1]}
    assert files_read(again.at(5)) == 1
    plan = again.at(5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan or "PartitionFilters: [block" in plan
    batch = {(r["batch_no"], r["batch_idx"]): r["k"] for r in again.batches(8, 3, 30).collect()}
    assert batch == {(i // 8, i % 8): ids[i] for i in range(24, 240)}
    assert files_read(again.batches(8, 3, 30)) == 3
    assert again.batches(8).count() == 2000 and again.batches(3000).count() == 2000
    few = ordering.StoredOrder.write(rows, "k", 7, str(tmp_path / "few"), block_rows=1, most=4)
    assert len(few.first) == 4 and few.at(1500).first()["k"] == ids[1500]
    none = ordering.StoredOrder.write(rows.limit(0), "k", 7, str(tmp_path / "none"))
    assert none.size == 0 and none.at(0).count() == 0 and none.batches(8).count() == 0
    assert ordering.StoredOrder.open(spark, none.path) == none
