import random

import pytest
from pyspark.sql import functions as F

from rollspark.operators import selection as L


@pytest.fixture(scope="module")
def completions(spark):
    # (step, prompt, seq, text, reward, feedback); prompt 2 of step 0 appears first
    rows = [
        (0, 2, 10, "a", 0.0, "bad a"),
        (0, 1, 11, "b", 1.0, "ok"),
        (0, 2, 12, "c", 1.0, "ok"),
        (0, 2, 13, "d", 1.0, "ok"),
        (0, 3, 14, "e", 0.0, ""),
        (1, 3, 15, "f", 0.0, "bad f"),
    ]
    return spark.createDataFrame(rows, "step int, prompt int, seq long, text string, reward double, feedback string")


def test_demonstrations(completions):
    keys = ["step", "prompt"]
    got = L.demonstrations(completions, keys, "seq").select("prompt", "demo_no", "text").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "b"), (2, 0, "c"), (2, 1, "d")]
    counts = {(r["step"], r["prompt"]): r["n_demos"] for r in L.demonstration_counts(completions, keys).collect()}
    assert counts == {(0, 1): 1, (0, 2): 2, (0, 3): 0, (1, 3): 0}
    firsts = L.first_demonstration(completions, keys, "seq").select("prompt", "demo").collect()
    assert sorted(map(tuple, firsts)) == [(1, "b"), (2, "c")]


def test_feedback_and_teacher_prompts(spark, completions):
    told = L.failure_feedback(completions, ["step", "prompt"], "seq", ["seq"])
    got = {r["text"]: r["sdpo_feedback"] for r in told.collect()}
    assert set(got) == {"a", "e", "f"}
    assert "bad a" in got["a"] and "\nc\n" in got["a"]
    assert "Identify and fix" in got["e"] and "Identify and fix" in got["f"]
    problems = spark.createDataFrame([(2, "two"), (3, "three")], "prompt_id int, prompt string")
    asked = L.teacher_prompts(told.withColumnRenamed("prompt", "prompt_id"), problems, ["prompt_id"])
    prompts = {r["text"]: r["teacher_prompt"] for r in asked.collect()}
    assert prompts["a"].endswith("Now write the corrected code for:\ntwo<end_of_turn>\n<start_of_turn>model\n")
    assert len(prompts) == 3


def test_branches(completions):
    assert sorted(r["text"] for r in L.distill_branch(completions, "feedback").collect()) == ["a", "f"]


@pytest.mark.parametrize("n,expected", [(0, []), (1, [10, 12, 13, 15]), (2, [10, 11, 12, 13, 15]), (9, list(range(10, 16)))])
def test_first_groups(completions, n, expected):
    got = L.first_groups(completions, ["step"], ["prompt"], "seq", n)
    assert sorted(r["seq"] for r in got.collect()) == expected


@pytest.mark.parametrize("n", [1000, 1001])
def test_first_groups_follow_one_rule(spark, n):
    # Negative orders, and prompts that appear at the same time: the smaller key comes first.
    rows = spark.range(3000).select(F.lit(0).alias("step"), "id", (F.col("id") % 1500 - 700).alias("seq"), F.col("id").alias("prompt"))
    got = L.first_groups(rows, ["step"], ["prompt"], "seq", n)
    expected = sorted(range(3000), key=lambda i: (i % 1500 - 700, i))[:n]
    assert sorted(r["prompt"] for r in got.collect()) == sorted(expected)


def test_samples_are_chosen_without_texts(spark, completions, tmp_path):
    completions.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = L.collect_samples(stored, ["step"], "prompt", "seq", 1)
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        assert [s for s in scans if "text" in s.split("ReadSchema")[1]] == scans  # only the last lookup reads the table
        assert len(scans) == 1
        assert df.count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_first_demonstration_sorts_no_texts(completions):
    plan = L.first_demonstration(completions, ["step", "prompt"], "seq")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_samples_of_due_steps(completions):
    got = L.due_samples(completions.withColumn("step", F.col("step") * 7), "step", "prompt", "seq", 1, 10)
    assert {r["step"] for r in got.collect()} == {0}


def test_samples_are_numbered(completions):
    got = L.collect_samples(completions, ["step"], "prompt", "seq", 1).collect()
    assert sorted((r["seq"], r["completion_index"]) for r in got) == [(10, 0), (12, 1), (13, 2), (15, 0)]


@pytest.mark.parametrize("bits", [4, 5, 20])
def test_trailing_mean(spark, bits):
    rng = random.Random(bits)
    runs = {0: 100, 1: 7, 2: 33}
    data = {r: [(s * 3, rng.random()) for s in range(n)] for r, n in runs.items()}
    rows = [(r, s, v) for r, steps in data.items() for s, v in steps]
    df = spark.createDataFrame(rows, "run int, step long, sec double").repartition(5)
    got = L.trailing_mean(df, ["run"], "step", "sec", block_rows=1 << bits).collect()
    assert len(got) == len(rows)
    for r in got:
        values = [v for s, v in data[r["run"]] if s <= r["step"]][-10:]
        assert r["trailing_mean"] == pytest.approx(sum(values) / len(values))


def test_cadence(spark):
    steps = spark.range(401).withColumnRenamed("id", "step")
    c = F.col("step")

    def due(condition):
        return [r["step"] for r in steps.filter(condition).collect()]

    assert due(L.progress_due(c, 100)) == [0, 1, 2, 3, 4, 100, 200, 300, 400]
    assert due(L.periodic_due(c, 200)) == [200, 400]
    assert due(L.progress_due(c, 0)) == due(L.periodic_due(c, 0)) == []


def test_rounds(spark):
    df = spark.createDataFrame(
        [(0, 0, 1.0, 5), (0, 1, 3.0, None), (1, 0, 2.0, 7)], "step int, acc int, loss double, n int"
    )
    last = {r["step"]: tuple(r) for r in L.last_round(df, ["step"], ["loss", "n"]).collect()}
    assert last == {0: (0, 1, 3.0, None), 1: (1, 0, 2.0, 7)}
    mean = {r["step"]: r["loss"] for r in L.mean_round(df, ["step"], ["loss"]).collect()}
    assert mean == {0: 2.0, 1: 2.0}


def test_lookups(spark, completions):
    problems = spark.createDataFrame([(2, "t2", "p2")], "prompt int, test string, text2 string")
    got = L.attach_tests(completions, problems, ["prompt"])
    assert sorted(r["seq"] for r in got.collect()) == [10, 12, 13]
    metrics = spark.createDataFrame([(0, 0.5), (1, 0.7)], "step int, loss double")
    assert L.attach_metrics(completions, metrics, ["step"]).count() == 6


@pytest.mark.parametrize("n", [2, 1001])
def test_a_prompt_without_order_numbers_raises_at_any_size(spark, n):
    df = spark.createDataFrame([(0, 1, None, "a"), (0, 2, 5, "b"), (0, 2, None, "c")], "step int, prompt int, seq long, text string")
    with pytest.raises(Exception, match="seq must not be null"):
        L.first_groups(df, ["step"], ["prompt"], "seq", n).collect()
    kept = L.first_groups(df.filter("prompt = 2"), ["step"], ["prompt"], "seq", n)
    assert {r["text"] for r in kept.collect()} == {"b", "c"}
