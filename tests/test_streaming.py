"""Streams give what the batch operators give, however the rows arrive."""

import random

import pytest

from rollspark.operators.scoring import group_advantage
from rollspark.schemas import SAMPLE_LOG
from rollspark.sources import samplelog
from rollspark.streaming import jobs


def sample(step, text):
    return (step, 2, 0.5, 0.25, 0.25, 1.0, 1, 0, None, 0, 0, "p", "mp", text, 1, "ok")


def test_log_is_followed_once(spark, tmp_path):
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    for step in range(3):
        samplelog.append_log(spark.createDataFrame([sample(step, "a\nb")], SAMPLE_LOG), log)
        jobs.drain(jobs.follow_log(spark, log), out, checkpoint)
        got = spark.read.schema(SAMPLE_LOG).parquet(out)
        assert sorted(r["step"] for r in got.collect()) == list(range(step + 1))
    assert got.exceptAll(samplelog.read_log(spark, log)).count() == 0


COMPLETION = "id long, step int, prompt int, reward double, arrived double"


@pytest.fixture
def arriving(spark, tmp_path):
    """Write rows as files; read the folder as a stream."""
    folder = tmp_path / "in"

    def put(rows):
        spark.createDataFrame(rows, COMPLETION).repartition(2).write.mode("append").parquet(str(folder))

    def stream():
        return spark.readStream.schema(COMPLETION).parquet(str(folder))

    return put, stream


def pieces(rows, n):
    """Rows in the order of their arrival, cut into n lots."""
    rows = sorted(rows, key=lambda r: r[4])
    return [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]


def busy(seed, n):
    """Completions over some hundred seconds, a third of them of one prompt, some seconds apart and some pauses long."""
    rng = random.Random(seed)
    now, rows = 0.0, []
    for i in range(n):
        now += rng.choice([0.2, 0.2, 0.7, 2.0, 30.0] if i % 10 == 0 else [0.1, 0.3, 1.1])
        prompt = -1 if rng.random() < 0.34 else rng.randrange(12)
        rows.append((i, 0, prompt, float(rng.randrange(3)), now))
    return rows


def brute_groups(rows, enough, wait, slot=1.0):
    """Groups that are given out, as lists of ids, and the ids left over: slot by slot, as the job's contract says."""
    newest = max(r[4] for r in rows)
    at = lambda r: int(r[4] // slot)
    ends = sorted({at(r) + 1 for r in rows if (at(r) + 1) * slot <= int(newest * 1000) / 1000})
    seen = ends[-1] if ends else 0
    given, left = [], []
    for key in {r[2] for r in rows}:
        held, last = [], None
        own = [r for r in rows if r[2] == key]
        for end in sorted({at(r) + 1 for r in own}):
            new = [r[0] for r in own if at(r) + 1 == end]
            if end not in ends:
                left += new
                continue
            if held and (end - last) * slot > wait:
                given.append(held)
                held = []
            held, last = held + new, end
            if len(held) >= enough:
                given.append(held)
                held = []
        if held and last * slot + wait < seen * slot:
            given.append(held)
        else:
            left += held
    return sorted(map(sorted, given)), sorted(left)


@pytest.mark.parametrize("lots", [1, 3, 9])
def test_groups_do_not_depend_on_how_the_input_is_cut(spark, tmp_path, arriving, lots):
    put, stream = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    rows = busy(3, 240)
    given, left = brute_groups(rows, 4, 20)
    for lot in pieces(rows, lots):
        put(lot)
        jobs.run_group_advantages(stream(), ["step", "prompt"], 4, "arrived", 20, out, checkpoint)
    put([])
    jobs.run_group_advantages(stream(), ["step", "prompt"], 4, "arrived", 20, out, checkpoint)
    got = {r["id"]: r["advantage"] for r in jobs.read_group_advantages(spark, ["step", "prompt"], out).collect()}
    assert sorted(got) == sorted(i for g in given for i in g) and len(given) > 20 and left
    reward = {r[0]: r[3] for r in rows}
    for group in given:
        mean = sum(reward[i] for i in group) / len(group)
        sigma = (sum((reward[i] - mean) ** 2 for i in group) / len(group)) ** 0.5
        for i in group:
            assert got[i] == pytest.approx((reward[i] - mean) / (sigma + 1e-8) if sigma >= 1e-8 else 0.0, abs=1e-6)
    flushed = {r["id"]: r["advantage"] for r in jobs.read_group_advantages(spark, ["step", "prompt"], out, flush=True).collect()}
    assert sorted(flushed) == list(range(240))
    rest = [r for r in rows if r[0] in left]
    batch = group_advantage(spark.createDataFrame(rest, COMPLETION), ["step", "prompt"])
    assert {r["id"]: pytest.approx(r["advantage"], abs=1e-9) for r in batch.collect()} == {i: flushed[i] for i in left}


def test_an_empty_first_micro_batch(spark, tmp_path, arriving):
    put, stream = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    put([(0, 0, 0, 1.0, 1.0), (1, 0, 0, 0.0, 1.1), (2, 0, 1, 0.0, 9.0)])
    run = lambda s: jobs.run_group_advantages(s, ["prompt"], 2, "arrived", 5, out, checkpoint)
    run(stream().filter("id < 0"))  # all filtered out upstream
    assert jobs.read_group_advantages(spark, ["prompt"], out, flush=True).count() == 0
    run(stream().filter("id < 0"))
    put([(3, 0, 0, 1.0, 10.0), (4, 0, 0, 0.0, 10.2), (5, 0, 2, 0.0, 30.0)])
    run(stream())
    assert {r["id"] for r in jobs.read_group_advantages(spark, ["prompt"], out).collect()} == {3, 4}


@pytest.mark.parametrize("lots", [1, 4])
def test_each_step_is_given_out_once(spark, tmp_path, arriving, lots):
    put, stream = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    rows = [(i, i // 20, 0, float(i % 3 > 0), i * 0.5) for i in range(100)]
    rows += [(100 + i, 0, 0, 1.0, 40.0 + i) for i in range(3)]  # step 0 was given out long before
    for lot in pieces(rows, lots):
        put(lot)
        jobs.run_step_metrics(stream(), ["step"], "arrived", 5, out, checkpoint, slot="1 second")
    put([])
    jobs.run_step_metrics(stream(), ["step"], "arrived", 5, out, checkpoint, slot="1 second")
    sink = spark.read.parquet(f"{out}/groups").collect()
    assert sorted(r["step"] for r in sink) == [0, 1, 2, 3]  # each once; the last step is still open
    got = {r["step"]: r for r in jobs.read_step_metrics(spark, ["step"], out, flush=True).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and [got[s]["closed"] for s in range(5)] == [True] * 4 + [False]
    for step in range(5):
        rewards = [r[3] for r in rows[:100] if r[1] == step]
        assert got[step]["reward_mean"] == pytest.approx(sum(rewards) / len(rewards))
        assert (got[step]["n_correct"], got[step]["n_failed"]) == (sum(rewards), len(rewards) - sum(rewards))
    late = {r["step"]: r["n_late"] for r in jobs.read_late_samples(spark, ["step"], out).collect()}
    assert late == {0: 3}


@pytest.mark.parametrize("lots", [1, 5])
def test_steps_close_by_time_without_a_python_call_for_each(spark, tmp_path, arriving, monkeypatch, lots):
    """A gap of just the patience belongs to a step, one of a millisecond more does not; keys and rewards may be null."""
    from pyspark.sql.group import GroupedData

    def refused(*_):
        raise AssertionError("a Python function for each step")

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", refused)
    put, stream = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    run = lambda: jobs.run_step_metrics(stream(), ["step"], "arrived", 5, out, checkpoint, slot="1 millisecond")
    put([])
    run()
    assert jobs.read_step_metrics(spark, ["step"], out, flush=True).count() == 0
    rows = [(0, 0, 0, 1.0, 0.0), (1, 0, 0, 0.0, 5.0), (2, 0, 0, 1.0, 10.001), (3, 0, 0, 1.0, 30.0)]  # three sessions of step 0
    rows += [(4, 1, 0, None, 2.0), (5, 1, 0, 3.0, 4.0), (6, None, 0, None, 1.0), (7, 2, 0, 1.0, 60.0), (8, 2, 0, 1.0, 61.0)]
    for lot in pieces(rows, lots):
        put(lot)
        run()
    sink = spark.read.parquet(f"{out}/groups").collect()
    assert sorted(str(r["step"]) for r in sink) == ["0", "1", "None"]
    got = {r["step"]: tuple(r)[1:] for r in jobs.read_step_metrics(spark, ["step"], out, flush=True).collect()}
    assert got == {0: (0.5, 1, 1, True), 1: (3.0, 1, 0, True), None: (None, 0, 0, True), 2: (1.0, 2, 0, False)}
    assert [tuple(r) for r in jobs.read_late_samples(spark, ["step"], out).collect()] == [(0, 2)]


def test_samples_behind_the_watermark_are_late_not_lost(spark, tmp_path, arriving):
    put, stream = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for lot in ([(0, 0, 0, 1.0, 0.0), (1, 1, 0, 1.0, 30.0)], [(2, 0, 0, 0.0, 0.1), (3, 1, 0, 0.0, 30.5), (4, 2, 0, 0.0, 60.0)]):
        put(lot)
        jobs.run_step_metrics(stream(), ["step"], "arrived", 5, out, checkpoint, slot="1 second")
    got = {r["step"]: r["reward_mean"] for r in jobs.read_step_metrics(spark, ["step"], out, flush=True).collect()}
    assert got == {0: 1.0, 1: 0.5, 2: 0.0}
    assert [(r["step"], r["n_late"]) for r in jobs.read_late_samples(spark, ["step"], out).collect()] == [(0, 1)]


def test_delay_lets_rows_be_late(spark, tmp_path, arriving):
    put, stream = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for lot in ([(0, 0, 0, 1.0, 0.0), (1, 0, 0, 1.0, 8.0)], [(2, 0, 0, 0.0, 0.1)], [(3, 9, 9, 0.0, 60.0)], [(4, 8, 8, 0.0, 90.0)]):
        put(lot)
        jobs.run_step_metrics(stream(), ["step"], "arrived", 10, out, checkpoint, slot="1 second", delay="20 seconds")
    got = {r["step"]: (r["n_correct"], r["n_failed"]) for r in jobs.read_step_metrics(spark, ["step"], out).collect()}
    assert got == {0: (2, 1)}


def test_arrival_must_be_a_time(spark, tmp_path, arriving):
    put, stream = arriving
    put([(0, 0, 0, 1.0, 1.0)])
    words = stream().selectExpr("*", "'noon' AS noon")
    with pytest.raises(TypeError, match="noon"):
        jobs.run_step_metrics(words, ["step"], "noon", 5, str(tmp_path / "out"), str(tmp_path / "checkpoint"))


def test_stream_verdicts_equal_the_batch(spark, tmp_path):
    schema = "text string, stdout string, stderr string, timed_out boolean, launch_error string"
    rows = [
        ("```python\nx\n```", "__ALL_PASSED__", "", False, None),
        ("y", " oops ", "", False, None),
        ("z", "", "", True, None),
    ]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    batch = jobs.judge_stream(spark.read.parquet(str(tmp_path / "in")))
    stream = jobs.judge_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    jobs.drain(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("code", "reward", "feedback").collect())) == sorted(
        map(tuple, batch.select("code", "reward", "feedback").collect())
    ) == [("x", 1.0, "All tests passed."), ("y", 0.0, "oops"), ("z", 0.0, "Timed out.")]
