import json
import os

import pytest
from pyspark.sql import functions as F

from rollspark.functions.text import render_prompt
from rollspark.operators import reports
from rollspark.operators.selection import attach_metrics, collect_samples
from rollspark.schemas import SAMPLE_LOG
from rollspark.sources import samplelog
from rollspark.streaming import jobs

PROMPT = 'def solve(x):\n    """Return x unchanged, naïvely."""\n'
COMPLETION = "def solve(x):\n    return x\n# no cut at the end"


@pytest.fixture
def rows(spark):
    completions = spark.createDataFrame(
        [(7, 0, 0, COMPLETION, 1, "passed all tests", PROMPT), (7, 1, 1, "def other(): ...", 0, "no", "other")],
        "step int, prompt_index int, seq long, completion string, reward int, feedback string, prompt string",
    )
    samples = collect_samples(completions, ["step"], "prompt_index", "seq", 1)
    samples = samples.withColumn("model_prompt", render_prompt(F.col("prompt")))
    metrics = spark.createDataFrame(
        [(7, 3, 1.25, 0.5, 0.75, 1.0, 1, 0)],
        "step int, T int, loss double, grpo_loss double, sdpo_loss double, reward_mean double, n_correct int, n_failed int",
    )
    return attach_metrics(samples, metrics, ["step"])


def test_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "deep" / "log")
    samplelog.append_log(rows, path)
    lines = [l for f in (tmp_path / "deep" / "log").glob("part-*") for l in f.read_text("utf-8").splitlines()]
    assert len(lines) == 1
    assert "naïvely" in lines[0]
    record = json.loads(lines[0])
    assert list(record) == SAMPLE_LOG.names
    assert (record["prompt"], record["completion"]) == (PROMPT, COMPLETION)
    assert record["rho"] is None  # a metric that is not there
    assert (record["grpo_loss"], record["sdpo_loss"], record["completion_index"]) == (0.5, 0.75, 0)
    samplelog.append_log(rows, path)
    got = samplelog.read_log(spark, path).collect()
    assert len(got) == 2 and got[0].asDict() == record


def test_no_path_no_log(rows):
    samplelog.append_log(rows, "")
    samplelog.append_log(rows, None)


def test_report(rows):
    report = samplelog.to_log_rows(rows).select(reports.sample_report().alias("r")).first()["r"]
    assert report.startswith(
        "\n[sample step=7 T=3 prompt=0 completion=0 reward=1 loss=1.2500 grpo=0.5000 sdpo=0.7500 R_mean=1.0000]\n"
    )
    assert f"--- PROMPT ---\n{PROMPT}\n" in report
    assert f"--- MODEL COMPLETION ---\n{COMPLETION}\n--- VERIFIER FEEDBACK ---\npassed all tests\n" in report
    assert report.endswith("--- END SAMPLE ---")


def test_progress_line(spark):
    row = spark.createDataFrame(
        [(20, 2, 1.0, 0.0625, None, 0.1875, 0.95, 3.14)],
        "step int, T int, loss double, grpo_loss double, sdpo_loss double, reward_mean double, rho double, sec double",
    )
    line = row.select(reports.progress_line(1000, F.col("sec")).alias("l")).first()["l"]
    assert line == (
        "step   20/1000 | loss=1.000 | grpo=0.062 | sdpo=0.000 | R̄=0.188 | T=2 | ρ(A)=0.9500 | 3.1s"
    )


def test_fixed_rounds_like_python(spark):
    values = [0.00145, 0.0625, 2.5, 1e20, -0.00005, 0.125]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["t"] for r in df.select("v", reports.fixed(v=(F.col("v"), 4))["v"].alias("t")).collect()}
    assert got == {v: f"{v:.4f}" for v in values}


def test_broken_lines(spark, rows, tmp_path):
    path = tmp_path / "log"
    samplelog.append_log(rows, str(path))
    (path / "torn.json").write_text('{"step": 8, "prompt": "p"}\n{"step": 9, "pro')
    with pytest.raises(Exception, match="(?i)malformed"):
        samplelog.read_log(spark, str(path)).collect()
    assert sorted(r["step"] for r in samplelog.read_log(spark, str(path), "skip").collect()) == [7, 8]
    kept = samplelog.read_log(spark, str(path), "keep").collect()
    assert [r["broken_line"] for r in kept if r["broken_line"]] == ['{"step": 9, "pro']
    assert len(kept) == 3


def test_nothing_is_written_without_samples(rows, tmp_path):
    samplelog.append_log(rows.filter("false"), str(tmp_path / "log"))
    assert not (tmp_path / "log").exists()


def test_report_of_missing_parts(spark, rows, tmp_path):
    bare = samplelog.to_log_rows(rows).withColumns({c: F.lit(None).cast("string") for c in ("feedback", "prompt", "completion")})
    bare = bare.withColumn("T", F.lit(None).cast("int"))
    report = bare.select(reports.sample_report().alias("r")).first()["r"]
    assert " T= prompt=0 " in report and "--- VERIFIER FEEDBACK ---\n\n--- END SAMPLE ---" in report


def test_reports_are_read_back(spark, rows, tmp_path):
    told = samplelog.to_log_rows(rows).withColumn("report", reports.sample_report())
    path = str(tmp_path / "reports")
    for _ in range(2):
        reports.write_reports(told, "report", path)
    assert [r["report"] for r in reports.read_reports(spark, path, "report").collect()] == [told.first()["report"]] * 2


def test_an_append_that_is_tried_again_counts_once(spark, tmp_path):
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    seen = []
    for step, tries in ((1, 2), (2, 1), (1, 1), (3, 3)):
        rows = spark.createDataFrame([(step, 2, 0.5, 0.25, 0.25, 1.0, 1, 0, None, 0, 0, "p", "mp", "t", 1, "ok")], SAMPLE_LOG)
        for _ in range(tries):
            samplelog.append_log(rows, log, f"run-7-step-{step}")
        jobs.drain(jobs.follow_log(spark, log), out, checkpoint)
        seen = sorted({*seen, step})
        assert sorted(r["step"] for r in samplelog.read_log(spark, log).collect()) == seen
        assert sorted(r["step"] for r in spark.read.schema(SAMPLE_LOG).parquet(out).collect()) == seen
    assert not [n for n in os.listdir(log) if n.startswith("_staged")]
    samplelog.append_log(rows.limit(0), log, "nothing")
    assert "nothing" not in os.listdir(log)
    samplelog.append_log(rows, log)  # plain appends go beside
    assert sorted(r["step"] for r in samplelog.read_log(spark, log).collect()) == [*seen, 3]
    for name in ("", "_x", ".x", "a/b"):
        with pytest.raises(ValueError, match="cannot name"):
            samplelog.append_log(rows, log, name)


def test_a_torn_append_is_not_read(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, 2, 0.5, 0.25, 0.25, 1.0, 1, 0, None, 0, 0, "p", "mp", "t", 1, "ok")], SAMPLE_LOG)
    samplelog.append_log(rows, log, "a")
    os.makedirs(f"{log}/_staged-x")
    with open(f"{log}/_staged-x/part-0.json", "w") as f:
        f.write('{"step": 9}\n')
    assert [r["step"] for r in samplelog.read_log(spark, log).collect()] == [1]
