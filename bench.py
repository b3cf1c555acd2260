"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
cores. Each query is run in full into a sink that keeps nothing; the best of two
runs counts, after a few untimed queries, so that start-up of the JVM and of
Python workers does not.
"""

from __future__ import annotations

import glob
import json
import os
import subprocess
import sys
import tempfile
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rollspark.functions import vocab  # noqa: E402
from rollspark.functions.determinism import uniform  # noqa: E402
from rollspark.operators import scoring, selection  # noqa: E402
from rollspark.operators.verify import verify_completions  # noqa: E402
from rollspark.plans.catalog import QUERIES  # noqa: E402
from rollspark.session import build_session  # noqa: E402

HEADLINE = (
    "a1_mbpp_problems",
    "a3_weighted_mix",
    "a5_pool_sample",
    "c1_micro_batches",
    "c2_epoch_schedule",
    "c4_pad_batch",
    "d2_eos_cut",
    "d5_training_window",
    "d8_taken_logprobs",
    "e1_extract_code",
    "e2_build_script",
    "e3_verify",
    "e6_teacher_prompt",
    "f1_demonstrations",
    "f3_group_advantage_orders",
    "f5_sequence_logprob",
    "f9_policy_loss",
    "f14_distill_loss",
    "f17_step_metrics",
    "f21_compare_logits",
    "g2_first_prompt_groups",
    "g3_trailing_mean",
    "g5_last_round",
    "g6_topk_ties",
    "g8_weighted_draw",
    "j6_attach_metrics",
    "b1_sample_log",
    "k3_step_metrics_stream",
    "k4_group_advantage_stream",
)
WARM_UP = ("a3_weighted_mix", "f17_step_metrics", "f9_policy_loss")
ITEMS = 32_768  # of a score vector in the wide queries
WIDE = 400  # such vectors


def wide_pairs(spark, sf_dir, folder=tempfile.mkdtemp(prefix="bench-wide-")):
    """Score vectors of a vocabulary's width, student and teacher, made once from the given ones."""
    path = f"{folder}/{os.path.basename(sf_dir.rstrip('/'))}"
    if not os.path.isdir(path):
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.col("vec_id") < WIDE)
        copies = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(ITEMS // 64)), lambda i: F.transform("embedding", lambda x: x + F.sin(x * i))))
        rows.select(F.col("vec_id").alias("seq_id"), F.lit(0).alias("pos"), F.lit(1).alias("mask"), copies.cast("array<float>").alias("logits")).repartition(
            8
        ).write.parquet(path)
    wide = spark.read.parquet(path)
    return wide, wide.select("seq_id", "pos", F.reverse("logits").alias("logits"))


def wide_queries():
    def item(spark, sf_dir):
        return wide_pairs(spark, sf_dir)[0].select("seq_id", vocab.item_logprob("logits", F.pmod("seq_id", F.lit(64))))

    def distill(spark, sf_dir):
        return scoring.step_distill_loss(*wide_pairs(spark, sf_dir), ["seq_id"])

    def capped(spark, sf_dir):
        return wide_pairs(spark, sf_dir)[0].select("seq_id", vocab.soft_capped_log_softmax(F.col("logits"), 30.0))

    def compared(spark, sf_dir):
        pairs = scoring.pair_logits(*wide_pairs(spark, sf_dir))
        return selection.compare_tables(pairs.select("seq_id", "pos", vocab.compare_scores("logits", "teacher_logits").alias("cmp")), ["seq_id"])

    def top(spark, sf_dir):
        return wide_pairs(spark, sf_dir)[0].select("seq_id", vocab.top_k_items(F.col("logits"), 1.2, 50))

    def drawn(spark, sf_dir):
        return wide_pairs(spark, sf_dir)[0].select("seq_id", vocab.draw_item(F.col("logits"), uniform(42, F.col("seq_id")), 1.2, 50))

    def scripts(spark, sf_dir):
        """As many distinct scripts as a hundredth of the parts."""
        parts = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 100 = 0")
        number = F.col("p_partkey").cast("string")
        code = F.concat(F.lit("```python\ndef f(n):\n    return n + "), number, F.lit("\n```"))
        return verify_completions(parts.select("p_partkey", code.alias("text"), F.concat(F.lit("assert f(1) == 1 + "), number).alias("test")))

    return {
        "wide_d8_item": item, "wide_f14_distill": distill, "wide_f20_capped": capped, "wide_f21_compare": compared,
        "wide_g6_topk": top, "wide_g8_draw": drawn, "e3_distinct_scripts": scripts,
    }


def shuffled_mb(folder: str, spans: dict[str, tuple[float, float]]) -> dict[str, float]:
    """MB written to shuffles within each span of time, from the event log."""
    out = dict.fromkeys(spans, 0.0)
    for path in glob.glob(f"{folder}/*"):
        for line in open(path, encoding="utf-8", errors="replace"):
            if '"SparkListenerTaskEnd"' not in line[:60]:
                continue
            event = json.loads(line)
            at = event["Task Info"]["Finish Time"] / 1000
            written = (event.get("Task Metrics") or {}).get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
            for name, (begin, end) in spans.items():
                if begin <= at <= end:
                    out[name] += written / 1e6
    return {name: round(mb, 2) for name, mb in out.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    events = tempfile.mkdtemp(prefix="bench-events-")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": f"file://{events}",
            "spark.eventLog.compress": "false",
            "spark.eventLog.rolling.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = {name: q.run for name, q in QUERIES.items()} | wide_queries()
    wide_pairs(spark, sf_dir)
    for name in WARM_UP:
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or [*HEADLINE, *wide_queries()]
    seconds, spans = {}, {}
    for name in wanted:
        runs = []
        for _ in range(2):
            began, start = time.time(), time.perf_counter()
            run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            spans[name] = (began, time.time())
        seconds[name] = round(min(runs), 3)
    spark.stop()
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "shuffle_mb": shuffled_mb(events, spans),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    if fewer := os.environ.get("BENCH_RATIO"):  # also on so many cores: seconds there over seconds here
        env = {k: v for k, v in os.environ.items() if k != "BENCH_RATIO"} | {"BENCH_CPUS": fewer}
        done = subprocess.run([sys.executable, __file__, *wanted], env=env, capture_output=True, text=True, check=True)
        other = json.loads(done.stdout.strip().splitlines()[-1])["queries"]
        result[f"ratio_{fewer}_to_{cpus}"] = {name: round(other[name] / seconds[name], 2) for name in wanted}
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
