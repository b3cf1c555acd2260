"""Queries over rewards, advantages and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollspark.operators import reports
from rollspark.operators import scoring as S
from rollspark.operators import selection as L
from rollspark.operators.batching import sample_depth
from rollspark.operators.step import step_losses, step_metrics
from rollspark.plans import views as V
from rollspark.plans.ingest_queries import DEPTH_SQL
from rollspark.plans.registry import query

PROMPT = ["lang", "source"]


@query(
    "f1_demonstrations",
    V.with_views(
        "rollouts",
        body="""SELECT lang, source, doc_id, text,
                       row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS demo_no
                FROM rollouts WHERE reward > 0""",
    ),
)
def f1(spark, sf_dir):
    return L.demonstrations(V.rollouts(spark, sf_dir), PROMPT, "doc_id")


@query(
    "f1_demonstration_counts",
    V.with_views(
        "rollouts",
        body="SELECT lang, source, count(*) FILTER (reward > 0) AS n_demos FROM rollouts GROUP BY ALL",
    ),
)
def f1_counts(spark, sf_dir):
    return L.demonstration_counts(V.rollouts(spark, sf_dir), PROMPT)


@query(
    "f2_first_demonstration",
    V.with_views(
        "rollouts",
        body="SELECT lang, source, arg_min(text, doc_id) AS demo FROM rollouts WHERE reward > 0 GROUP BY lang, source",
    ),
)
def f2(spark, sf_dir):
    return L.first_demonstration(V.rollouts(spark, sf_dir), PROMPT, "doc_id")


def advantage_sql(window: str) -> str:
    return f"""CASE WHEN stddev_pop(reward) OVER ({window}) >= 1e-8
      THEN (reward - avg(reward) OVER ({window})) / (stddev_pop(reward) OVER ({window}) + 1e-8) ELSE 0.0 END"""


@query(
    "f3_group_advantage",
    V.with_views(
        "rollouts",
        body=f"""SELECT doc_id, lang, source, reward,
                        round({advantage_sql("PARTITION BY lang, source")}, 6) + 0.0 AS advantage FROM rollouts""",
    ),
)
def f3(spark, sf_dir) -> DataFrame:
    scored = S.group_advantage(V.rollouts(spark, sf_dir).drop("text"), PROMPT)
    return scored.select("doc_id", *PROMPT, "reward", V.r6("advantage").alias("advantage"))


@query(
    "f3_group_advantage_orders",
    V.with_views(
        "sequences",
        body=f"""SELECT seq_id, prompt_id, round({advantage_sql("PARTITION BY prompt_id")}, 6) + 0.0 AS advantage
                 FROM sequences""",
    ),
)
def f3_orders(spark, sf_dir):
    scored = S.group_advantage(V.sequences(spark, sf_dir), ["prompt_id"])
    return scored.select("seq_id", "prompt_id", V.r6("advantage").alias("advantage"))


@query(
    "f4_global_advantage",
    V.with_views(
        "rollouts", body=f"SELECT doc_id, reward, round({advantage_sql('')}, 6) + 0.0 AS advantage FROM rollouts"
    ),
)
def f4(spark, sf_dir):
    scored = S.global_advantage(V.rollouts(spark, sf_dir).select("doc_id", "reward"))
    return scored.select("doc_id", "reward", V.r6("advantage").alias("advantage"))


SEQUENCE_SQL = """
  SELECT seq_id, sum(mask)::DOUBLE AS mask_total, sum(lp * mask) / greatest(sum(mask), 1) AS seq_lp,
         sum(lp_old * mask) / greatest(sum(mask), 1) AS seq_lp_old
  FROM token_rows GROUP BY seq_id"""


@query(
    "f5_sequence_logprob",
    V.with_views(
        "token_rows",
        body=f"""SELECT seq_id, mask_total, round(seq_lp, 6) + 0.0 AS seq_lp, round(seq_lp_old, 6) + 0.0 AS seq_lp_old
                 FROM ({SEQUENCE_SQL})""",
    ),
)
def f5(spark, sf_dir):
    means = S.sequence_logprobs(V.token_rows(spark, sf_dir), ["seq_id"], ["lp", "lp_old"])
    return means.select(
        "seq_id", "mask_total", V.r6("seq_lp").alias("seq_lp"), V.r6("seq_lp_old").alias("seq_lp_old")
    )


ARRAY_SQL = """
  SELECT seq_id, any_value(step) AS step, any_value(group_id) AS group_id, any_value(reward) AS reward,
         sum(mask)::DOUBLE AS mask_total, sum(lp * mask) / greatest(sum(mask), 1) AS seq_lp,
         sum(lp_old * mask) / greatest(sum(mask), 1) AS seq_lp_old
  FROM (SELECT seq_id, step, group_id, reward, unnest(lp) AS lp, unnest(lp_old) AS lp_old, unnest(mask) AS mask
        FROM array_rows)
  GROUP BY seq_id"""


def _array_means(spark, sf_dir) -> DataFrame:
    mask = F.col("mask").cast("array<double>")
    return V.array_rows(spark, sf_dir).select(
        "seq_id",
        "step",
        "group_id",
        "reward",
        S.mask_total(mask).alias("mask_total"),
        S.sequence_logprob(F.col("lp"), mask).alias("seq_lp"),
        S.sequence_logprob(F.col("lp_old"), mask).alias("seq_lp_old"),
    )


@query(
    "f5_sequence_logprob_arrays",
    V.with_views(
        "array_rows",
        body=f"SELECT seq_id, mask_total, round(seq_lp, 6) + 0.0 AS seq_lp FROM ({ARRAY_SQL})",
    ),
)
def f5_arrays(spark, sf_dir):
    return _array_means(spark, sf_dir).select("seq_id", "mask_total", V.r6("seq_lp").alias("seq_lp"))


def _scored_sequences(spark, sf_dir) -> DataFrame:
    """Orders with sequence log-probs and group advantage."""
    means = S.sequence_logprobs(V.token_rows(spark, sf_dir), ["seq_id"], ["lp", "lp_old"])
    rows = V.sequences(spark, sf_dir).join(means, "seq_id")
    return S.group_advantage(rows, ["prompt_id"])


SCORED_SQL = f"""
  SELECT *, exp(seq_lp - seq_lp_old) AS rho, {advantage_sql("PARTITION BY prompt_id")} AS advantage
  FROM sequences JOIN ({SEQUENCE_SQL}) USING (seq_id)"""
CLIPPED_SQL = f"""
  SELECT *, least(greatest(rho, 0.8), 1.28) AS clipped,
         least(rho * advantage, least(greatest(rho, 0.8), 1.28) * advantage) AS surrogate
  FROM ({SCORED_SQL})"""


@query(
    "f6_importance_ratio",
    V.with_views(
        "token_rows",
        body=f"SELECT seq_id, round(exp(seq_lp - seq_lp_old), 6) AS rho FROM ({SEQUENCE_SQL})",
    ),
)
def f6(spark, sf_dir):
    means = S.sequence_logprobs(V.token_rows(spark, sf_dir), ["seq_id"], ["lp", "lp_old"])
    rho = S.importance_ratio(F.col("seq_lp"), F.col("seq_lp_old"))
    return means.select("seq_id", V.r6(rho).alias("rho"))


@query(
    "f7_clip_ratio",
    V.with_views(
        "token_rows",
        body=f"""SELECT seq_id, round(least(greatest(exp(5 * (seq_lp - seq_lp_old)), 0.8), 1.28), 6) AS clipped
                 FROM ({SEQUENCE_SQL})""",
    ),
)
def f7(spark, sf_dir):
    # Differences are small in this data; five times as large they reach both bounds.
    means = S.sequence_logprobs(V.token_rows(spark, sf_dir), ["seq_id"], ["lp", "lp_old"])
    rho = S.importance_ratio(5 * F.col("seq_lp"), 5 * F.col("seq_lp_old"))
    return means.select("seq_id", V.r6(S.clip_ratio(rho)).alias("clipped"))


@query(
    "f8_clipped_surrogate",
    V.with_views(
        "sequences",
        "token_rows",
        body=f"SELECT seq_id, step, round(surrogate, 6) + 0.0 AS surrogate FROM ({CLIPPED_SQL})",
    ),
)
def f8(spark, sf_dir):
    rho = S.importance_ratio(F.col("seq_lp"), F.col("seq_lp_old"))
    surrogate = S.clipped_surrogate(rho, F.col("advantage"))
    return _scored_sequences(spark, sf_dir).select("seq_id", "step", V.r6(surrogate).alias("surrogate"))


@query(
    "f9_policy_loss",
    V.with_views(
        "sequences",
        "token_rows",
        body=f"""SELECT step, CASE WHEN count(*) < 2 THEN 0.0 ELSE
           round(-sum(CASE WHEN broken THEN 'NaN'::DOUBLE ELSE surrogate END * mask_total)
                 / greatest(sum(greatest(mask_total, 1)), 1), 6) + 0.0 END AS grpo_loss,
           count(*) FILTER (broken) AS nan_sequences
  FROM (SELECT *, step = '5-LOW' AND seq_id % 100 = 1 AS broken FROM ({CLIPPED_SQL})) GROUP BY step""",
    ),
)
def f9(spark, sf_dir):
    # Some sequences of one step have a broken log-prob.
    broken = (F.col("step") == "5-LOW") & (F.pmod("seq_id", F.lit(100)) == 1)
    rows = _scored_sequences(spark, sf_dir)
    rows = rows.withColumn("seq_lp", F.when(broken, F.lit(float("nan"))).otherwise(F.col("seq_lp")))
    return S.policy_loss(rows, ["step"]).withColumn("grpo_loss", V.r6("grpo_loss"))


@query(
    "f17_reward_metrics",
    V.with_views(
        "sequences",
        body="""SELECT step, round(avg(reward), 6) AS reward_mean, count(*) FILTER (reward > 0) AS n_correct,
                       count(*) FILTER (reward <= 0) AS n_failed FROM sequences GROUP BY step""",
    ),
)
def f17(spark, sf_dir):
    metrics = S.reward_metrics(V.sequences(spark, sf_dir), ["step"])
    return metrics.withColumn("reward_mean", V.r6("reward_mean"))


# Sequences of which no tokens arrived and positions without a teacher stay in the step.
ARRAY_LOSS_SQL = f"""
  SELECT step, CASE WHEN count(*) < 2 THEN 0.0 ELSE -sum(surrogate * mask_total) / sum(greatest(mask_total, 1)) END
         AS grpo_loss, count(*) FILTER (isnan(surrogate)) AS nan_sequences, count(*) FILTER (unpaired) AS unpaired_sequences
  FROM (SELECT *, least(rho * advantage, least(greatest(rho, 0.8), 1.28) * advantage) AS surrogate
        FROM (SELECT *, exp(seq_lp - seq_lp_old) AS rho, {advantage_sql("PARTITION BY group_id")} AS advantage
              FROM (SELECT * REPLACE (CASE WHEN seq_id % 11 = 5 THEN 0 ELSE mask_total END AS mask_total,
                                      CASE WHEN seq_id % 11 = 5 THEN 0 ELSE seq_lp END AS seq_lp,
                                      CASE WHEN seq_id % 11 = 5 THEN 0 ELSE seq_lp_old END AS seq_lp_old),
                           seq_id % 11 = 5 AS unpaired FROM ({ARRAY_SQL}))))
  GROUP BY step"""
STEP_DISTILL_SQL = """
  SELECT s.seq_id % 4 AS step,
         coalesce(avg(CASE WHEN s.mask > 0 THEN kl * (1 - 0.01 * entropy / ln(items)) END), 0.0) AS sdpo_loss,
         count(*) FILTER (s.mask > 0 AND d.vec_id IS NULL) AS unpaired_positions
  FROM logit_rows s LEFT JOIN (SELECT * FROM distill_rows WHERE vec_id % 13 <> 4) d ON d.vec_id = s.vec_id
  GROUP BY s.seq_id % 4"""
TOTAL_SQL = f"""
  SELECT step, coalesce(grpo_loss, 0) AS grpo_loss, coalesce(sdpo_loss, 0) AS sdpo_loss,
         coalesce(grpo_loss, 0) + coalesce(sdpo_loss, 0) AS loss, coalesce(nan_sequences, 0) AS nan_sequences,
         coalesce(unpaired_sequences, 0) AS unpaired_sequences, coalesce(unpaired_positions, 0) AS unpaired_positions
  FROM ({ARRAY_LOSS_SQL}) FULL JOIN ({STEP_DISTILL_SQL}) USING (step)"""
PROBLEM_COUNTS = ", ".join(S.PROBLEM_COUNTS)


def _step_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Completions, token rows, student and teacher scores; some have no partner."""
    rows = V.array_rows(spark, sf_dir)
    arrived = rows.filter(F.pmod("seq_id", F.lit(11)) != 5)
    tokens = arrived.select("seq_id", F.inline(F.arrays_zip("lp", "lp_old", "mask")))
    student = V.logit_rows(spark, sf_dir).withColumn("step", F.pmod("seq_id", F.lit(4)))
    teacher = V.logit_rows(spark, sf_dir, shift=1).filter(F.pmod(F.col("seq_id") * 16 + F.col("pos"), F.lit(13)) != 4)
    return rows, tokens, student, teacher


LOSSES = ("loss", "grpo_loss", "sdpo_loss")
ROUNDED_LOSSES = ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in LOSSES)


@query(
    "f18_total_loss",
    V.with_views("array_rows", "distill_rows", body=f"SELECT step, {ROUNDED_LOSSES}, {PROBLEM_COUNTS} FROM ({TOTAL_SQL})"),
)
def f18(spark, sf_dir):
    losses = step_losses(*_step_tables(spark, sf_dir), ["step"], ["group_id"])
    return losses.select("step", *[V.r6(n).alias(n) for n in LOSSES], *S.PROBLEM_COUNTS)


@query(
    "f17_step_metrics",
    V.with_views(
        "array_rows",
        "distill_rows",
        body=f"""
  SELECT m.step, d.T, d.T_bwd, {ROUNDED_LOSSES}, round(reward_mean, 6) AS reward_mean, rho, n_correct, n_failed,
         {PROBLEM_COUNTS}
  FROM (SELECT step, avg(reward) AS reward_mean, count(*) FILTER (reward > 0) AS n_correct,
               count(*) FILTER (reward <= 0) AS n_failed
        FROM array_rows GROUP BY step) m
  LEFT JOIN ({TOTAL_SQL}) l ON l.step = m.step
  LEFT JOIN ({DEPTH_SQL}) d ON d.step = m.step
  LEFT JOIN (SELECT event_id AS step, round(value / 250, 6) AS rho FROM events) e ON e.step = m.step""",
    ),
)
def f17_full(spark, sf_dir):
    depth, backward = sample_depth(F.col("step"))
    depths = V.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("int").alias("step"), V.r6(F.col("value") / 250).alias("rho")
    )
    depths = depths.withColumn("T", depth).withColumn("T_bwd", backward)
    metrics = step_metrics(*_step_tables(spark, sf_dir), depths, ["step"], ["group_id"])
    return metrics.select(
        "step",
        "T",
        "T_bwd",
        *[V.r6(n).alias(n) for n in LOSSES],
        V.r6("reward_mean").alias("reward_mean"),
        "rho",
        "n_correct",
        "n_failed",
        *S.PROBLEM_COUNTS,
    )


@query("f19_stability", V.with_views("metric_rows", body="SELECT run_id, step, rho, rho < 1 AS stable FROM metric_rows"))
def f19(spark, sf_dir):
    return S.stability(V.metric_rows(spark, sf_dir)).select("run_id", "step", "rho", "stable")


@query(
    "f19_stability_line",
    V.with_views(
        "metric_rows",
        body="""SELECT run_id, step, printf('  [eval] ρ(A)=%.6f', rho) || CASE WHEN rho < 1 THEN ' ✓' ELSE ' ✗ UNSTABLE' END
                       AS line FROM metric_rows WHERE step % 50 = 0 AND step > 0""",
    ),
)
def f19_line(spark, sf_dir):
    due = V.metric_rows(spark, sf_dir).filter(L.periodic_due(F.col("step"), 50))
    return due.select("run_id", "step", reports.stability_line().alias("line"))


FEEDBACK_SQL = """
  SELECT c.*, 'Your code:' || chr(10) || '```python' || chr(10) || c.text || chr(10) || '```' || chr(10) || chr(10)
         || 'Error: ' || c.feedback || chr(10) || chr(10) || CASE WHEN d.demo IS NULL
         THEN 'Identify and fix the mistake.'
         ELSE 'Here is a working solution:' || chr(10) || '```python' || chr(10) || d.demo || chr(10) || '```'
              || chr(10) || chr(10) || 'Write a corrected version.' END AS sdpo_feedback, d.demo
  FROM completions c
  LEFT JOIN (SELECT step, prompt_index, arg_min(text, seq) AS demo FROM completions WHERE reward > 0
             GROUP BY step, prompt_index) d ON d.step = c.step AND d.prompt_index = c.prompt_index
  WHERE c.reward <= 0"""
GROUP = ["step", "prompt_index"]


@query(
    "g10_distill_branch",
    V.with_views("completions", body="SELECT seq, text FROM completions WHERE reward <= 0 AND seq % 5 > 1"),
)
def g10(spark, sf_dir):
    # Some failed completions have no feedback, others an empty one.
    turn = F.pmod("seq", F.lit(5))
    feedback = F.when(turn == 0, F.lit(None).cast("string")).when(turn == 1, "").otherwise(F.col("feedback"))
    rows = V.completions(spark, sf_dir).withColumn("feedback", feedback)
    return L.distill_branch(rows, "feedback").select("seq", "text")


@query(
    "j1_attach_tests",
    V.with_views(
        "completions", "prompts", body="SELECT seq, text, test FROM completions JOIN prompts USING (prompt_index)"
    ),
)
def j1(spark, sf_dir):
    joined = L.attach_tests(V.completions(spark, sf_dir), V.prompts(spark, sf_dir), ["prompt_index"])
    return joined.select("seq", "text", "test")


@query(
    "j2_attach_demo",
    V.with_views("completions", body=f"SELECT seq, text, demo FROM ({FEEDBACK_SQL})"),
)
def j2(spark, sf_dir):
    rows = V.completions(spark, sf_dir)
    demos = L.first_demonstration(rows, GROUP, "seq")
    failed = rows.filter(F.col("reward") <= 0)
    return L.attach_demo(failed, demos, GROUP, ["seq"]).select("seq", "text", "demo")


@query(
    "e5_build_feedback",
    V.with_views("completions", body=f"SELECT seq, sdpo_feedback FROM ({FEEDBACK_SQL})"),
)
def e5(spark, sf_dir):
    told = L.failure_feedback(V.completions(spark, sf_dir), GROUP, "seq", ["seq"])
    return told.select("seq", "sdpo_feedback")


TEACHER_SQL = f"""
  SELECT seq, prompt, '<start_of_turn>user' || chr(10) || sdpo_feedback || chr(10) || chr(10)
         || 'Now write the corrected code for:' || chr(10) || prompt || '<end_of_turn>' || chr(10)
         || '<start_of_turn>model' || chr(10) AS teacher_prompt
  FROM ({FEEDBACK_SQL}) JOIN prompts USING (prompt_index)"""


def _teacher(spark, sf_dir) -> DataFrame:
    told = L.failure_feedback(V.completions(spark, sf_dir), GROUP, "seq", ["seq"])
    return L.teacher_prompts(told, V.prompts(spark, sf_dir), ["prompt_index"])


@query(
    "e6_teacher_prompt",
    V.with_views("completions", "prompts", body=f"SELECT seq, teacher_prompt FROM ({TEACHER_SQL})"),
)
def e6(spark, sf_dir):
    return _teacher(spark, sf_dir).select("seq", "teacher_prompt")


@query("j3_attach_prompt", V.with_views("completions", "prompts", body=f"SELECT seq, prompt FROM ({TEACHER_SQL})"))
def j3(spark, sf_dir):
    failed = L.distill_branch(V.completions(spark, sf_dir), "feedback")
    return L.attach_prompt(failed, V.prompts(spark, sf_dir), ["prompt_index"]).select("seq", "prompt")
