"""Queries over texts, verification, samples and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollspark.functions import text as X
from rollspark.operators import reports
from rollspark.operators import selection as L
from rollspark.operators.batching import sample_depth
from rollspark.operators.skew import group_ordinal
from rollspark.operators.step import step_samples
from rollspark.operators.verify import verify_completions
from rollspark.plans import views as V
from rollspark.plans.ingest_queries import depth_case, uniform_sql
from rollspark.plans.registry import query
from rollspark.plans.scoring_queries import advantage_sql
from rollspark.schemas import SAMPLE_LOG
from rollspark.session import fresh_dir
from rollspark.sources import samplelog
from rollspark.streaming import jobs

# The characters stripped from texts, for the SQL side.
BLANKS = " || ".join(
    f"chr({c})"
    for c in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)


def strip_sql(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def fence_sql(x: str, fence: str) -> str:
    rest = f"substr({x}, strpos({x}, '{fence}') + {len(fence)})"
    return f"CASE WHEN strpos({x}, '{fence}') > 0 THEN nullif({strip_sql(f"split_part({rest}, '```', 1)")}, '') END"


def code_sql(x: str) -> str:
    return f"coalesce({fence_sql(x, '```python')}, {fence_sql(x, '```')}, {strip_sql(x)})"


@query("e1_extract_code", V.with_views("fenced", body=f"SELECT doc_id, {code_sql('text')} AS code FROM fenced"))
def e1(spark, sf_dir):
    return V.fenced(spark, sf_dir).select("doc_id", X.extract_code(F.col("text")).alias("code"))


@query(
    "e2_build_script",
    f"""SELECT doc_id, array_to_string(list_concat(list_concat(['x = ' || n_chars, '', 'try:'],
          list_transform(list_filter(string_split({strip_sql("text")}, chr(10)), lambda t: {strip_sql("t")} <> ''),
                         lambda t: '    ' || t)),
          ['    print(''__ALL_PASSED__'')', 'except Exception as exc:', '    import traceback',
           '    print(''__FAILED__'')', '    traceback.print_exc()']), chr(10)) AS script
        FROM documents""",
)
def e2(spark, sf_dir):
    code = F.concat(F.lit("x = "), F.col("n_chars"))
    docs = V.table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.build_script(code, F.col("text")).alias("script"))


def verifiable(spark, sf_dir) -> DataFrame:
    """Completions that pass, fail, raise or do not parse, by part size; few distinct scripts."""
    size = F.col("p_size").cast("string")
    kind = F.pmod("p_size", F.lit(4))
    code = (
        F.when(kind == 0, F.concat(F.lit("def f(n):\n    return n * "), size))
        .when(kind == 1, F.concat(F.lit("def f(n):\n    return n + "), size, F.lit(" + 1")))
        .when(kind == 2, F.concat(F.lit("def f(n):\n    raise SystemExit("), size, F.lit(")")))
        .otherwise(F.concat(F.lit("def f(n:\n    return "), size))
    )
    return V.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("Here you are:\n```python\n"), code, F.lit("\n```\n")).alias("text"),
        F.concat(F.lit("assert f(2) == 2 * "), size, F.lit("\nassert f(0) == 0")).alias("test"),
    )


@query(
    "e3_verify",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward,
              CASE p_size % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'assertion' WHEN 2 THEN 'silent' ELSE 'syntax' END
                AS outcome
       FROM part""",
)
def e3(spark, sf_dir):
    judged = verify_completions(verifiable(spark, sf_dir))
    fb = F.col("feedback")
    outcome = (
        F.when(fb == X.PASS_TEXT, "passed")
        .when(F.startswith(fb, F.lit(X.FAIL_MARK)) & F.endswith(fb, F.lit("AssertionError")), "assertion")
        .when(fb == "", "silent")
        .when(F.contains(fb, F.lit("SyntaxError")), "syntax")
    )
    return judged.select("p_partkey", "reward", outcome.alias("outcome"))


VERDICT_SQL = f"""
  SELECT doc_id, CASE WHEN launch_error IS NULL AND NOT timed_out AND contains(stdout || stderr, '__ALL_PASSED__')
                      THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward,
         CASE WHEN launch_error IS NOT NULL THEN left(launch_error, 600) WHEN timed_out THEN 'Timed out.'
              WHEN contains(stdout || stderr, '__ALL_PASSED__') THEN 'All tests passed.'
              ELSE left({strip_sql("(stdout || stderr)")}, 600) END AS feedback, {code_sql("text")} AS code
  FROM fenced"""


@query("e4_verdict", V.with_views("fenced", body=f"SELECT doc_id, reward, feedback FROM ({VERDICT_SQL})"))
def e4(spark, sf_dir):
    reward, feedback = X.verdict(F.col("stdout"), F.col("stderr"), F.col("timed_out"), F.col("launch_error"))
    return V.fenced(spark, sf_dir).select("doc_id", reward.alias("reward"), feedback.alias("feedback"))


@query(
    "e7_render_prompt",
    """SELECT conv_id, turn, '<start_of_turn>user' || chr(10) || text || '<end_of_turn>' || chr(10)
              || '<start_of_turn>model' || chr(10) AS model_prompt
       FROM conversations""",
)
def e7(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", X.render_prompt(F.col("text")).alias("model_prompt"))


# -- samples -----------------------------------------------------------------


@query(
    "g1_completion_ordinal",
    """SELECT conv_id, turn, role,
              row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS completion_index
       FROM conversations""",
)
def g1(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return group_ordinal(turns, ["conv_id", "role"], "turn", "completion_index")


def chosen_sql(n: int) -> str:
    return f"""
  SELECT c.*, row_number() OVER (PARTITION BY step, prompt_index ORDER BY seq) - 1 AS completion_index
  FROM completions c SEMI JOIN (
    SELECT step, prompt_index FROM (SELECT step, prompt_index, min(seq) AS first FROM completions GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY step ORDER BY first) <= {n}) g
  ON g.step = c.step AND g.prompt_index = c.prompt_index"""


@query("g2_first_prompt_groups", V.with_views("completions", body=f"SELECT step, prompt_index, seq FROM ({chosen_sql(2)})"))
def g2(spark, sf_dir):
    rows = V.completions(spark, sf_dir).select("step", "prompt_index", "seq")
    return L.first_groups(rows, ["step"], ["prompt_index"], "seq", 2)


@query(
    "j7_chosen_completions",
    V.with_views("completions", body=f"SELECT step, prompt_index, seq, text, completion_index FROM ({chosen_sql(1)})"),
)
def j7(spark, sf_dir):
    rows = L.collect_samples(V.completions(spark, sf_dir), ["step"], "prompt_index", "seq", 1)
    return rows.select("step", "prompt_index", "seq", "text", "completion_index")


@query(
    "g3_trailing_mean",
    V.with_views(
        "metric_rows",
        body="""SELECT run_id, step, round(avg(seconds) OVER (PARTITION BY run_id ORDER BY step
                       ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS trailing_mean FROM metric_rows""",
    ),
)
def g3(spark, sf_dir):
    rows = V.metric_rows(spark, sf_dir).select("run_id", "step", "seconds")
    return L.trailing_mean(rows, ["run_id"], "step", "seconds").select(
        "run_id", "step", V.r6("trailing_mean").alias("trailing_mean")
    )


@query(
    "g4_cadence",
    """SELECT event_id AS step, event_id % 10 = 0 OR event_id < 5 AS progress,
              event_id % 50 = 0 AND event_id > 0 AS eval, event_id % 200 = 0 AND event_id > 0 AS save
       FROM events""",
)
def g4(spark, sf_dir):
    step = F.col("event_id")
    return V.table(spark, sf_dir, "events").select(
        step.alias("step"),
        L.progress_due(step, 10).alias("progress"),
        L.periodic_due(step, 50).alias("eval"),
        L.periodic_due(step, 200).alias("save"),
    )


@query(
    "g5_last_round",
    V.with_views(
        "metric_rows",
        body="""SELECT run_id, day, max(step) AS step, round(arg_max(loss, step), 6) AS loss,
                       arg_max(n_correct, step) AS n_correct FROM metric_rows GROUP BY run_id, day""",
    ),
)
def g5(spark, sf_dir):
    last = L.last_round(V.metric_rows(spark, sf_dir), ["run_id", "day"], ["loss", "n_correct"], acc="step")
    return last.withColumn("loss", V.r6("loss"))


@query(
    "g5_mean_round",
    V.with_views(
        "metric_rows",
        body="""SELECT run_id, day, round(avg(loss), 6) AS loss, round(avg(n_correct), 6) AS n_correct
                FROM metric_rows GROUP BY run_id, day""",
    ),
)
def g5_mean(spark, sf_dir):
    mean = L.mean_round(V.metric_rows(spark, sf_dir), ["run_id", "day"], ["loss", "n_correct"])
    return mean.select("run_id", "day", V.r6("loss").alias("loss"), V.r6("n_correct").alias("n_correct"))


# -- logs and reports --------------------------------------------------------


def _sample_rows(spark, sf_dir, every: int | None = None) -> DataFrame:
    """Log rows: the first two prompts of each step (or each due step) with the metrics of the step."""
    depth, _ = sample_depth(F.col("step"))
    metrics = V.metric_rows(spark, sf_dir).drop("run_id", "day", "seconds", "T", "rho").withColumn("T", depth)
    return step_samples(V.completions(spark, sf_dir), V.prompts(spark, sf_dir), metrics, 2, every=every)


# The spectral radius is left out above, so that the log shows a null.
SAMPLE_SQL = f"""
  SELECT s.step, {depth_case(uniform_sql("s.step"))} AS T, m.loss, m.grpo_loss, m.sdpo_loss, m.reward_mean,
         m.n_correct, m.n_failed, NULL::DOUBLE AS rho, s.prompt_index, s.completion_index::INTEGER AS completion_index,
         p.prompt, '<start_of_turn>user' || chr(10) || p.prompt || '<end_of_turn>' || chr(10)
         || '<start_of_turn>model' || chr(10) AS model_prompt,
         s.text AS completion, s.reward::INTEGER AS reward, s.feedback
  FROM ({chosen_sql(2)}) s JOIN prompts p ON p.prompt_index = s.prompt_index JOIN metric_rows m ON m.step = s.step"""
LOG_VIEWS = ("completions", "prompts", "metric_rows")
LOG_COLUMNS = ", ".join(
    f"round({f.name}, 6) AS {f.name}" if f.dataType.simpleString() == "double" else f.name for f in SAMPLE_LOG
)
LOG_SQL = V.with_views(*LOG_VIEWS, body=f"SELECT {LOG_COLUMNS} FROM ({SAMPLE_SQL})")


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[V.r6(f.name).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in SAMPLE_LOG]
    )


@query("j6_attach_metrics", LOG_SQL)
def j6(spark, sf_dir):
    return _rounded(_sample_rows(spark, sf_dir))


@query(
    "b1_sample_log",
    V.with_views(*LOG_VIEWS, body=f"SELECT {LOG_COLUMNS} FROM ({SAMPLE_SQL}) WHERE step % 4 = 0 OR step < 5"),
)
def b1(spark, sf_dir):
    """The log of the steps at which samples are due, appended again after it was there already."""
    path = fresh_dir(spark, "samples")
    for _ in range(2):
        samplelog.append_log(_sample_rows(spark, sf_dir, every=4), path, "run-1")
    return _rounded(samplelog.read_log(spark, path))


ONE_LOG_SQL = f"SELECT {LOG_COLUMNS} FROM ({SAMPLE_SQL})"


@query("a7_read_log", V.with_views(*LOG_VIEWS, body=f"{ONE_LOG_SQL} UNION ALL {ONE_LOG_SQL}"))
def a7(spark, sf_dir):
    """The log after two appends."""
    path = fresh_dir(spark, "samples")
    for _ in range(2):
        samplelog.append_log(_sample_rows(spark, sf_dir), path)
    return _rounded(samplelog.read_log(spark, path))


@query(
    "b2_sample_report",
    V.with_views(
        *LOG_VIEWS,
        body=f"""
  SELECT step, prompt_index, completion_index, chr(10) || '[sample step=' || step || ' T=' || T
         || ' prompt=' || prompt_index || ' completion=' || completion_index || ' reward=' || reward
         || printf(' loss=%.4f grpo=%.4f sdpo=%.4f R_mean=%.4f]', loss, grpo_loss, sdpo_loss, reward_mean) || chr(10)
         || '--- PROMPT ---' || chr(10) || prompt || chr(10) || '--- MODEL PROMPT (CHAT TEMPLATE APPLIED) ---'
         || chr(10) || model_prompt || chr(10) || '--- MODEL COMPLETION ---' || chr(10) || completion || chr(10)
         || '--- VERIFIER FEEDBACK ---' || chr(10) || feedback || chr(10) || '--- END SAMPLE ---' AS report
  FROM ({SAMPLE_SQL})""",
    ),
)
def b2(spark, sf_dir):
    path = fresh_dir(spark, "reports")
    reports.write_reports(_sample_rows(spark, sf_dir).withColumn("report", reports.sample_report()), "report", path)
    number = lambda name: F.regexp_extract("report", rf"^\n\[sample [^\n]*?\b{name}=(\d+)", 1).cast("int")
    return reports.read_reports(spark, path, "report").select(
        number("step").alias("step"), number("prompt").alias("prompt_index"),
        number("completion").cast("long").alias("completion_index"), "report",
    )


@query(
    "b3_progress_line",
    V.with_views(
        "metric_rows",
        body="""
  SELECT step, printf('step %4d/1000 | loss=%.3f | grpo=%.3f | sdpo=%.3f | R̄=%.3f | T=%d | ρ(A)=%.4f | %.1fs',
                      step, loss, grpo_loss, sdpo_loss, reward_mean, T, rho, seconds) AS line
  FROM metric_rows WHERE step % 10 = 0 OR step < 5""",
    ),
)
def b3(spark, sf_dir):
    due = V.metric_rows(spark, sf_dir).filter(L.progress_due(F.col("step"), 10))
    path = fresh_dir(spark, "progress")
    lines = due.select(reports.progress_line(1000, F.col("seconds")).alias("line"))
    reports.write_reports(lines, "line", path, "\n")
    step = F.regexp_extract("line", r"^step +(\d+)/", 1).cast("int").alias("step")
    return reports.read_reports(spark, path, "line", "\n").select(step, "line")


# -- streams -----------------------------------------------------------------


@query("k1_follow_log", LOG_SQL)
def k1(spark, sf_dir):
    log, out, checkpoint = (fresh_dir(spark, n) for n in ("samples", "followed", "checkpoint"))
    rows = _sample_rows(spark, sf_dir)
    for part in range(3):
        for _ in range(2):  # the second is a retry
            samplelog.append_log(rows.filter(F.pmod("step", F.lit(3)) == part), log, f"part-{part}")
        jobs.drain(jobs.follow_log(spark, log), out, checkpoint)
    return _rounded(spark.read.schema(SAMPLE_LOG).parquet(out))


def _arrive(rows: DataFrame, part, parts: int, run) -> None:
    """Rows come in ``parts`` lots, each as it is spread; after each the job runs over what is there and stops."""
    path = fresh_dir(rows.sparkSession, "arriving")
    for number in range(parts):
        rows.filter(part == number).write.mode("append").parquet(path)
        run(rows.sparkSession.readStream.schema(rows.schema).parquet(path))


@query("k2_judge_stream", V.with_views("fenced", body=f"SELECT doc_id, code, reward, feedback FROM ({VERDICT_SQL})"))
def k2(spark, sf_dir):
    out, checkpoint = fresh_dir(spark, "judged"), fresh_dir(spark, "checkpoint")
    documents = V.table(spark, sf_dir, "documents")
    _arrive(documents, F.pmod("doc_id", F.lit(3)), 3, lambda s: jobs.drain(jobs.judge_stream(V.as_fenced(s)), out, checkpoint))
    return spark.read.parquet(out).select("doc_id", "code", "reward", "feedback")


@query(
    "k3_step_metrics_stream",
    """WITH e AS (SELECT *, user_id AS run_id, day(ts)::INTEGER AS step, date_trunc('hour', ts) + INTERVAL 1 HOUR AS slot_end FROM events),
       summed AS (SELECT *, slot_end <= (SELECT max(date_trunc('milliseconds', ts)) FROM events) AS passed FROM e)
       SELECT run_id, step, count(*) FILTER (event_type = 'purchase') AS n_correct,
              count(*) FILTER (event_type <> 'purchase') AS n_failed,
              round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS reward_mean,
              coalesce(max(slot_end) FILTER (passed) + INTERVAL 1 DAY < (SELECT max(slot_end) FROM summed WHERE passed), false) AS closed
       FROM summed GROUP BY run_id, step""",
)
def k3(spark, sf_dir):
    """Steps are days; each is given out a day after its last sample, those at the end are still open."""
    out, checkpoint, keys = fresh_dir(spark, "metrics"), fresh_dir(spark, "checkpoint"), ["run_id", "step"]
    samples = V.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.dayofmonth("ts").alias("step"),
        F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("reward"),
        F.col("ts").alias("arrived"),
    )
    third = F.least(F.expr("(step - 1) div 10"), F.lit(2))
    _arrive(samples, third, 3, lambda s: jobs.run_step_metrics(s, keys, "arrived", 86_400, out, checkpoint, "1 hour"))
    return jobs.read_step_metrics(spark, keys, out, flush=True).withColumn("reward_mean", V.r6("reward_mean"))


@query(
    "k2_verify_stream",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM part""",
)
def k2_verify(spark, sf_dir):
    out, checkpoint = fresh_dir(spark, "verified"), fresh_dir(spark, "checkpoint")
    _arrive(verifiable(spark, sf_dir), F.pmod("p_partkey", F.lit(2)), 2, lambda s: jobs.run_verification(s, out, checkpoint))
    return spark.read.parquet(out).select("p_partkey", "reward")


@query(
    "k4_group_advantage_stream",
    V.with_views(
        "rollouts",
        body=f"""SELECT doc_id, prompt, reward, whole, round({advantage_sql("PARTITION BY prompt, gen")}, 6) + 0.0 AS advantage FROM (
  WITH RECURSIVE arrived AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id // 16 END AS prompt, reward, doc_id // 8 AS slot FROM rollouts),
  passed AS (SELECT prompt, slot, count(*) AS n, row_number() OVER (PARTITION BY prompt ORDER BY slot) AS rn
             FROM arrived WHERE (slot + 1) * 8 <= (SELECT max(doc_id) FROM arrived) GROUP BY prompt, slot),
  fold AS (SELECT prompt, slot, rn, 0 AS gen, n AS held FROM passed WHERE rn = 1
           UNION ALL
           SELECT p.prompt, p.slot, p.rn, CASE WHEN held >= 4 OR (p.slot - f.slot) * 8 > 100 THEN gen + 1 ELSE gen END,
                  CASE WHEN held >= 4 OR (p.slot - f.slot) * 8 > 100 THEN n ELSE held + n END
           FROM fold f JOIN passed p ON p.prompt = f.prompt AND p.rn = f.rn + 1),
  gens AS (SELECT prompt, gen, max(held) >= 4 OR gen < (SELECT max(gen) FROM fold g WHERE g.prompt = fold.prompt)
                  OR (max(slot) + 1) * 8 + 100 < (SELECT (max(slot) + 1) * 8 FROM passed) AS whole FROM fold GROUP BY prompt, gen)
  SELECT doc_id, prompt, reward, coalesce(whole, false) AS whole, CASE WHEN whole THEN gen END AS gen
  FROM arrived LEFT JOIN fold USING (prompt, slot) LEFT JOIN gens USING (prompt, gen))""",
    ),
)
def k4(spark, sf_dir):
    """Groups of four and more, one with a third of all rows; what is short at the end comes as it is."""
    prompt = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit(-1)).otherwise(F.expr("doc_id div 16"))
    rows = V.rollouts(spark, sf_dir).select("doc_id", prompt.cast("long").alias("prompt"), "reward")
    out, checkpoint = fresh_dir(spark, "advantages"), fresh_dir(spark, "checkpoint")
    third = F.floor(F.col("doc_id") * 3 / (rows.agg(F.max("doc_id")).scalar() + 1))
    _arrive(rows, third, 3, lambda s: jobs.run_group_advantages(s, ["prompt"], 4, "doc_id", 100, out, checkpoint, "8 seconds"))
    whole = jobs.read_group_advantages(spark, ["prompt"], out).select("doc_id", F.lit(True).alias("whole"))
    emitted = jobs.read_group_advantages(spark, ["prompt"], out, flush=True).join(whole, "doc_id", "left")
    return emitted.select("doc_id", "prompt", "reward", F.coalesce("whole", F.lit(False)).alias("whole"), V.r6("advantage").alias("advantage"))
