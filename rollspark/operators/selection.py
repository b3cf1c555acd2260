"""Choosing and pairing rows: demonstrations, branches, cadence, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollspark.functions.determinism import int_div
from rollspark.functions.text import build_feedback, teacher_prompt
from rollspark.operators.skew import BLOCK_ROWS, HeavyKeys, arrival_number, equi_join, group_ordinal, pair_up, skew_join
from rollspark.session import shared_dir

WINDOW_LIMIT = 1000
EARLY_STEPS = 5  # fixed value: the first steps are always reported


def demonstrations(completions: DataFrame, prompt_keys: Sequence[str], order: str = "completion_idx") -> DataFrame:
    """F1. Every correct completion with its place in the prompt's list of demonstrations.

    The lists are kept as rows, since one prompt may hold any number of them.
    """
    correct = completions.filter(F.col("reward") > 0).select(*prompt_keys, order, "text")
    return group_ordinal(correct, prompt_keys, order, "demo_no")


def demonstration_counts(completions: DataFrame, prompt_keys: Sequence[str]) -> DataFrame:
    """F1. Length of each prompt's list, 0 for an empty one."""
    return completions.groupBy(*prompt_keys).agg(F.count_if(F.col("reward") > 0).alias("n_demos"))


def first_demonstration(
    completions: DataFrame, prompt_keys: Sequence[str], order: str = "completion_idx"
) -> DataFrame:
    """F2. The first correct completion of each prompt that has one.

    The least number per prompt is a hash aggregate without texts; the one text
    of each prompt is looked up by it. ``order`` is unique within a prompt.
    """
    correct = completions.filter(F.col("reward") > 0)
    least = correct.groupBy(*prompt_keys).agg(F.min(order).alias(order))
    texts = correct.select(*prompt_keys, order, F.col("text").alias("demo"))
    return equi_join(texts, least, [*prompt_keys, order], "inner").select(*prompt_keys, "demo")


def attach_tests(completions: DataFrame, problems: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """J1. Each completion with the test of its problem; those of unknown problems are left out, or raise if ``strict``.

    A plain join, here and in J3 and J6: Spark broadcasts a small table and
    adaptive execution splits the partitions of a hot key.
    """
    return pair_up(completions, problems.select(*keys, "test"), keys, strict)


def attach_demo(
    failed: DataFrame, demos: DataFrame, keys: Sequence[str], spread_by: Sequence[str] = (), heavy: HeavyKeys | None = None
) -> DataFrame:
    """J2. Each failed completion with its prompt's first demonstration, null without one."""
    return skew_join(failed, demos, keys, "left", spread_by, heavy)


def attach_prompt(failed: DataFrame, problems: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """J3. Each failed completion with its raw prompt; those of unknown problems are left out, or raise if ``strict``."""
    return pair_up(failed, problems.select(*keys, "prompt"), keys, strict)


def distill_branch(completions: DataFrame, feedback: str = "sdpo_feedback") -> DataFrame:
    """G10. Failed completions with feedback go to the distillation branch; the policy branch takes all completions."""
    return completions.filter((F.col("reward") <= 0) & (F.coalesce(feedback, F.lit("")) != ""))


def failure_feedback(
    completions: DataFrame, prompt_keys: Sequence[str], order: str, spread_by: Sequence[str] = ()
) -> DataFrame:
    """F2, J2, E5. Failed completions with the feedback built from their error and their prompt's demonstration."""
    failed = completions.filter(F.col("reward") <= 0)
    demos = first_demonstration(completions, prompt_keys, order)
    with_demo = attach_demo(failed, demos, prompt_keys, spread_by)
    feedback = build_feedback(F.col("text"), F.col("feedback"), F.col("demo"))
    return with_demo.withColumn("sdpo_feedback", feedback).drop("demo")


def teacher_prompts(feedback: DataFrame, problems: DataFrame, problem_keys: Sequence[str]) -> DataFrame:
    """J3, E6. The teacher's prompt of every row of the distillation branch."""
    asked = attach_prompt(distill_branch(feedback), problems, problem_keys)
    return asked.withColumn("teacher_prompt", teacher_prompt(F.col("sdpo_feedback"), F.col("prompt")))


def first_groups(
    rows: DataFrame,
    step_keys: Sequence[str],
    prompt_keys: Sequence[str],
    order: str,
    n: int,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """G2, J7. All rows of the first ``n`` prompts of each step, by first appearance, then by prompt keys."""
    keys = [*step_keys, *prompt_keys]
    chosen = chosen_groups(rows, step_keys, prompt_keys, order, n)
    return skew_join(rows, chosen, keys, "inner", spread_by or [*keys, order])


def chosen_groups(
    rows: DataFrame, step_keys: Sequence[str], prompt_keys: Sequence[str], order: str, n: int
) -> DataFrame:
    """G2. The keys of the first ``n`` prompts of each step: one rule for any ``n`` and any order column.

    Spark cuts a row number filter of up to WINDOW_LIMIT down before its shuffle;
    more are numbered in blocks. Both rank by first appearance, then by prompt keys. A
    prompt none of whose rows has an order number raises.
    """
    keys = [*step_keys, *prompt_keys]
    arrival_number(rows, order)  # the same columns are accepted
    missing = F.raise_error(F.lit(f"{order} must not be null in all rows of a prompt")).cast(rows.schema[order].dataType)
    firsts = rows.groupBy(*keys).agg(F.min(order).alias("_least"))
    firsts = firsts.withColumn("_first", F.coalesce("_least", missing)).drop("_least")
    if n <= WINDOW_LIMIT:
        rank = F.row_number().over(Window.partitionBy(*step_keys).orderBy("_first", *prompt_keys)) - 1
        ranked = firsts.withColumn("_rank", rank)
    else:
        ranked = group_ordinal(firsts, step_keys, "_first", "_rank", ties=prompt_keys)
    return ranked.filter(F.col("_rank") < n).select(*keys)


def collect_samples(
    completions: DataFrame, step_keys: Sequence[str], prompt_key: str, order: str, n: int
) -> DataFrame:
    """G1, G2. Rows of the chosen prompts, numbered within their prompt.

    Chosen and numbered on keys and order alone; the texts of these few rows are
    looked up last. ``order`` is unique within a prompt. The chosen keys are
    written to the shared folder at once, since numbering reads them several times.
    """
    keys = [*step_keys, prompt_key]
    narrow = completions.select(*keys, order)
    shared_dir(completions.sparkSession)
    chosen = equi_join(narrow, chosen_groups(narrow, step_keys, [prompt_key], order, n), keys, "left_semi").checkpoint()
    numbered = group_ordinal(chosen, keys, order, "completion_index")
    return equi_join(completions, numbered, [*keys, order], "inner")


def due_samples(
    completions: DataFrame, step: str, prompt_key: str, order: str, n: int, every: int
) -> DataFrame:
    """G4, G1, G2. Samples of the steps at which samples are due; others are gone before anything moves."""
    return collect_samples(completions.filter(progress_due(F.col(step), every)), [step], prompt_key, order, n)


def trailing_mean(
    rows: DataFrame,
    run_keys: Sequence[str],
    order: str,
    value: str,
    out: str = "trailing_mean",
    width: int = 10,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """G3. Mean of the last ``width`` values of a run up to each row.

    A run is cut into blocks of ``block_rows`` rows; the last ``width - 1`` rows
    of a block are copied to the next one, where they only serve as history.
    """
    if block_rows < width:
        raise ValueError("a block must hold at least one window")
    numbered = group_ordinal(rows, run_keys, order, "_at", block_rows)
    home = int_div(F.col("_at"), block_rows)
    near_end = F.pmod(F.col("_at"), F.lit(block_rows)) > block_rows - width
    blocks = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    copied = numbered.withColumn("_block", F.explode(blocks))
    window = Window.partitionBy(*run_keys, "_block").orderBy("_at").rowsBetween(1 - width, 0)
    return copied.withColumn(out, F.avg(value).over(window)).filter(F.col("_block") == home).drop("_at", "_block")


def progress_due(step: Column, every: int) -> Column:
    """G4. Progress and samples: every ``every`` steps and in the first few; never if not positive."""
    if every <= 0:
        return F.lit(False)
    return (F.pmod(step, F.lit(every)) == 0) | (step < EARLY_STEPS)


def periodic_due(step: Column, every: int) -> Column:
    """G4. Evaluation and saving: every ``every`` steps but not at step 0; never if not positive."""
    if every <= 0:
        return F.lit(False)
    return (F.pmod(step, F.lit(every)) == 0) & (step > 0)


def last_round(metrics: DataFrame, step_keys: Sequence[str], values: Sequence[str], acc: str = "acc") -> DataFrame:
    """G5. The metrics of each step's last accumulation round."""
    return metrics.groupBy(*step_keys).agg(F.max(acc).alias(acc), *[F.max_by(v, acc).alias(v) for v in values])


def mean_round(metrics: DataFrame, step_keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """G5. The mean over all accumulation rounds instead."""
    return metrics.groupBy(*step_keys).agg(*[F.avg(v).alias(v) for v in values])


def attach_metrics(samples: DataFrame, metrics: DataFrame, step_keys: Sequence[str], strict: bool = False) -> DataFrame:
    """J6. Each sample with the metrics of its step; those of unknown steps are left out, or raise if ``strict``."""
    return pair_up(samples, metrics, step_keys, strict)


def compare_tables(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F21. Agreement of two score tables per prompt from the per-position ``cmp`` struct.

    The top items compared are those of the last position.
    """
    c = F.col("cmp")
    return pairs.groupBy(*keys).agg(
        F.max(c["max_abs"]).alias("max_abs"),
        (F.sum(c["sum_abs"]) / F.sum(c["items"])).alias("mean_abs"),
        F.max_by(c["top_a"] == c["top_b"], "pos").alias("same_top"),
        F.bool_or(c["has_nan"]).alias("has_nan"),
        F.min(c["low"]).alias("low"),
        F.max(c["high"]).alias("high"),
    )
