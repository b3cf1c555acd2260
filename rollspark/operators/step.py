"""One training step's scores in one call: from completions, token rows and score vectors to metrics and samples.

The operators it is made of are in ``scoring`` and ``selection``; this is how they fit together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rollspark.functions.text import render_prompt
from rollspark.operators import scoring, selection
from rollspark.operators.skew import heavy_keys
from rollspark.sources.samplelog import to_log_rows


def step_losses(
    completions: DataFrame,
    tokens: DataFrame,
    student: DataFrame,
    teacher: DataFrame,
    step_keys: Sequence[str],
    group_keys: Sequence[str],
    row_key: str = "seq_id",
    strict: bool = False,
) -> DataFrame:
    """F3, F5-F9, J5, F11-F14, F18. Policy, distillation and total loss of each step.

    ``completions`` has the keys and ``reward``, ``tokens`` the row key, ``lp``,
    ``lp_old`` and ``mask``; ``student`` has (step keys, seq_id, pos, mask, logits)
    of the failed completions and ``teacher`` (seq_id, pos, logits).

    No completion is lost: one without token rows is an empty sequence, which has an
    advantage and counts as one token. Such sequences, active positions without a teacher
    and sequences with NaN are counted per step beside the losses; with ``strict`` the first two raise.
    """
    narrow = completions.select(*dict.fromkeys([row_key, *step_keys, *group_keys]), "reward")
    rows = scoring.sequence_scores(narrow, tokens, row_key, strict=strict)
    scored = scoring.group_advantage(rows, group_keys, heavy=heavy_keys(narrow, group_keys))
    policy = scoring.policy_loss(scored, step_keys)
    distill = scoring.step_distill_loss(student, teacher, step_keys, strict=strict)
    return scoring.total_loss(policy, distill, step_keys)


def step_metrics(
    completions: DataFrame,
    tokens: DataFrame,
    student: DataFrame,
    teacher: DataFrame,
    depth: DataFrame,
    step_keys: Sequence[str],
    group_keys: Sequence[str],
    row_key: str = "seq_id",
    strict: bool = False,
) -> DataFrame:
    """F17. Metric rows of each step with its counts of problem rows; ``depth`` gives T, T_bwd and rho by step."""
    losses = step_losses(completions, tokens, student, teacher, step_keys, group_keys, row_key, strict)
    return scoring.step_metrics(completions, losses, depth, step_keys)


def step_samples(
    completions: DataFrame,
    problems: DataFrame,
    metrics: DataFrame,
    n: int,
    step: str = "step",
    prompt_key: str = "prompt_index",
    order: str = "seq",
    every: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """G1, G2, G4, J3, J6. Log rows of the first ``n`` prompts of each step, with the step's metrics.

    With ``every`` only of the steps at which samples are due. Samples of unknown problems
    or of steps without metrics are left out, or raise if ``strict``.
    """
    if every is None:
        chosen = selection.collect_samples(completions, [step], prompt_key, order, n)
    else:
        chosen = selection.due_samples(completions, step, prompt_key, order, n, every)
    asked = selection.attach_prompt(chosen, problems, [prompt_key], strict)
    samples = asked.select(
        step,
        F.col(prompt_key).alias("prompt_index"),
        "completion_index",
        "prompt",
        render_prompt(F.col("prompt")).alias("model_prompt"),
        F.col("text").alias("completion"),
        "reward",
        "feedback",
    )
    return to_log_rows(selection.attach_metrics(samples, metrics, [step], strict))
