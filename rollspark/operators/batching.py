"""Micro-batches, epochs, fan-out, padding, recurrent depth."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rollspark.functions.determinism import int_div, uniform
from rollspark.functions.tokens import loss_mask
from rollspark.operators.ordering import hash_ordinal, hash_ordinal_within
from rollspark.operators.skew import HeavyKeys, with_group_stats


def micro_batches(problems: DataFrame, batch_size: int, seed, key="problem_id") -> DataFrame:
    """C1. Shuffle and cut into consecutive batches; the last may be short."""
    at = F.col("_at")
    return (
        hash_ordinal(problems, key, seed, "_at")
        .withColumn("batch_no", int_div(at, batch_size))
        .withColumn("batch_idx", F.pmod(at, F.lit(batch_size)).cast("int"))
        .drop("_at")
    )


def epoch_schedule(
    problems: DataFrame,
    batch_size: int,
    steps: int,
    accumulation: int,
    seed: int,
    rank: int = 0,
    key="problem_id",
) -> DataFrame:
    """C2. Which problems each (step, accumulation round) works on, over as many reshuffled epochs as it takes.

    One output row per use of a problem. Each rank draws on its own, with its own seed.
    """
    draws = steps * accumulation
    batches = int_div(problems.agg(F.count(F.lit(1))).scalar() + (batch_size - 1), batch_size)
    epochs = F.when(batches > 0, int_div(F.lit(draws - 1) + batches, batches)).otherwise(0).cast("int")
    copies = problems.withColumn("_batches", batches).withColumn(
        "epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(0), epochs - 1)))
    )
    shuffle_seed = F.concat_ws(":", F.lit(seed + rank), F.col("epoch"))
    # Only the last epoch may be cut short; the rows of it that are left are known before they are shuffled.
    last = F.when(epochs > 0, epochs - 1)
    kept = (F.lit(draws) - last * batches) * batch_size
    ordered = hash_ordinal_within(copies, ["epoch"], key, shuffle_seed, "_at", cut=(F.col("epoch") == last, kept))
    batch_no = int_div(F.col("_at"), batch_size)
    return (
        ordered.withColumn("_draw", F.col("epoch") * F.col("_batches") + batch_no)
        .filter(F.col("_draw") < draws)
        .withColumn("step", int_div(F.col("_draw"), accumulation).cast("int"))
        .withColumn("acc", F.pmod(F.col("_draw"), F.lit(accumulation)).cast("int"))
        .withColumn("batch_no", batch_no)
        .withColumn("batch_idx", F.pmod(F.col("_at"), F.lit(batch_size)).cast("int"))
        .drop("_batches", "_draw", "_at")
    )


def fan_out(prompts: DataFrame, group_size: int) -> DataFrame:
    """C3. ``group_size`` rows per prompt, numbered from 0."""
    if group_size < 1:
        raise ValueError("group_size must be at least 1")
    return prompts.withColumn("completion_idx", F.explode(F.sequence(F.lit(0), F.lit(group_size - 1))))


def pad_batch(
    rows: DataFrame,
    batch_keys: Sequence[str],
    pad_id: int | None = None,
    eos_id: int | None = None,
    ids: str = "ids",
    prompt_len: str = "prompt_len",
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """C4. Right-pad ids to the longest row of the batch and add attention and loss masks.

    Without a pad id the end id pads, without either 0. ``heavy`` are the heavy batches, if they are known already.
    """
    pad = pad_id if pad_id is not None else (eos_id or 0)
    longest = {"padded_len": F.max(F.size(ids))}
    length, missing = F.size(ids), F.col("padded_len") - F.size(ids)
    tail = F.array_repeat(F.lit(0), missing)
    return (
        with_group_stats(rows, batch_keys, longest, heavy)
        .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), length), tail))
        .withColumn("loss_mask", F.concat(loss_mask(length, F.col(prompt_len)), tail))
        .withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), missing)))
    )


@dataclass(frozen=True)
class DepthLaw:
    """Poisson law of the number of loops, its bounds, and the share of loops that is trained."""

    # The defaults.
    expected: float = 2.0
    least: int = 1
    most: int = 8
    trained: float = 0.5

    def thresholds(self) -> list[float]:
        """P(Poisson <= k) for k below the largest depth."""
        total, bounds = 0.0, []
        for k in range(self.most):
            total += math.exp(-self.expected) * self.expected**k / math.factorial(k)
            bounds.append(total)
        return bounds


def sample_depth(*keys: Column, law: DepthLaw = DepthLaw(), seed: int = 42) -> tuple[Column, Column]:
    """G9. Clamped Poisson depth drawn per key, and how many of its loops are trained."""
    u = uniform(seed, *keys)
    depth = F.lit(law.most)
    for k, bound in reversed(list(enumerate(law.thresholds()))):
        depth = F.when(u < bound, F.lit(max(law.least, k))).otherwise(depth)
    backward = F.greatest(F.lit(1), F.ceil(depth * F.lit(law.trained)).cast("int"))
    return depth.cast("int"), backward
