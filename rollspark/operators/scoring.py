"""Advantages, losses and step metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollspark.functions.vocab import distill_terms, entropy_weight, item_logprob
from rollspark.operators.skew import HeavyKeys, mark_pairs, pair_up, with_group_stats

# Smallest spread that counts, and the term that keeps the quotient finite.
SIGMA_FLOOR = 1e-8
POSITION = ("seq_id", "pos")

# How far the ratio may fall below and rise above 1, and how much an uncertain teacher counts less.
CLIP_LOW = 0.2
CLIP_HIGH = 0.28
ENTROPY_WEIGHT = 0.01


# What a step's loss tells about rows that could not count as they should; carried into its metrics.
PROBLEM_COUNTS = ("nan_sequences", "unpaired_sequences", "unpaired_positions")


def standardized(reward: Column, mean: Column, sigma: Column) -> Column:
    return F.when(sigma >= SIGMA_FLOOR, (reward - mean) / (sigma + SIGMA_FLOOR)).otherwise(0.0)


def group_advantage(
    rows: DataFrame, group_keys: Sequence[str], reward: str = "reward", heavy: HeavyKeys | None = None
) -> DataFrame:
    """F3. Reward relative to the row's group; 0 in groups of one and in groups of equal reward.

    ``heavy`` are the heavy groups, if they are known already.
    """
    r = F.col(reward)
    stats = {"_mean": F.avg(r), "_sigma": F.stddev_pop(r)}
    # A group of one has no spread, so the floor covers it too.
    joined = with_group_stats(rows, group_keys, stats, heavy)
    return joined.withColumn("advantage", standardized(r, F.col("_mean"), F.col("_sigma"))).drop("_mean", "_sigma")


def global_advantage(rows: DataFrame, reward: str = "reward") -> DataFrame:
    """F4. Reward relative to all rows; the statistics are one scalar subquery."""
    r = F.col(reward)
    stats = rows.agg(F.struct(F.avg(r).alias("mean"), F.stddev_pop(r).alias("sigma"))).scalar()
    return (
        rows.withColumn("_stats", stats)
        .withColumn("advantage", standardized(r, F.col("_stats.mean"), F.col("_stats.sigma")))
        .drop("_stats")
    )


def pair_policies(
    current: DataFrame, old: DataFrame, keys: Sequence[str] = POSITION, strict: bool = False
) -> DataFrame:
    """J4. Log-probs of both policies by position; ``lp`` of the old policy becomes ``lp_old``.

    Positions the old policy lacks are left out, or raise if ``strict``.
    """
    return pair_up(current, old.select(*keys, F.col("lp").alias("lp_old")), keys, strict)


def pair_logits(
    student: DataFrame, teacher: DataFrame, keys: Sequence[str] = POSITION, strict: bool = False
) -> DataFrame:
    """J5. Score vectors of student and teacher by position.

    Both sides are wide: tables written with ``write_by_sequence`` join without a shuffle. Positions the teacher
    lacks are left out, or raise if ``strict``.
    """
    return pair_up(student, teacher.select(*keys, F.col("logits").alias("teacher_logits")), keys, strict)


def write_by_sequence(rows: DataFrame, table: str, buckets: int) -> None:
    """Write score vectors bucketed and sorted by position, ready for J5 and D8."""
    rows.write.bucketBy(buckets, *POSITION).sortBy(*POSITION).mode("overwrite").saveAsTable(table)


def taken_logprobs(tokens: DataFrame, logits: DataFrame, strict: bool = False) -> DataFrame:
    """D8. Log-prob of each response token under the scores of the position before it.

    ``tokens`` has (seq_id, pos, id, prompt_len), ``logits`` has (seq_id, pos,
    logits). Tokens without a loss position get 0. Only tokens that need scores
    enter the join, and the vector is reduced to one number right after it. A
    token whose vector is missing, or has no such item, gets null, or raises if ``strict``.
    """
    scored = F.col("pos") >= F.greatest("prompt_len", F.lit(1))
    missing = F.raise_error(F.lit("a token has no score")) if strict else F.lit(None)
    missing = missing.cast("double")
    wanted = tokens.filter(scored).withColumn("_at", F.col("pos") - 1)
    vectors = logits.select("seq_id", F.col("pos").alias("_at"), "logits")
    vectors = vectors.join(wanted.select("seq_id", "_at"), ["seq_id", "_at"], "left_semi")
    reduced = (
        wanted.join(vectors, ["seq_id", "_at"], "left")
        .withColumn("lp", F.coalesce(item_logprob("logits", "id"), missing))
        .select("seq_id", "pos", "id", "prompt_len", "lp")
    )
    rest = tokens.filter(~scored).select("seq_id", "pos", "id", "prompt_len", F.lit(0.0).alias("lp"))
    return reduced.unionByName(rest)


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum of value times mask over two arrays."""
    return F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, v: a + v)


def mask_total(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)


def sequence_logprob(values: Column, mask: Column) -> Column:
    """F5. Masked mean over array columns; an empty mask counts as one token."""
    return masked_sum(values, mask) / F.greatest(mask_total(mask), F.lit(1.0))


def sequence_logprobs(tokens: DataFrame, keys: Sequence[str], values: Sequence[str], mask: str = "mask") -> DataFrame:
    """F5. The same over token rows, for several log-prob columns at once."""
    m = F.col(mask).cast("double")
    return (
        tokens.groupBy(*keys)
        .agg(F.sum(m).alias("mask_total"), *[F.sum(F.col(v) * m).alias(f"seq_{v}") for v in values])
        .select(
            *keys,
            "mask_total",
            *[(F.col(f"seq_{v}") / F.greatest("mask_total", F.lit(1.0))).alias(f"seq_{v}") for v in values],
        )
    )


def importance_ratio(seq_lp: Column, seq_lp_old: Column) -> Column:
    """F6."""
    return F.exp(seq_lp - seq_lp_old)


def clip_ratio(rho: Column, low: float = CLIP_LOW, high: float = CLIP_HIGH) -> Column:
    """F7. Clip to [1 - low, 1 + high]; NaN stays NaN."""
    # Spark takes NaN for the largest number, so the bounds would make a normal ratio of it.
    return F.when(F.isnan(rho), rho).otherwise(F.least(F.greatest(rho, F.lit(1.0 - low)), F.lit(1.0 + high)))


def clipped_surrogate(
    rho: Column, advantage: Column, low: float = CLIP_LOW, high: float = CLIP_HIGH
) -> Column:
    """F8. NaN in the ratio or the advantage stays NaN."""
    plain = rho * advantage
    return F.when(F.isnan(plain), plain).otherwise(F.least(plain, clip_ratio(rho, low, high) * advantage))


def policy_loss(
    rows: DataFrame,
    step_keys: Sequence[str],
    low: float = CLIP_LOW,
    high: float = CLIP_HIGH,
) -> DataFrame:
    """F9. Token-weighted clipped surrogate per step, negated.

    ``rows`` has one row per sequence: seq_lp, seq_lp_old, mask_total, advantage.
    Sequences without advantage still count in the denominator, empty ones as
    one token; a step of fewer than two sequences has loss 0. A NaN among the
    surrogates makes the step's loss NaN; ``nan_sequences`` counts them. If the rows
    have a column ``paired``, ``unpaired_sequences`` counts those where it is false.
    """
    rho = importance_ratio(F.col("seq_lp"), F.col("seq_lp_old"))
    surrogate = clipped_surrogate(rho, F.col("advantage"), low, high)
    total = F.sum(surrogate * F.col("mask_total"))
    tokens = F.greatest(F.sum(F.greatest("mask_total", F.lit(1.0))), F.lit(1.0))
    loss = F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(-total / tokens)
    counts = [F.count_if(F.isnan(surrogate)).alias("nan_sequences")]
    if "paired" in rows.columns:
        counts.append(F.count_if(~F.col("paired")).alias("unpaired_sequences"))
    return rows.groupBy(*step_keys).agg(loss.alias("grpo_loss"), *counts)


def sequence_scores(
    completions: DataFrame, tokens: DataFrame, row_key: str, values: Sequence[str] = ("lp", "lp_old"), strict: bool = False
) -> DataFrame:
    """F5. Every completion with the masked means of its token rows.

    One without token rows is a sequence without tokens: means and ``mask_total``
    are 0 and ``paired`` is false, or it raises if ``strict``.
    """
    means = sequence_logprobs(tokens, [row_key], values)
    rows = mark_pairs(completions, means, [row_key], "paired", strict)
    zero = F.lit(0.0)
    filled = [F.when(F.col("paired"), F.col(c)).otherwise(zero).alias(c) for c in ("mask_total", *[f"seq_{v}" for v in values])]
    return rows.select(*completions.columns, *filled, "paired")


def distill_positions(
    pairs: DataFrame, weight: float = ENTROPY_WEIGHT, direction: str = "teacher_student"
) -> DataFrame:
    """F11-F13 per position: kl, entropy, weight; null where masked out or marked as not ``paired``. Vectors are dropped."""
    active = F.col("mask") > 0
    if "paired" in pairs.columns:
        active = active & F.col("paired")
    terms = distill_terms(
        F.when(active, F.col("logits")), F.when(active, F.col("teacher_logits")), direction
    )
    return (
        pairs.withColumn("_terms", terms)
        .withColumn("kl", F.col("_terms.kl"))
        .withColumn("entropy", F.col("_terms.entropy"))
        .withColumn("weight", entropy_weight(F.col("_terms.entropy"), F.col("_terms.items"), weight))
        .drop("_terms", "logits", "teacher_logits")
    )


def distill_loss(
    pairs: DataFrame,
    step_keys: Sequence[str],
    weight: float = ENTROPY_WEIGHT,
    direction: str = "teacher_student",
) -> DataFrame:
    """F14. Mean of KL times weight over the active tokens of a step; 0 without any.

    With a column ``paired``, ``unpaired_positions`` counts the rows where it is false.
    """
    scored = distill_positions(pairs, weight, direction)
    counts = [F.count_if(~F.col("paired")).alias("unpaired_positions")] if "paired" in pairs.columns else []
    return scored.groupBy(*step_keys).agg(
        F.coalesce(F.avg(F.col("kl") * F.col("weight")), F.lit(0.0)).alias("sdpo_loss"), *counts
    )


def step_distill_loss(
    student: DataFrame,
    teacher: DataFrame,
    step_keys: Sequence[str],
    weight: float = ENTROPY_WEIGHT,
    direction: str = "teacher_student",
    strict: bool = False,
) -> DataFrame:
    """J5, F14. Distillation loss of two score tables, joining active positions only.

    Vectors of masked positions are filtered out on both sides before they
    could be shuffled: the teacher meets the narrow list of active positions,
    which Spark broadcasts or turns into a Bloom filter. Steps that have no
    active position come back with 0. Active positions without a teacher are no part of
    the mean; ``unpaired_positions`` counts them, or they raise if ``strict``.
    """
    wanted = student.filter(F.col("mask") > 0)
    known = teacher.join(wanted.select(*POSITION), list(POSITION), "left_semi")
    known = known.select(*POSITION, F.col("logits").alias("teacher_logits"))
    active = mark_pairs(wanted, known, list(POSITION), "paired", strict)
    losses = distill_loss(active, step_keys, weight, direction)
    steps = student.select(*step_keys).distinct()
    # Only what is missing becomes 0: fillna would also turn NaN into 0.
    filled = [F.coalesce(name, F.lit(zero)).alias(name) for name, zero in (("sdpo_loss", 0.0), ("unpaired_positions", 0))]
    return steps.join(losses, list(step_keys), "left").select(*step_keys, *filled)


def combine_means(chunks: DataFrame, step_keys: Sequence[str], mean: str = "mean", n: str = "n") -> DataFrame:
    """F15. Token-weighted mean of chunk means; 0 when all chunks are empty."""
    total = F.sum(F.col(n))
    weighted = F.sum(F.coalesce(F.col(mean), F.lit(0.0)) * F.col(n))
    return chunks.groupBy(*step_keys).agg(F.when(total > 0, weighted / total).otherwise(0.0).alias("sdpo_loss"))


def response_total(rows: DataFrame, step_keys: Sequence[str], length: Column, prompt_len: Column) -> DataFrame:
    """F16. Loss-carrying tokens per step, at least 1."""
    tokens = F.greatest(length - F.greatest(prompt_len, F.lit(1)), F.lit(0))
    return rows.groupBy(*step_keys).agg(F.greatest(F.sum(tokens), F.lit(1)).alias("response_tokens"))


def reward_metrics(completions: DataFrame, step_keys: Sequence[str]) -> DataFrame:
    """F17. Mean reward and counts of correct and failed completions."""
    return completions.groupBy(*step_keys).agg(
        F.coalesce(F.avg("reward"), F.lit(0.0)).alias("reward_mean"),
        F.count_if(F.col("reward") > 0).alias("n_correct"),
        F.count_if(F.col("reward") <= 0).alias("n_failed"),
    )


def total_loss(policy: DataFrame, distill: DataFrame, step_keys: Sequence[str]) -> DataFrame:
    """F18. Sum of both losses; a branch missing for a step counts 0. Counts of problem rows come along."""
    both = policy.join(distill, list(step_keys), "full")
    zero = F.lit(0.0)
    return both.select(
        *step_keys,
        F.coalesce("grpo_loss", zero).alias("grpo_loss"),
        F.coalesce("sdpo_loss", zero).alias("sdpo_loss"),
        (F.coalesce("grpo_loss", zero) + F.coalesce("sdpo_loss", zero)).alias("loss"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in PROBLEM_COUNTS if c in both.columns],
    )


def step_metrics(
    completions: DataFrame,
    losses: DataFrame,
    depth: DataFrame,
    step_keys: Sequence[str],
) -> DataFrame:
    """F17. Full metric rows: reward counts, losses, and depth and spectral radius given per step.

    Counts of problem rows that ``losses`` has come last.
    """
    keys = list(step_keys)
    counts = reward_metrics(completions, keys)
    joined = counts.join(losses, keys, "left").join(depth, keys, "left")
    zero = F.lit(0.0)
    return joined.select(
        *keys,
        "T",
        "T_bwd",
        *[F.coalesce(name, zero).alias(name) for name in ("loss", "grpo_loss", "sdpo_loss")],
        "reward_mean",
        "rho",
        "n_correct",
        "n_failed",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in PROBLEM_COUNTS if c in losses.columns],
    )


def stability(metrics: DataFrame) -> DataFrame:
    """F19. Whether the spectral radius stays below 1."""
    return metrics.withColumn("stable", F.col("rho") < 1.0)
