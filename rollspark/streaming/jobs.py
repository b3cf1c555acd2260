"""Structured Streaming jobs over arriving rollouts (K1-K4).

K3 and K4 watch groups of rows (a step, a prompt) until they are whole. Each is some
queries in a row, all of Spark's own state and file sinks, so that a restart or a lost
executor changes nothing:

1. Rows are landed as they come, with the slot of time they arrived in.
2. Rows of a group and slot are reduced to sums, by a windowed aggregate with a watermark on
   the arrival time, which gives each slot out once, when the watermark has passed it.
3. A group's slots are gathered in state, in order of time, and given out once the group is
   closed. The state holds sums and slot numbers: a group with a third of all rows is as small as
   any other, and its rows never meet in a task. K3 closes a group by time alone, so its slots
   are the sessions of Spark's session windows, and a further aggregate knows the
   groups that had one; no group costs a call of Python. K4 also counts, which takes a function of its own.

Nothing written is written again, so a micro-batch costs what came in with it. Slots are in
order of time whichever micro-batch brought them, so results do not depend on how the
input was cut, as long as no row comes later than ``delay`` behind the newest one. Rows
that do are not lost: they are landed, and told apart when the results are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rollspark.functions.text import extract_code, verdict
from rollspark.operators.scoring import standardized
from rollspark.operators.skew import equi_join, with_group_stats
from rollspark.operators.verify import SECONDS, verify_completions
from rollspark.schemas import SAMPLE_LOG, struct_of
from rollspark.sources.samplelog import read_lines


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything available to parquet files, then stop; the checkpoint makes it resumable."""
    (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def _drain_batches(stream: DataFrame, step, checkpoint: str, mode: str = "append") -> None:
    (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def follow_log(spark: SparkSession, path: str, broken: str = "fail", files: int | None = None) -> DataFrame:
    """K1. The sample log as a stream: each new file once, at most ``files`` in a micro-batch."""
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    return read_lines(reader, SAMPLE_LOG, path, broken)


def judge_stream(completions: DataFrame) -> DataFrame:
    """K2. Extracted code and verdict of arriving completions; stateless, works on batches alike."""
    reward, feedback = verdict(F.col("stdout"), F.col("stderr"), F.col("timed_out"), F.col("launch_error"))
    return completions.withColumn("code", extract_code(F.col("text"))).select(
        "*", reward.alias("reward"), feedback.alias("feedback")
    )


def run_verification(completions: DataFrame, path: str, checkpoint: str, seconds: float = SECONDS) -> None:
    """K2. Run arriving completions (text, test) against their tests; one table of verdicts per micro-batch."""

    def judge(batch: DataFrame, batch_id: int) -> None:
        verify_completions(batch, seconds).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    _drain_batches(completions, judge, checkpoint)


ARRIVED = "_arrived"
SLOT, SLOT_END = "_slot", "_slot_end"
# Of the rows of a slot or group: how many, and of their rewards the mean and the squared distances from it.
SUMS = {"n": T.LongType(), "n_correct": T.LongType(), "n_failed": T.LongType(), "mean": T.DoubleType(), "apart": T.DoubleType()}
STEP_SUMS = ("n", "n_correct", "n_failed", "mean")  # what K3 gives out
STATE = struct_of(**SUMS, last=T.LongType(), slots=T.ArrayType(T.LongType()))


def _land(rows: DataFrame, arrival: str, slot: str, path: str, checkpoint: str) -> DataFrame:
    """Append rows with their arrival time and slot; the landed table as a stream."""
    spark = rows.sparkSession
    kind = rows.schema[arrival].dataType
    if isinstance(kind, (T.StringType, T.DateType, T.BooleanType)):
        raise TypeError(f"{arrival} must be a timestamp or a number of seconds")
    at = F.col(arrival).cast("timestamp")
    landed = rows.withColumn(ARRIVED, F.coalesce(at, F.raise_error(F.lit(f"{arrival} must not be null")).cast("timestamp")))
    landed = landed.withColumn(SLOT, F.window(ARRIVED, slot)["start"])
    # An empty table that holds the schema, for readers that come before the first row.
    spark.createDataFrame([], landed.schema).write.mode("ignore").parquet(f"{path}/shape")
    drain(landed, f"{path}/rows", f"{checkpoint}/rows")
    return spark.readStream.schema(landed.schema).parquet(f"{path}/rows")


def _reduced(reward: str) -> list[Column]:
    r = F.col(reward)
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(r > 0).alias("n_correct"),
        F.count_if(r <= 0).alias("n_failed"),
        F.avg(r).alias("mean"),
        (F.var_pop(r) * F.count(r)).alias("apart"),
    ]


def _sum_slots(landed: DataFrame, keys: Sequence[str], reward: str, slot: str, delay: str, path: str, checkpoint: str) -> DataFrame:
    """Append the sums of each group and slot once the watermark has passed the slot; that table as a stream."""
    spark = landed.sparkSession
    timed = landed.withWatermark(ARRIVED, delay).groupBy(*keys, F.window(ARRIVED, slot).alias("_window"))
    sums = timed.agg(*_reduced(reward))
    sums = sums.select(*keys, F.col("_window.start").alias(SLOT), F.col("_window.end").alias(SLOT_END), *SUMS)
    drain(sums, f"{path}/slots", f"{checkpoint}/slots")
    return spark.readStream.schema(sums.schema).parquet(f"{path}/slots")


def _merged(a: tuple, b: tuple) -> tuple:
    """Sums of two lots of rows together; the mean is that of rewards that are not null."""
    n, correct, failed, mean, apart = a
    n2, correct2, failed2, mean2, apart2 = b
    known, known2 = correct + failed, correct2 + failed2
    if not known or not known2:
        mean, apart = (mean, apart) if known else (mean2, apart2)
    else:
        gap, whole = mean2 - mean, known + known2
        mean, apart = mean + gap * known2 / whole, apart + apart2 + gap * gap * known * known2 / whole
    return n + n2, correct + correct2, failed + failed2, mean, apart


def _sessions(slots: DataFrame, keys: Sequence[str], patience: float, path: str, checkpoint: str) -> DataFrame:
    """Append the sums of each group's slots that follow one another by ``patience`` seconds at most, when that time is over; that table as a stream."""
    spark = slots.sparkSession
    # Half a millisecond more, as slots end at whole ones: a slot that ends just then still belongs to its session.
    gap = f"{int(patience * 1000) * 1000 + 500} microseconds"
    timed = slots.withColumn("_end", F.col(SLOT_END)).withWatermark("_end", "0 seconds")
    known = F.col("n_correct") + F.col("n_failed")
    mean = F.try_divide(F.sum(F.col("mean") * known), F.sum(known))
    sums = [F.sum(c).alias(c) for c in ("n", "n_correct", "n_failed")]
    runs = timed.groupBy(*keys, F.session_window("_end", gap)).agg(F.min(SLOT).alias(SLOT), *sums, mean.alias("mean"))
    runs = runs.select(*keys, SLOT, *STEP_SUMS)
    drain(runs, f"{path}/sessions", f"{checkpoint}/sessions")
    return spark.readStream.schema(runs.schema).parquet(f"{path}/sessions")


def _first_sessions(sessions: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> None:
    """Append the first session of each group, once.

    Sessions of a group come in order of time, but some may come together. A group is new if the time
    of the micro-batch, which is the same after a retry, is that of all its sessions.
    """
    timed = sessions.withColumn("_now", F.current_timestamp())
    held = timed.groupBy(*keys).agg(F.min(F.struct(SLOT, *STEP_SUMS)).alias("_first"), F.min("_now").alias("_since"), F.max("_now").alias("_now"))
    firsts = held.filter("_since = _now").select(*keys, "_first.*")
    # An empty table, for readers that come before the first group.
    sessions.sparkSession.createDataFrame([], firsts.schema).write.mode("ignore").parquet(f"{path}/groups/batch_id=-1")

    def give(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/groups/batch_id={batch_id}")

    _drain_batches(firsts, give, f"{checkpoint}/groups", "update")


def _gather(slots: DataFrame, keys: Sequence[str], patience: float, enough: int, path: str, checkpoint: str) -> None:
    """Append each group's sums when it is closed, at every slot they were gathered from.

    A group is closed by the slot that brings it to ``enough`` rows, or if its next slot ends more than
    ``patience`` seconds after its last one, or none comes before the watermark is so far. Later slots
    begin the group again.
    """
    wait = int(patience * 1000)
    kinds = [slots.schema[k] for k in keys]
    out = T.StructType([*kinds, T.StructField(SLOT, T.LongType()), *STATE.fields[: len(SUMS)]])

    def fold(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        given = []

        def close(held):
            given.extend((*key, at, *held[:5]) for at in held[6])

        held = state.get if state.exists else None
        if held is not None:
            held = (*held[:6], list(held[6]))
        if state.hasTimedOut:
            close(held)
            held = None
        else:
            found = [row for batch in batches for row in zip(*(batch[c] for c in (SLOT, SLOT_END, *SUMS)))]
            for at, end, *sums in sorted(found, key=lambda row: row[0]):
                at, end = int(at), int(end)
                sums = (*map(int, sums[:3]), *map(float, sums[3:]))
                if held is not None and end - held[5] > wait:
                    close(held)
                    held = None
                if held is None:
                    held = (*sums, end, [at])
                else:
                    held = (*_merged(held[:5], sums), end, [*held[6], at])
                if held[0] >= enough:
                    close(held)
                    held = None
        if held is None:
            state.remove() if state.exists else None
        else:
            state.update(held)
            state.setTimeoutTimestamp(max(held[5] + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(given, columns=out.fieldNames())

    timed = slots.withColumn("_end", F.col(SLOT_END)).withWatermark("_end", "0 seconds")
    narrow = timed.select(*keys, "_end", F.unix_millis(SLOT).alias(SLOT), F.unix_millis(SLOT_END).alias(SLOT_END), *SUMS)
    gathered = narrow.groupBy(*keys).applyInPandasWithState(fold, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    drain(gathered.withColumn(SLOT, F.timestamp_millis(SLOT)), f"{path}/groups", f"{checkpoint}/groups")


def _landed(spark: SparkSession, path: str) -> DataFrame:
    shape = spark.read.parquet(f"{path}/shape").schema
    return spark.read.schema(shape).parquet(f"{path}/rows")


def _groups(spark: SparkSession, keys: Sequence[str], path: str) -> DataFrame:
    shape = spark.read.parquet(f"{path}/shape").schema
    return spark.read.schema(T.StructType([*[shape[k] for k in keys], T.StructField(SLOT, T.TimestampType()), *STATE.fields[: len(SUMS)]])).parquet(f"{path}/groups")


def run_step_metrics(
    samples: DataFrame, keys: Sequence[str], arrival: str, patience: float, path: str, checkpoint: str,
    slot: str = "10 seconds", delay: str = "0 seconds",
) -> None:
    """K3. Metrics of each step, appended once, ``patience`` seconds after its last sample.

    ``arrival`` is a timestamp or a number of seconds, ``delay`` how far behind the newest one a sample may come.
    """
    landed = _land(samples, arrival, slot, path, checkpoint)
    slots = _sum_slots(landed, keys, "reward", slot, delay, path, checkpoint)
    _first_sessions(_sessions(slots, keys, patience, path, checkpoint), keys, path, checkpoint)


def _metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg("reward").alias("reward_mean"), F.count_if(F.col("reward") > 0).alias("n_correct"), F.count_if(F.col("reward") <= 0).alias("n_failed"))


def read_step_metrics(spark: SparkSession, keys: Sequence[str], path: str, flush: bool = False) -> DataFrame:
    """K3. The closed steps, each once; with ``flush`` also those still open, over all samples so far, ``closed`` is false for them."""
    closed = _groups(spark, keys, path).select(*keys, F.col("mean").alias("reward_mean"), "n_correct", "n_failed", F.lit(True).alias("closed"))
    if not flush:
        return closed
    open_ = equi_join(_landed(spark, path), closed.select(*keys), keys, "left_anti")
    return closed.unionByName(_metrics(open_, keys).withColumn("closed", F.lit(False)))


def read_late_samples(spark: SparkSession, keys: Sequence[str], path: str) -> DataFrame:
    """K3. For each closed step how many of its samples came too late to count, ``n_late``; none for steps without any."""
    landed = _landed(spark, path).groupBy(*keys).agg(F.count(F.lit(1)).alias("_landed"))
    counted = _groups(spark, keys, path).select(*keys, F.col("n").alias("_counted"))
    both = equi_join(landed, counted, keys, "inner")
    return both.withColumn("n_late", F.col("_landed") - F.col("_counted")).filter("n_late > 0").select(*keys, "n_late")


def run_group_advantages(
    completions: DataFrame, keys: Sequence[str], group_size: int, arrival: str, patience: float, path: str, checkpoint: str,
    slot: str = "1 second", delay: str = "0 seconds",
) -> None:
    """K4. Advantages of each prompt group, given out when it has ``group_size`` completions.

    A group is whole at the end of the slot that brings it to that many, all of that slot included; one that stays short is given out as it is
    ``patience`` seconds after its last completion. Completions that come after begin the group anew: they
    wait for ``group_size`` of their own and are scored among those. ``arrival`` is a timestamp or a number of
    seconds, ``delay`` how far behind the newest one a completion may come.
    """
    landed = _land(completions, arrival, slot, path, checkpoint)
    slots = _sum_slots(landed, keys, "reward", slot, delay, path, checkpoint)
    _gather(slots, keys, patience, group_size, path, checkpoint)


def read_group_advantages(spark: SparkSession, keys: Sequence[str], path: str, flush: bool = False) -> DataFrame:
    """K4. All rows of groups that were given out; with ``flush`` also the others, each group's together as they are.

    The latter are rows that wait and rows that came too late for their slot.
    """
    landed = _landed(spark, path)
    columns = [c for c in landed.columns if c not in (ARRIVED, SLOT)]
    # The sums of a group stand at each of its slots: a key of many rows has many slots.
    groups = _groups(spark, keys, path).select(*keys, SLOT, "mean", F.sqrt(F.col("apart") / (F.col("n_correct") + F.col("n_failed"))).alias("_sigma"))
    scored = equi_join(landed, groups, [*keys, SLOT], "inner")
    reward = F.col("reward")
    given = scored.withColumn("advantage", standardized(reward, F.col("mean"), F.col("_sigma"))).select(*columns, "advantage")
    if not flush:
        return given
    rest = equi_join(landed, groups, [*keys, SLOT], "left_anti").select(*columns)
    stats = {"_mean": F.avg(reward), "_sigma": F.stddev_pop(reward)}
    rest = with_group_stats(rest, keys, stats)
    waiting = rest.withColumn("advantage", standardized(reward, F.col("_mean"), F.col("_sigma"))).drop("_mean", "_sigma")
    return given.unionByName(waiting)
