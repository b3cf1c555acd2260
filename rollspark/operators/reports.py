"""Text reports as string columns, and as text files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf


# Between multi-line reports in a text file: a line with nothing but a record separator.
SEPARATOR = "\n\x1e\n"


def fixed(**numbers: tuple[Column, int]) -> Column:
    """Struct of decimal texts of (number, digits), rounded from the exact binary value, ties to even; null is 0.

    Spark's format_string rounds the printed decimal half up instead. Reports
    hold few rows, so the difference is worth one small Arrow UDF for all numbers.
    """
    digits = {name: places for name, (_, places) in numbers.items()}

    @arrow_udf("struct<" + ", ".join(f"{name}: string" for name in digits) + ">")
    def texts(rows: pa.Array) -> pa.Array:
        columns = [
            pa.array([f"{x or 0.0:.{places}f}" for x in rows.field(name).to_pylist()], pa.string())
            for name, places in digits.items()
        ]
        return pa.StructArray.from_arrays(columns, names=list(digits))

    return texts(F.struct(*[value.cast("double").alias(name) for name, (value, _) in numbers.items()]))


def _text(value: Column | str) -> Column:
    """As text, empty for null: one missing part must not blank out a report."""
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(""))


def sample_report() -> Column:
    """B2. Full text of one sample row of the log, nothing cut; missing texts are empty, missing numbers 0."""
    n = fixed(
        loss=(F.col("loss"), 4), grpo=(F.col("grpo_loss"), 4), sdpo=(F.col("sdpo_loss"), 4), mean=(F.col("reward_mean"), 4)
    )
    # Header fields and section titles.
    header = F.concat(
        F.lit("[sample step="), _text("step"),
        F.lit(" T="), _text("T"),
        F.lit(" prompt="), _text("prompt_index"),
        F.lit(" completion="), _text("completion_index"),
        F.lit(" reward="), _text("reward"),
        F.lit(" loss="), n["loss"],
        F.lit(" grpo="), n["grpo"],
        F.lit(" sdpo="), n["sdpo"],
        F.lit(" R_mean="), n["mean"],
        F.lit("]"),
    )
    return F.concat(
        F.lit("\n"), header,
        F.lit("\n--- PROMPT ---\n"), _text("prompt"),
        F.lit("\n--- MODEL PROMPT (CHAT TEMPLATE APPLIED) ---\n"), _text("model_prompt"),
        F.lit("\n--- MODEL COMPLETION ---\n"), _text("completion"),
        F.lit("\n--- VERIFIER FEEDBACK ---\n"), _text("feedback"),
        F.lit("\n--- END SAMPLE ---"),
    )


def progress_line(total_steps: int, seconds: Column) -> Column:
    """B3. One line per reported step."""
    n = fixed(
        loss=(F.col("loss"), 3), grpo=(F.col("grpo_loss"), 3), sdpo=(F.col("sdpo_loss"), 3),
        mean=(F.col("reward_mean"), 3), rho=(F.col("rho"), 4), seconds=(seconds, 1),
    )
    # Field names and widths.
    return F.concat(
        F.format_string("step %4d/", F.coalesce("step", F.lit(0))), F.lit(total_steps),
        F.lit(" | loss="), n["loss"],
        F.lit(" | grpo="), n["grpo"],
        F.lit(" | sdpo="), n["sdpo"],
        F.lit(" | R̄="), n["mean"],
        F.lit(" | T="), _text("T"),
        F.lit(" | ρ(A)="), n["rho"],
        F.lit(" | "), n["seconds"], F.lit("s"),
    )


def stability_line() -> Column:
    """F19. One line per evaluated step."""
    # Label and signs.
    sign = F.when(F.col("rho") < 1.0, F.lit(" ✓")).otherwise(F.lit(" ✗ UNSTABLE"))
    return F.concat(F.lit("  [eval] ρ(A)="), fixed(rho=(F.col("rho"), 6))["rho"], sign)


def write_reports(rows: DataFrame, column: str, path: str, separator: str = SEPARATOR) -> None:
    """B2, B3. Append the reports of one column to text files, each ended by ``separator``.

    Lines take "\\n"; reports of several lines need a separator that is in none of them.
    """
    rows.select(column).write.mode("append").option("lineSep", separator).text(path)


def read_reports(spark: SparkSession, path: str, column: str, separator: str = SEPARATOR) -> DataFrame:
    """B2, B3. Reports read back, one row each."""
    return spark.read.option("lineSep", separator).text(path).withColumnRenamed("value", column)
