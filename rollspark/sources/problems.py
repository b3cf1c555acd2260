"""Problem sets: normalisers, mixing, sampling, dispatch."""

from __future__ import annotations

from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollspark.functions.determinism import uniform
from rollspark.operators.ordering import hash_ordinal, seeded_head
from rollspark.operators.skew import SPLIT_ROWS
from rollspark.schemas import FUNCTION_ROW, MBPP_ROW, PROBLEM
from rollspark.sources.samplelog import read_lines

# Defaults for missing keys and the marks looked for in tests.
DEFAULT_ENTRY = "solution"
DEFAULT_TEST = ""
ASSERT_MARK = "assert "
CHECK_MARK = "def check("
FIRST_SHARE = 0.8
PROBLEMS = 500

PROBLEM_KEY = ("source", "problem_id")


def _or_default(rows: DataFrame, name: str, default: str) -> Column:
    """The column, or a literal where the table lacks it. A null present in the table stays null."""
    return F.col(name) if name in rows.columns else F.lit(default)


def _problem(rows: DataFrame, source: str, prompt: Column, test: Column, entry: Column) -> DataFrame:
    return rows.select(
        F.col("problem_id").cast("string").alias("problem_id"),
        F.lit(source).alias("source"),
        prompt.alias("prompt"),
        test.alias("test"),
        entry.alias("entry"),
    )


def normalize_mbpp(rows: DataFrame, source: str = "mbpp") -> DataFrame:
    """A1. Join the assertions, name the function under test, add the signature line to the prompt."""
    first = F.get("test_list", F.lit(0))
    at = F.instr(first, ASSERT_MARK)
    call = F.substring_index(F.substr(first, at + F.lit(len(ASSERT_MARK))), ASSERT_MARK, 1)
    entry = (
        F.when(F.size("test_list") == 0, F.lit(DEFAULT_ENTRY))
        .when(at > 0, F.substring_index(call, "(", 1))
        .otherwise(F.raise_error(F.lit("the first test holds no assertion")))
    )
    signature = F.substring_index("code", "\n", 1)
    return _problem(
        rows, source, F.concat("prompt", F.lit("\n"), signature), F.array_join("test_list", "\n"), entry
    )


def normalize_humaneval(rows: DataFrame, source: str = "humaneval") -> DataFrame:
    """A2. Append the call of a test that only defines ``check``."""
    test = _or_default(rows, "test", DEFAULT_TEST)
    entry = _or_default(rows, "entry_point", DEFAULT_ENTRY)
    called = F.concat(test, F.lit("\ncheck("), entry, F.lit(")"))
    return _problem(
        rows, source, F.col("prompt"), F.when(F.contains(test, F.lit(CHECK_MARK)), called).otherwise(test), entry
    )


def normalize_plain(rows: DataFrame, source: str = "bigcodebench") -> DataFrame:
    """A4. Columns as they are, defaults for missing ones."""
    return _problem(
        rows,
        source,
        F.col("prompt"),
        _or_default(rows, "test", DEFAULT_TEST),
        _or_default(rows, "entry_point", DEFAULT_ENTRY),
    )


def weighted_mix(first: DataFrame, second: DataFrame, n: int, seed: int) -> DataFrame:
    """A3. Up to 80% of ``n`` (one row at least) from ``first``, the rest from ``second``, shuffled, cut to ``n``.

    A short first source is made up for by the second, not the other way round.
    """
    quota = max(1, int(n * FIRST_SHARE))
    taken = F.least(first.agg(F.count(F.lit(1))).scalar(), F.lit(quota))
    rest = F.greatest(F.lit(n) - taken, F.lit(0))
    head = seeded_head(first, quota, PROBLEM_KEY, seed, "_at").drop("_at")
    tail = seeded_head(second, n, PROBLEM_KEY, seed, "_at").filter(F.col("_at") < rest).drop("_at")
    return seeded_head(head.unionByName(tail), n, PROBLEM_KEY, seed)


def sample_pool(pool: DataFrame, n: int, seed: int = 42, key="problem_id") -> DataFrame:
    """A5. ``n`` draws from the pool with replacement, one row per ``draw_no``.

    Draws meet the pool on its ordinal. They are even over the pool; where that
    makes too many per pool row, each row is copied into pieces, and the draws
    are dealt out over them.
    """
    size = pool.agg(F.count(F.lit(1))).scalar()
    pieces = F.coalesce(F.ceil(F.lit(n) / F.nullif(size * SPLIT_ROWS, F.lit(0))), F.lit(1)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1))
    numbered = hash_ordinal(pool, key, seed, "_pick").withColumn("_piece", copies)
    draw_no = F.col("id")
    draws = pool.sparkSession.range(n).select(
        draw_no.alias("draw_no"),
        F.floor(uniform(seed, draw_no) * size).cast("long").alias("_pick"),
        F.pmod(F.xxhash64(draw_no), F.greatest(pieces, F.lit(1))).cast("int").alias("_piece"),
    )
    return draws.join(numbered, ["_pick", "_piece"]).drop("_pick", "_piece")


def broken_mbpp(rows: DataFrame) -> Column:
    """A6. Whether a row cannot be normalised by A1."""
    first = F.get("test_list", F.lit(0))
    missing = F.col("prompt").isNull() | F.col("code").isNull() | F.col("test_list").isNull()
    return missing | F.exists("test_list", lambda t: t.isNull()) | ((F.size("test_list") > 0) & (F.instr(first, ASSERT_MARK) == 0))


def broken_humaneval(rows: DataFrame) -> Column:
    """A6. Whether a row cannot be normalised by A2: its test is there, but null."""
    return F.col("test").isNull() if "test" in rows.columns else F.lit(False)


class BrokenSource(ValueError):
    """A source some of whose rows cannot be normalised."""


def validated(rows: DataFrame, broken: Column, name: str) -> DataFrame:
    """A6. The rows, if none of them is broken; reads the columns that tell, of the whole source, at once."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(broken).alias("broken")).first()
    if counts["broken"]:
        raise BrokenSource(f"{counts['broken']} of {counts['n']} rows of {name} are broken")
    return rows


def read_rows(spark: SparkSession, path: str, schema, broken: str = "fail", null_defaults: bool = True) -> DataFrame:
    """Raw source rows from parquet or JSON lines.

    ``broken`` says what becomes of lines that are no JSON, as in ``read_lines``.
    A key missing from a JSON object reads as null, like one that is null there;
    both get the defaults unless ``null_defaults`` is off, when both stay null.
    """
    if path.rstrip("/").endswith((".json", ".jsonl")):
        rows = read_lines(spark.read, schema, path, broken)
        if null_defaults and "test" in rows.columns:
            rows = rows.fillna({"test": DEFAULT_TEST, "entry_point": DEFAULT_ENTRY})
        return rows
    return spark.read.parquet(path)


def _source(spark: SparkSession, sources: Mapping[str, DataFrame | str], name: str, schema) -> DataFrame:
    rows = sources[name]
    return read_rows(spark, rows, schema) if isinstance(rows, str) else rows


def load_problems(
    spark: SparkSession,
    name: str,
    sources: Mapping[str, DataFrame | str],
    n: int = PROBLEMS,
    seed: int = 42,
    on_error: str = "raise",
) -> DataFrame:
    """A6. Named problem set, shuffled and cut to ``n`` problems.

    ``sources`` maps mbpp, humaneval, bigcodebench to raw rows or paths and
    builtin to a normalised pool. An unknown name, an unreadable source or a broken row raises, the
    last when the rows are read. ``on_error="fallback"`` samples the builtin pool instead: the
    whole source is looked through first, and one broken row or line of it is enough.
    """
    fallback = on_error == "fallback"

    def raw(source: str, schema, broken=None) -> DataFrame:
        rows = _source(spark, sources, source, schema)
        if not fallback:
            return rows
        # Any row will do for a source without a rule of its own, but its lines must be readable.
        return validated(rows, broken(rows) if broken else F.length("prompt") < 0, source)

    def builtin() -> DataFrame:
        return sample_pool(_source(spark, sources, "builtin", PROBLEM), n)

    def mbpp() -> DataFrame:
        return normalize_mbpp(raw("mbpp", MBPP_ROW, broken_mbpp))

    def humaneval() -> DataFrame:
        return normalize_humaneval(raw("humaneval", FUNCTION_ROW, broken_humaneval))

    try:
        match name:
            case "mbpp":
                problems = mbpp()
            case "humaneval":
                problems = humaneval()
            case "humaneval_mbpp_mix" | "mix":
                return weighted_mix(humaneval(), mbpp(), n, seed)
            case "bigcodebench":
                problems = normalize_plain(raw("bigcodebench", FUNCTION_ROW))
            case "builtin":
                return builtin()
            case _:
                raise ValueError(f"unknown problem set {name!r}")
        return seeded_head(problems, n, PROBLEM_KEY, seed)
    except (ValueError, KeyError, PySparkException, Py4JJavaError):
        if not fallback:
            raise
        return builtin()


def problem_count(problems: DataFrame) -> DataFrame:
    """A9. Number of problems, as a one-row table."""
    return problems.agg(F.count(F.lit(1)).alias("n_problems"))


def problem_at(problems: DataFrame, position: int | Column, seed: int, key="problem_id") -> DataFrame:
    """A9. The problem at one 0-based position of the seeded order; negative positions count from the end."""
    size = problems.agg(F.count(F.lit(1))).scalar()
    position = position if isinstance(position, Column) else F.lit(position)
    wanted = F.when(position < 0, position + size).otherwise(position)
    return hash_ordinal(problems, key, seed, "position", only=wanted)


def reshuffle(problems: DataFrame, seed: int, salt: int | str, key="problem_id") -> DataFrame:
    """A10. Another seeded order of the same problems."""
    return hash_ordinal(problems, key, f"{seed}:{salt}", "position")
