"""Rollout-shaped inputs derived from the given tables, as DataFrames and as SQL.

Every view reads whole tables and whole texts. The SQL twins are common table
expressions for the checks; they are written on their own, not generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollspark.functions.determinism import int_div


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(*views: str, body: str) -> str:
    """SELECT over the named SQL views and those they need."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for view in views:
        add(view)
    return "WITH " + ",\n".join(f"{name} AS ({SQL[name]})" for name in wanted) + "\n" + body


def to_text(array: Column) -> Column:
    return F.array_join(array.cast("array<string>"), ",")


def r6(value: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


SQL: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


# -- problems ----------------------------------------------------------------


def mbpp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertion-list problems from ``part``; every tenth size has no tests."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    tests = F.array(
        F.concat(F.lit("assert f"), key, F.lit("(1) == 1")),
        F.concat(F.lit("assert f"), key, F.lit("("), size, F.lit(") == "), size),
    )
    return table(spark, sf_dir, "part").select(
        key.alias("problem_id"),
        F.concat_ws(" ", F.lit("Write the function for"), "p_name", "p_type").alias("prompt"),
        F.concat(F.lit("def f"), key, F.lit("(x):\n    return x  # "), F.col("p_brand")).alias("code"),
        F.when(F.pmod("p_size", F.lit(10)) == 0, F.array().cast("array<string>")).otherwise(tests).alias("test_list"),
    )


SQL["mbpp_rows"] = """
  SELECT p_partkey::VARCHAR AS problem_id,
         'Write the function for ' || p_name || ' ' || p_type AS prompt,
         'def f' || p_partkey || '(x):' || chr(10) || '    return x  # ' || p_brand AS code,
         CASE WHEN p_size % 10 = 0 THEN []::VARCHAR[]
              ELSE ['assert f' || p_partkey || '(1) == 1',
                    'assert f' || p_partkey || '(' || p_size || ') == ' || p_size] END AS test_list
  FROM part"""


def function_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function problems from ``documents``: some tests define ``check``, some assert at once."""
    n = F.col("n_chars").cast("string")
    checked = F.concat(F.lit("def check(candidate):\n    assert candidate("), n, F.lit(") > 0"))
    plain = F.concat(F.lit("assert solve_"), "lang", F.lit("("), n, F.lit(")"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("problem_id"),
        F.col("text").alias("prompt"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, plain).otherwise(checked).alias("test"),
        F.concat(F.lit("solve_"), "lang").alias("entry_point"),
    )


SQL["function_rows"] = """
  SELECT doc_id::VARCHAR AS problem_id, text AS prompt,
         CASE WHEN doc_id % 3 = 0 THEN 'assert solve_' || lang || '(' || n_chars || ')'
              ELSE 'def check(candidate):' || chr(10) || '    assert candidate(' || n_chars || ') > 0' END AS test,
         'solve_' || lang AS entry_point
  FROM documents"""


def bare_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems without tests or entry points from ``benchmark``."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("problem_id"), F.col("text").alias("prompt")
    )


# Normalised problem sets, for the queries that start from them.
SQL["mbpp"] = """
  SELECT problem_id, 'mbpp' AS source,
         prompt || chr(10) || split_part(code, chr(10), 1) AS prompt,
         coalesce(array_to_string(test_list, chr(10)), '') AS test,
         CASE WHEN len(test_list) = 0 THEN 'solution'
              ELSE split_part(split_part(test_list[1], 'assert ', 2), '(', 1) END AS entry
  FROM mbpp_rows"""
NEEDS["mbpp"] = ("mbpp_rows",)
SQL["humaneval"] = """
  SELECT problem_id, 'humaneval' AS source, prompt,
         CASE WHEN contains(test, 'def check(') THEN test || chr(10) || 'check(' || entry_point || ')'
              ELSE test END AS test,
         entry_point AS entry
  FROM function_rows"""
NEEDS["humaneval"] = ("function_rows",)
SQL["pool"] = """
  SELECT item_id::VARCHAR AS problem_id, 'builtin' AS source, text AS prompt, '' AS test, 'solution' AS entry
  FROM benchmark"""


# -- rollouts ----------------------------------------------------------------


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as completions: quality is the reward, (lang, source) the prompt."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("reward"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id")


SQL["rollouts"] = """
  SELECT d.doc_id, d.lang, d.source, d.text, l.quality::DOUBLE AS reward
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts with step, prompt number within the step and verifier feedback."""
    return rollouts(spark, sf_dir).select(
        int_div(F.col("doc_id"), 100).cast("int").alias("step"),
        F.substring("source", 4, 9).cast("int").alias("prompt_index"),
        F.col("doc_id").alias("seq"),
        "text",
        "reward",
        F.when(F.col("reward") > 0, "All tests passed.")
        .otherwise(F.concat(F.lit("AssertionError: "), "lang"))
        .alias("feedback"),
    )


SQL["completions"] = """
  SELECT (doc_id // 100)::INTEGER AS step, substr(source, 4)::INTEGER AS prompt_index, doc_id AS seq, text, reward,
         CASE WHEN reward > 0 THEN 'All tests passed.' ELSE 'AssertionError: ' || lang END AS feedback
  FROM rollouts"""
NEEDS["completions"] = ("rollouts",)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt texts and tests by prompt number, from ``part``."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("prompt_index"),
        F.concat_ws(" ", F.lit("Write"), "p_name", F.lit("by"), "p_brand").alias("prompt"),
        F.concat(F.lit("assert f("), F.col("p_size"), F.lit(") == 1")).alias("test"),
    )


SQL["prompts"] = """
  SELECT p_partkey::INTEGER AS prompt_index, 'Write ' || p_name || ' by ' || p_brand AS prompt,
         'assert f(' || p_size || ') == 1' AS test
  FROM part"""


def fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_fenced(table(spark, sf_dir, "documents"))


def as_fenced(documents: DataFrame) -> DataFrame:
    """Whole document texts inside and around code fences, and the output of a run on them."""
    text, kind = F.col("text"), F.pmod("doc_id", F.lit(6))
    shapes = [
        F.concat(F.lit("Intro\n```python\n"), text, F.lit("\n```\nend")),
        F.concat(F.lit("```\n"), text, F.lit("\n```")),
        F.concat(F.lit("```python\n"), text),
        F.concat(F.lit("```python\n  \n```\n"), text, F.lit("```js\nx\n```")),
        F.concat(F.lit("```js\n"), text, F.lit("\n```\n```python3\nprint(1)\n```")),
    ]
    wrapped = text
    for i, shape in enumerate(shapes):
        wrapped = F.when(kind == i, shape).otherwise(wrapped)
    run = F.pmod("doc_id", F.lit(5))
    return documents.select(
        "doc_id",
        wrapped.alias("text"),
        F.when(run == 0, "__ALL_PASSED__\n")
        .when(run == 3, text)
        .when(run == 4, F.concat(text, F.lit("__ALL_PASSED__")))
        .otherwise("")
        .alias("stdout"),
        F.when(run == 3, F.col("lang")).otherwise("").alias("stderr"),
        (run == 1).alias("timed_out"),
        F.when(run == 2, text).alias("launch_error"),
    )


SQL["fenced"] = """
  SELECT doc_id,
         CASE doc_id % 6
           WHEN 0 THEN 'Intro' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'end'
           WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```'
           WHEN 2 THEN '```python' || chr(10) || text
           WHEN 3 THEN '```python' || chr(10) || '  ' || chr(10) || '```' || chr(10) || text || '```js' || chr(10)
                       || 'x' || chr(10) || '```'
           WHEN 4 THEN '```js' || chr(10) || text || chr(10) || '```' || chr(10) || '```python3' || chr(10)
                       || 'print(1)' || chr(10) || '```'
           ELSE text END AS text,
         CASE doc_id % 5 WHEN 0 THEN '__ALL_PASSED__' || chr(10) WHEN 3 THEN text
                         WHEN 4 THEN text || '__ALL_PASSED__' ELSE '' END AS stdout,
         CASE WHEN doc_id % 5 = 3 THEN lang ELSE '' END AS stderr,
         doc_id % 5 = 1 AS timed_out,
         CASE WHEN doc_id % 5 = 2 THEN text END AS launch_error
  FROM documents"""


# -- tokens and scores -------------------------------------------------------


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tokens of their order, with log-probs of two policies."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq_id"),
        (-(F.col("l_discount") * 2 + F.col("l_tax"))).alias("lp"),
        (-(F.col("l_tax") * 2 + F.col("l_discount"))).alias("lp_old"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("mask"),
    )


SQL["token_rows"] = """
  SELECT l_orderkey AS seq_id, -(l_discount * 2 + l_tax) AS lp, -(l_tax * 2 + l_discount) AS lp_old,
         CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS mask
  FROM lineitem"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as completions: priority is the step, customer the prompt, status the reward."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq_id"),
        F.col("o_orderpriority").alias("step"),
        F.col("o_custkey").alias("prompt_id"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("reward"),
    )


SQL["sequences"] = """
  SELECT o_orderkey AS seq_id, o_orderpriority AS step, o_custkey AS prompt_id,
         CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward
  FROM orders"""


def id_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of whole documents, one per word: of uneven length, 1 to some thousands."""
    words = F.filter(F.split("text", "[ \\n\\t\\r\\f]+", -1), lambda w: w != "")
    ids = F.transform(words, lambda w: F.pmod(F.length(w) * 31 + F.ascii(w), F.lit(97)))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq_id"),
        int_div(F.col("doc_id"), 8).cast("int").alias("batch_no"),
        ids.alias("ids"),
        F.pmod("doc_id", F.lit(40)).cast("int").alias("prompt_len"),
    )


SQL["id_rows"] = """
  SELECT doc_id AS seq_id, (doc_id // 8)::INTEGER AS batch_no,
         list_transform(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r\\f]+'), lambda w: w <> ''),
                        lambda w: ((length(w) * 31 + ord(w)) % 97)::INTEGER) AS ids,
         (doc_id % 40)::INTEGER AS prompt_len
  FROM documents"""


def array_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences as arrays: log-probs of two policies and a mask, a reward and a group."""
    e = table(spark, sf_dir, "embeddings")
    negative = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    old = e.select((F.col("vec_id") - 1).alias("vec_id"), negative.alias("lp_old"))
    size, start = F.size("embedding"), F.col("label")
    mask = F.concat(F.array_repeat(F.lit(0), start), F.array_repeat(F.lit(1), size - start))
    return e.join(old, "vec_id").select(
        F.col("vec_id").alias("seq_id"),
        F.pmod("label", F.lit(3)).alias("step"),
        F.col("label").alias("group_id"),
        F.when(F.get("embedding", F.lit(0)) > 0, 1.0).otherwise(0.0).alias("reward"),
        negative.alias("lp"),
        "lp_old",
        mask.alias("mask"),
    )


SQL["array_rows"] = """
  SELECT e.vec_id AS seq_id, e.label % 3 AS step, e.label AS group_id,
         CASE WHEN e.embedding[1] > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward,
         list_transform(e.embedding, lambda x: -abs(x::DOUBLE)) AS lp,
         list_transform(o.embedding, lambda x: -abs(x::DOUBLE)) AS lp_old,
         list_transform(range(len(e.embedding)), lambda i: CASE WHEN i >= e.label THEN 1 ELSE 0 END) AS mask
  FROM embeddings e JOIN embeddings o ON o.vec_id = e.vec_id + 1"""


def logit_rows(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Embeddings as score vectors of 16-token sequences; ``shift`` takes a later vector instead."""
    at = F.col("vec_id") - shift
    return table(spark, sf_dir, "embeddings").filter(at >= 0).select(
        int_div(at, 16).cast("int").alias("seq_id"),
        F.pmod(at, F.lit(16)).cast("int").alias("pos"),
        F.when(F.col("label") >= 3, 1).otherwise(0).alias("mask"),
        F.col("embedding").alias("logits"),
    )


SQL["logit_rows"] = """
  SELECT vec_id, (vec_id // 16)::INTEGER AS seq_id, (vec_id % 16)::INTEGER AS pos,
         CASE WHEN label >= 3 THEN 1 ELSE 0 END AS mask, embedding AS logits
  FROM embeddings"""
SQL["scores"] = """
  SELECT vec_id, seq_id, pos, mask, i - 1 AS item, logits[i]::DOUBLE AS x
  FROM (SELECT *, unnest(range(1, len(logits) + 1)) AS i FROM logit_rows)"""
NEEDS["scores"] = ("logit_rows",)
SQL["lse"] = """
  SELECT vec_id, ln(sum(exp(x - top))) + any_value(top) AS lse
  FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS top FROM scores) GROUP BY vec_id"""
NEEDS["lse"] = ("scores",)
SQL["distill_rows"] = """
  SELECT s.vec_id, any_value(s.seq_id) AS seq_id, any_value(s.pos) AS pos, any_value(s.mask) AS mask,
         sum(exp(t.x - lt.lse) * ((t.x - lt.lse) - (s.x - ls.lse))) AS kl,
         -sum(exp(t.x - lt.lse) * (t.x - lt.lse)) AS entropy,
         count(*) AS items
  FROM scores s JOIN scores t ON t.vec_id = s.vec_id + 1 AND t.item = s.item
       JOIN lse ls ON ls.vec_id = s.vec_id JOIN lse lt ON lt.vec_id = s.vec_id + 1
  GROUP BY s.vec_id"""
NEEDS["distill_rows"] = ("scores", "lse")


# -- step metrics ------------------------------------------------------------


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metrics: one run per user, steps in event order, several rounds per day."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").cast("int").alias("step"),
        F.dayofmonth("ts").alias("day"),
        (1 + F.pmod("event_id", F.lit(8))).cast("int").alias("T"),
        (v / 100).alias("loss"),
        (v / 300).alias("grpo_loss"),
        (v / 150).alias("sdpo_loss"),
        (v / 500).alias("reward_mean"),
        (v / 250).alias("rho"),
        F.pmod("event_id", F.lit(5)).cast("int").alias("n_correct"),
        (4 - F.pmod("event_id", F.lit(5))).cast("int").alias("n_failed"),
        v.alias("seconds"),
    )


SQL["metric_rows"] = """
  SELECT user_id AS run_id, event_id::INTEGER AS step, day(ts)::INTEGER AS day, (1 + event_id % 8)::INTEGER AS T,
         value / 100 AS loss, value / 300 AS grpo_loss, value / 150 AS sdpo_loss, value / 500 AS reward_mean,
         value / 250 AS rho, (event_id % 5)::INTEGER AS n_correct, (4 - event_id % 5)::INTEGER AS n_failed,
         value AS seconds
  FROM events"""
