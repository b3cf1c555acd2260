"""Queries over problem sets, batches and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.operators import batching
from rollspark.operators.ordering import StoredOrder, seeded_head
from rollspark.plans import views as V
from rollspark.plans.registry import query
from rollspark.session import fresh_dir
from rollspark.sources import problems as P


def by_hash(key: str, seed: str = "42") -> str:
    return f"md5('{seed}:' || {key}), {key}"


def uniform_sql(key: str, seed: str = "42") -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::UBIGINT)::DOUBLE / 4503599627370496"


PROBLEM_COLUMNS = "problem_id, source, prompt, test, entry"
MIXED_KEY = "source || ':' || problem_id"


@query("a1_mbpp_problems", V.with_views("mbpp", body=f"SELECT {PROBLEM_COLUMNS} FROM mbpp"))
def a1(spark, sf_dir):
    return P.normalize_mbpp(V.mbpp_rows(spark, sf_dir))


@query("a2_humaneval_problems", V.with_views("humaneval", body=f"SELECT {PROBLEM_COLUMNS} FROM humaneval"))
def a2(spark, sf_dir):
    return P.normalize_humaneval(V.function_rows(spark, sf_dir))


@query(
    "a2_humaneval_missing_keys",
    """SELECT item_id::VARCHAR AS problem_id, 'humaneval' AS source, text AS prompt, '' AS test, 'solution' AS entry
       FROM benchmark""",
)
def a2_missing(spark, sf_dir):
    return P.normalize_humaneval(V.bare_rows(spark, sf_dir))


def mix_sql(n: int) -> str:
    quota = max(1, n * 8 // 10)
    return V.with_views(
        "humaneval",
        "mbpp",
        body=f"""
  SELECT {PROBLEM_COLUMNS}, position FROM (
    SELECT *, row_number() OVER (ORDER BY md5('42:' || {MIXED_KEY}), source, problem_id) - 1 AS position FROM (
      SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || {MIXED_KEY}), problem_id) AS rn FROM humaneval)
      WHERE rn <= {quota}
      UNION ALL
      SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || {MIXED_KEY}), problem_id) AS rn FROM mbpp)
      WHERE rn <= {n} - least({quota}, (SELECT count(*) FROM humaneval))))
  WHERE position < {n}""",
    )


@query("a3_weighted_mix", mix_sql(500))
def a3(spark, sf_dir):
    return P.weighted_mix(
        P.normalize_humaneval(V.function_rows(spark, sf_dir)), P.normalize_mbpp(V.mbpp_rows(spark, sf_dir)), 500, 42
    )


@query("a3_weighted_mix_short_source", mix_sql(2000))
def a3_short(spark, sf_dir):
    return P.weighted_mix(
        P.normalize_humaneval(V.function_rows(spark, sf_dir)), P.normalize_mbpp(V.mbpp_rows(spark, sf_dir)), 2000, 42
    )


@query(
    "a4_plain_problems",
    V.with_views(
        "function_rows",
        body="SELECT problem_id, 'bigcodebench' AS source, prompt, test, entry_point AS entry FROM function_rows",
    ),
)
def a4(spark, sf_dir):
    return P.normalize_plain(V.function_rows(spark, sf_dir))


POOL_SQL = V.with_views(
    "pool",
    body=f"""
  SELECT d.draw_no, p.* EXCLUDE (place)
  FROM (SELECT range AS draw_no, floor({uniform_sql("range")} * (SELECT count(*) FROM pool))::BIGINT AS place
        FROM range((SELECT count(*) FROM documents))) d
  JOIN (SELECT *, row_number() OVER (ORDER BY {by_hash("problem_id")}) - 1 AS place FROM pool) p ON p.place = d.place""",
)


def _pool(spark, sf_dir):
    return P.normalize_plain(V.bare_rows(spark, sf_dir), "builtin")


@query("a5_pool_sample", POOL_SQL)
def a5(spark, sf_dir):
    n = V.table(spark, sf_dir, "documents").count()
    return P.sample_pool(_pool(spark, sf_dir), n, 42)


@query(
    "a6_dispatch",
    V.with_views(
        "mbpp",
        body=f"""SELECT {PROBLEM_COLUMNS}, row_number() OVER (ORDER BY md5('42:' || {MIXED_KEY}), problem_id) - 1 AS position
  FROM mbpp QUALIFY position < 500""",
    ),
)
def a6(spark, sf_dir):
    return P.load_problems(spark, "mbpp", {"mbpp": V.mbpp_rows(spark, sf_dir)})


@query("a6_dispatch_fallback", POOL_SQL)
def a6_fallback(spark, sf_dir):
    n = V.table(spark, sf_dir, "documents").count()
    return P.load_problems(spark, "misspelled", {"builtin": _pool(spark, sf_dir)}, n, on_error="fallback")


@query("a6_broken_source_fallback", POOL_SQL)
def a6_broken(spark, sf_dir):
    """Some rows have no assertion in their first test, which shows only when they are read."""
    n = V.table(spark, sf_dir, "documents").count()
    rows = V.mbpp_rows(spark, sf_dir)
    without = F.when(F.col("problem_id").cast("int") % 50 == 7, F.array(F.lit("print(1)"))).otherwise(F.col("test_list"))
    return P.load_problems(spark, "mbpp", {"mbpp": rows.withColumn("test_list", without), "builtin": _pool(spark, sf_dir)}, n, on_error="fallback")


@query(
    "a8_seeded_head",
    f"""SELECT doc_id, text, row_number() OVER (ORDER BY {by_hash("doc_id")}) - 1 AS position
        FROM documents QUALIFY position < 500""",
)
def a8(spark, sf_dir):
    return seeded_head(V.table(spark, sf_dir, "documents").select("doc_id", "text"), 500, "doc_id", 42)


@query("a9_problem_count", "SELECT count(*) AS n_problems FROM documents")
def a9(spark, sf_dir):
    return P.problem_count(V.function_rows(spark, sf_dir))


@query(
    "a9_problem_at",
    f"""SELECT doc_id, text, row_number() OVER (ORDER BY {by_hash("doc_id")}) - 1 AS position
        FROM documents QUALIFY position = (SELECT count(*) FROM documents) - 1""",
)
def a9_last(spark, sf_dir):
    return P.problem_at(V.table(spark, sf_dir, "documents").select("doc_id", "text"), -1, 42, "doc_id")


@query(
    "a9_stored_problems",
    f"""SELECT doc_id, text, row_number() OVER (ORDER BY {by_hash("doc_id")}) - 1 AS position
        FROM documents QUALIFY position IN (0, 77, (SELECT count(*) FROM documents) // 2, (SELECT count(*) FROM documents) - 1)""",
)
def a9_stored(spark, sf_dir):
    """Four rows of a stored order, of which only their blocks are read."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    order = StoredOrder.write(docs, "doc_id", 42, fresh_dir(spark, "order"), block_rows=256)
    again = StoredOrder.open(spark, order.path)
    return again.at(0, 77, again.size // 2, -1)


@query(
    "a10_reshuffle",
    f"SELECT doc_id, lang, row_number() OVER (ORDER BY {by_hash('doc_id', '42:again')}) - 1 AS position FROM documents",
)
def a10(spark, sf_dir):
    return P.reshuffle(V.table(spark, sf_dir, "documents").select("doc_id", "lang"), 42, "again", "doc_id")


@query(
    "c1_micro_batches",
    f"""SELECT doc_id, lang, (rn - 1) // 2 AS batch_no, ((rn - 1) % 2)::INTEGER AS batch_idx
        FROM (SELECT *, row_number() OVER (ORDER BY {by_hash("doc_id")}) AS rn FROM documents)""",
)
def c1(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return batching.micro_batches(docs, 2, 42, "doc_id")


def epoch_sql(rank: int) -> str:
    seed = 42 + rank
    return f"""
  WITH size AS (SELECT count(*) AS n, (count(*) + 1) // 2 AS batches FROM documents),
  copies AS (SELECT doc_id, epoch, batches FROM documents, size,
             (SELECT unnest(range(0, (4000 + batches - 1) // batches)) AS epoch FROM size)),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY epoch
                ORDER BY md5('{seed}:' || epoch || ':' || doc_id), doc_id) - 1 AS place FROM copies)
  SELECT doc_id, epoch::INTEGER AS epoch, ((epoch * batches + place // 2) // 4)::INTEGER AS step,
         ((epoch * batches + place // 2) % 4)::INTEGER AS acc, place // 2 AS batch_no, (place % 2)::INTEGER AS batch_idx
  FROM ordered WHERE epoch * batches + place // 2 < 4000"""


def _schedule(spark, sf_dir, rank):
    docs = V.table(spark, sf_dir, "documents").select("doc_id")
    return batching.epoch_schedule(docs, batch_size=2, steps=1000, accumulation=4, seed=42, rank=rank, key="doc_id")


@query("c2_epoch_schedule", epoch_sql(0))
def c2(spark, sf_dir):
    return _schedule(spark, sf_dir, 0)


@query("c2_epoch_schedule_rank1", epoch_sql(1))
def c2_rank(spark, sf_dir):
    return _schedule(spark, sf_dir, 1)


@query(
    "c1_stored_batches",
    f"""SELECT doc_id, lang, (rn - 1) // 8 AS batch_no, ((rn - 1) % 8)::INTEGER AS batch_idx
        FROM (SELECT *, row_number() OVER (ORDER BY {by_hash("doc_id")}) AS rn FROM documents)""",
)
def c1_stored(spark, sf_dir):
    """All batches of a stored order, in two reads."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "lang")
    order = StoredOrder.write(docs, "doc_id", 42, fresh_dir(spark, "order"), block_rows=100)
    return order.batches(8, 0, 15).unionByName(order.batches(8, 15))


@query(
    "c3_fan_out",
    "SELECT doc_id, text, g::INTEGER AS completion_idx FROM documents, (SELECT unnest(range(4)) AS g)",
)
def c3(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    return batching.fan_out(docs, 4)


@query(
    "c4_pad_batch",
    V.with_views(
        "id_rows",
        body="""
  SELECT seq_id, batch_no, longest AS padded_len,
         array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda i: 7)), ',') AS ids,
         array_to_string(list_transform(range(longest), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ',')
           AS attention_mask,
         array_to_string(list_transform(range(longest), lambda i:
           CASE WHEN i >= greatest(prompt_len, 1) AND i < len(ids) THEN 1 ELSE 0 END), ',') AS loss_mask
  FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch_no)::INTEGER AS longest FROM id_rows)""",
    ),
)
def c4(spark, sf_dir):
    padded = batching.pad_batch(V.id_rows(spark, sf_dir), ["batch_no"], pad_id=7)
    arrays = [V.to_text(F.col(c)).alias(c) for c in ("ids", "attention_mask", "loss_mask")]
    return padded.select("seq_id", "batch_no", "padded_len", *arrays)


def depth_case(u: str) -> str:
    law = batching.DepthLaw()
    cases = " ".join(f"WHEN {u} < {bound!r} THEN {max(law.least, k)}" for k, bound in enumerate(law.thresholds()))
    return f"(CASE {cases} ELSE {law.most} END)::INTEGER"


DEPTH_SQL = f"""
  SELECT step, {depth_case("u")} AS T, greatest(1, ceil({depth_case("u")} * 0.5))::INTEGER AS T_bwd
  FROM (SELECT event_id AS step, {uniform_sql("event_id")} AS u FROM events)"""


@query("g9_depth", DEPTH_SQL)
def g9(spark, sf_dir):
    depth, backward = batching.sample_depth(F.col("step"))
    steps = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("step"))
    return steps.select("step", depth.alias("T"), backward.alias("T_bwd"))
