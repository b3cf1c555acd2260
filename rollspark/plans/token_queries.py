"""Queries over token arrays and score vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.functions import tokens as T
from rollspark.functions import vocab
from rollspark.functions.determinism import int_div, uniform
from rollspark.operators import scoring as S
from rollspark.operators.selection import compare_tables
from rollspark.plans import views as V
from rollspark.plans.ingest_queries import uniform_sql
from rollspark.plans.registry import query


@query(
    "d1_truncate_prompt",
    V.with_views("id_rows", body="SELECT seq_id, array_to_string(ids[1:20], ',') AS ids FROM id_rows"),
)
def d1(spark, sf_dir):
    return V.id_rows(spark, sf_dir).select("seq_id", V.to_text(T.truncate_prompt(F.col("ids"), 20)).alias("ids"))


EOS_SQL = V.with_views(
    "id_rows",
    body="""
  SELECT seq_id, prompt_len, CASE WHEN p > 0 THEN ids[1:prompt_len + p] ELSE ids END AS ids, p
  FROM (SELECT *, coalesce(list_position(ids[prompt_len + 1:], 3), 0) AS p FROM id_rows)""",
)


def _cut(spark, sf_dir):
    ids = T.cut_at_eos(F.col("ids"), F.col("prompt_len"), 3)
    return V.id_rows(spark, sf_dir).withColumn("ids", ids)


@query("d2_eos_cut", f"SELECT seq_id, array_to_string(ids, ',') AS ids FROM ({EOS_SQL})")
def d2(spark, sf_dir):
    return _cut(spark, sf_dir).select("seq_id", V.to_text(F.col("ids")).alias("ids"))


@query(
    "d3_response_mask",
    f"""SELECT seq_id, array_to_string(list_transform(range(len(ids)),
          lambda i: CASE WHEN i >= prompt_len THEN 1 ELSE 0 END), ',') AS mask FROM ({EOS_SQL})""",
)
def d3(spark, sf_dir):
    mask = T.response_mask(F.size("ids"), F.col("prompt_len"))
    return _cut(spark, sf_dir).select("seq_id", V.to_text(mask).alias("mask"))


@query(
    "d4_align_logprobs",
    f"""SELECT seq_id, n_kept, round(total, 6) + 0.0 AS total
  FROM (SELECT seq_id, greatest(least(len(ids) - prompt_len, len(x)), 0) AS n_kept,
               coalesce(list_sum(x[1:greatest(len(ids) - prompt_len, 0)]), 0) AS total
        FROM ({EOS_SQL}) c
        JOIN (SELECT vec_id, list_transform(embedding, lambda v: -abs(v::DOUBLE)) AS x FROM embeddings) e
          ON e.vec_id = c.seq_id)""",
)
def d4(spark, sf_dir):
    lp = V.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("seq_id"), F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("token_lp")
    )
    kept = T.align_logprobs(F.col("token_lp"), F.size("ids"), F.col("prompt_len"))
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return (
        _cut(spark, sf_dir)
        .join(lp, "seq_id")
        .select("seq_id", F.size(kept).cast("long").alias("n_kept"), V.r6(total).alias("total"))
    )


@query(
    "d5_training_window",
    V.with_views(
        "id_rows",
        body="""
  SELECT seq_id, array_to_string(ids[greatest(len(ids) - 16, 0) + 1:], ',') AS ids,
         greatest(prompt_len - greatest(len(ids) - 16, 0), 0)::INTEGER AS prompt_len
  FROM id_rows""",
    ),
)
def d5(spark, sf_dir):
    ids, prompt_len = T.training_window(F.col("ids"), F.col("prompt_len"), 16)
    return V.id_rows(spark, sf_dir).select("seq_id", V.to_text(ids).alias("ids"), prompt_len.alias("prompt_len"))


def _mask_rows(spark, sf_dir):
    mask = F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0))
    whole = F.transform("embedding", lambda x: F.lit(1))
    return V.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("seq_id"), F.when(F.col("label") < 3, whole).otherwise(mask).alias("mask")
    )


MASK_SQL = """
  SELECT vec_id AS seq_id, list_transform(embedding,
           lambda x: CASE WHEN label < 3 OR x > 0 THEN 1 ELSE 0 END) AS mask FROM embeddings"""


@query(
    "d6_mask_positions",
    f"""
  SELECT seq_id, pos::INTEGER AS pos, CASE WHEN m = 0 THEN 0
         ELSE sum(m) OVER (PARTITION BY seq_id ORDER BY pos) - 1 END::INTEGER AS position
  FROM (SELECT seq_id, unnest(mask) AS m, unnest(range(len(mask))) AS pos FROM ({MASK_SQL}))""",
)
def d6(spark, sf_dir):
    rows = _mask_rows(spark, sf_dir)
    return rows.select("seq_id", F.posexplode(T.mask_positions("mask")).alias("pos", "position"))


@query(
    "d7_padding_check",
    f"SELECT seq_id, list_sum(mask) = len(mask) AS unpadded FROM ({MASK_SQL})",
)
def d7(spark, sf_dir):
    return _mask_rows(spark, sf_dir).select("seq_id", T.is_unpadded(F.col("mask")).alias("unpadded"))


@query(
    "d8_taken_logprobs",
    V.with_views(
        "scores",
        "lse",
        body="""
  , tokens AS (SELECT vec_id, seq_id, pos, (vec_id * 7) % len(logits) AS id, seq_id % 5 AS prompt_len FROM logit_rows)
  SELECT t.seq_id, t.pos, t.id, CASE WHEN t.pos >= greatest(t.prompt_len, 1)
         THEN round(s.x - l.lse, 6) + 0.0 ELSE 0.0 END AS lp
  FROM tokens t LEFT JOIN scores s ON s.seq_id = t.seq_id AND s.pos = t.pos - 1 AND s.item = t.id
       LEFT JOIN lse l ON l.vec_id = s.vec_id""",
    ),
)
def d8(spark, sf_dir):
    logits = V.logit_rows(spark, sf_dir)
    tokens = V.table(spark, sf_dir, "embeddings").select(
        int_div(F.col("vec_id"), 16).cast("int").alias("seq_id"),
        F.pmod("vec_id", F.lit(16)).cast("int").alias("pos"),
        F.pmod(F.col("vec_id") * 7, F.size("embedding")).cast("long").alias("id"),
        F.pmod(int_div(F.col("vec_id"), 16), F.lit(5)).cast("int").alias("prompt_len"),
    )
    return S.taken_logprobs(tokens, logits).select("seq_id", "pos", "id", V.r6("lp").alias("lp"))


@query(
    "f10_softmax",
    V.with_views(
        "scores",
        "lse",
        body="""
  SELECT seq_id, pos, item::INTEGER AS item, round(exp(x - lse), 6) + 0.0 AS prob, round(x - lse, 6) + 0.0 AS logprob
  FROM scores JOIN lse USING (vec_id)""",
    ),
)
def f10(spark, sf_dir):
    rows = V.logit_rows(spark, sf_dir).select(
        "seq_id", "pos", vocab.softmax("logits").alias("p"), vocab.log_softmax("logits").alias("lp")
    )
    items = rows.select("seq_id", "pos", F.posexplode(F.arrays_zip("p", "lp")).alias("item", "v"))
    return items.select("seq_id", "pos", "item", V.r6("v.p").alias("prob"), V.r6("v.lp").alias("logprob"))


def _pairs(spark, sf_dir):
    return S.pair_logits(V.logit_rows(spark, sf_dir), V.logit_rows(spark, sf_dir, shift=1))


@query(
    "f11_token_kl",
    V.with_views("distill_rows", body="SELECT seq_id, pos, round(kl, 6) + 0.0 AS kl FROM distill_rows WHERE mask > 0"),
)
def f11(spark, sf_dir):
    scored = S.distill_positions(_pairs(spark, sf_dir).filter("mask > 0"))
    return scored.select("seq_id", "pos", V.r6("kl").alias("kl"))


@query(
    "f11_token_kl_student_teacher",
    V.with_views(
        "scores",
        "lse",
        body="""
  SELECT any_value(s.seq_id) AS seq_id, any_value(s.pos) AS pos,
         round(sum(exp(s.x - ls.lse) * ((s.x - ls.lse) - (t.x - lt.lse))), 6) + 0.0 AS kl
  FROM scores s JOIN scores t ON t.vec_id = s.vec_id + 1 AND t.item = s.item
       JOIN lse ls ON ls.vec_id = s.vec_id JOIN lse lt ON lt.vec_id = s.vec_id + 1
  WHERE s.mask > 0 GROUP BY s.vec_id""",
    ),
)
def f11_reverse(spark, sf_dir):
    scored = S.distill_positions(_pairs(spark, sf_dir).filter("mask > 0"), direction="student_teacher")
    return scored.select("seq_id", "pos", V.r6("kl").alias("kl"))


@query(
    "f12_teacher_entropy",
    V.with_views(
        "distill_rows", body="SELECT seq_id, pos, round(entropy, 6) + 0.0 AS entropy FROM distill_rows WHERE mask > 0"
    ),
)
def f12(spark, sf_dir):
    scored = S.distill_positions(_pairs(spark, sf_dir).filter("mask > 0"))
    return scored.select("seq_id", "pos", V.r6("entropy").alias("entropy"))


@query(
    "f13_entropy_weight",
    V.with_views(
        "distill_rows",
        body="""SELECT seq_id, pos, round(1 - 0.01 * entropy / ln(items), 6) + 0.0 AS weight
  FROM distill_rows WHERE mask > 0""",
    ),
)
def f13(spark, sf_dir):
    scored = S.distill_positions(_pairs(spark, sf_dir).filter("mask > 0"))
    return scored.select("seq_id", "pos", V.r6("weight").alias("weight"))


DISTILL_SQL = """
  SELECT seq_id, coalesce(avg(CASE WHEN mask > 0 THEN kl * (1 - 0.01 * entropy / ln(items)) END), 0.0) AS sdpo_loss
  FROM distill_rows GROUP BY seq_id"""


@query(
    "f14_distill_loss",
    V.with_views(
        "distill_rows",
        body=f"""SELECT seq_id, CASE WHEN seq_id % 7 = 3 AND active > 0 THEN 'NaN'::DOUBLE
                               ELSE round(sdpo_loss, 6) + 0.0 END AS sdpo_loss
                 FROM ({DISTILL_SQL}) JOIN (SELECT seq_id, sum(mask) AS active FROM distill_rows GROUP BY seq_id)
                 USING (seq_id)""",
    ),
)
def f14(spark, sf_dir):
    # The student's scores of some sequences are broken.
    student, teacher = V.logit_rows(spark, sf_dir), V.logit_rows(spark, sf_dir, shift=1)
    broken = F.when(F.pmod("seq_id", F.lit(7)) == 3, F.transform("logits", lambda x: x + F.lit(float("nan")).cast("float")))
    student = student.withColumn("logits", F.coalesce(broken, F.col("logits")))
    loss = S.step_distill_loss(student, teacher, ["seq_id"])
    return loss.select("seq_id", V.r6("sdpo_loss").alias("sdpo_loss"))


@query(
    "f15_combine_means",
    """SELECT user_id AS step, CASE WHEN sum(event_id % 5) > 0
              THEN round(sum(value * (event_id % 5)) / sum(event_id % 5), 6) + 0.0 ELSE 0.0 END AS sdpo_loss
       FROM events GROUP BY user_id""",
)
def f15(spark, sf_dir):
    chunks = V.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("step"),
        F.when(F.pmod("event_id", F.lit(5)) > 0, F.col("value")).alias("mean"),
        F.pmod("event_id", F.lit(5)).alias("n"),
    )
    return S.combine_means(chunks, ["step"]).select("step", V.r6("sdpo_loss").alias("sdpo_loss"))


@query(
    "f16_response_total",
    V.with_views(
        "id_rows",
        body="""SELECT batch_no, greatest(sum(greatest(len(ids) - greatest(prompt_len, 1), 0)), 1)::BIGINT
                       AS response_tokens FROM id_rows GROUP BY batch_no""",
    ),
)
def f16(spark, sf_dir):
    return S.response_total(V.id_rows(spark, sf_dir), ["batch_no"], F.size("ids"), F.col("prompt_len"))


@query(
    "f20_soft_cap",
    V.with_views(
        "scores", body="SELECT seq_id, pos, item::INTEGER AS item, round(0.3 * tanh(x / 0.3), 6) + 0.0 AS x FROM scores"
    ),
)
def f20(spark, sf_dir):
    capped = vocab.soft_cap(F.col("logits").cast("array<double>"), 0.3)
    rows = V.logit_rows(spark, sf_dir).select("seq_id", "pos", F.posexplode(capped).alias("item", "x"))
    return rows.select("seq_id", "pos", "item", V.r6("x").alias("x"))


@query(
    "f21_compare_logits",
    V.with_views(
        "scores",
        body="""
  , positions AS (
    SELECT s.vec_id, any_value(s.seq_id) AS seq_id, any_value(s.pos) AS pos, max(abs(s.x - t.x)) AS max_abs,
           sum(abs(s.x - t.x)) AS sum_abs, count(*) AS items,
           arg_max(s.item, (s.x, -s.item)) = arg_max(t.item, (t.x, -t.item)) AS same,
           bool_or(isnan(s.x) OR isnan(t.x)) AS has_nan, min(s.x) AS low, max(s.x) AS high
    FROM scores s JOIN scores t ON t.vec_id = s.vec_id + 1 AND t.item = s.item GROUP BY s.vec_id)
  SELECT seq_id, round(max(max_abs), 6) AS max_abs, round(sum(sum_abs) / sum(items), 6) AS mean_abs,
         arg_max(same, pos) AS same_top, bool_or(has_nan) AS has_nan,
         round(min(low), 6) + 0.0 AS low, round(max(high), 6) + 0.0 AS high
  FROM positions GROUP BY seq_id""",
    ),
)
def f21(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).select(
        "seq_id", "pos", vocab.compare_scores("logits", "teacher_logits").alias("cmp")
    )
    numbers = ("max_abs", "mean_abs", "low", "high")
    return compare_tables(pairs, ["seq_id"]).select(
        "seq_id", "same_top", "has_nan", *[V.r6(n).alias(n) for n in numbers]
    )


# Scores in steps of 0.1, so that many are tied.
COARSE_SQL = V.with_views(
    "scores",
    body="""
  , coarse AS (SELECT vec_id, item, floor(x * 10) / 10 AS x FROM scores),
  ranked AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS place,
                    ln(sum(exp(x)) OVER (PARTITION BY vec_id)) AS lse FROM coarse),
  kept AS (SELECT vec_id, item, x - lse AS logprob,
                  exp(x / 1.2) / sum(exp(x / 1.2)) OVER (PARTITION BY vec_id) AS prob FROM ranked WHERE place <= 10)""",
)


def _coarse(spark, sf_dir):
    coarse = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10) / 10)
    return V.table(spark, sf_dir, "embeddings").select("vec_id", coarse.alias("logits"))


@query(
    "g6_topk_ties",
    COARSE_SQL + "\n  SELECT vec_id, item::INTEGER AS item, round(prob, 6) AS prob FROM kept",
)
def g6(spark, sf_dir):
    kept = _coarse(spark, sf_dir).select("vec_id", F.inline(vocab.top_k_items(F.col("logits"), 1.2, 10)))
    return kept.select("vec_id", "item", V.r6("prob").alias("prob"))


@query(
    "g7_raw_logprob",
    COARSE_SQL + "\n  SELECT vec_id, item::INTEGER AS item, round(logprob, 6) + 0.0 AS logprob FROM kept",
)
def g7(spark, sf_dir):
    kept = _coarse(spark, sf_dir).select("vec_id", F.inline(vocab.top_k_items(F.col("logits"), 1.2, 10)))
    return kept.select("vec_id", "item", V.r6("logprob").alias("logprob"))


@query(
    "g8_weighted_draw",
    COARSE_SQL
    + f"""
  SELECT vec_id, coalesce(min(CASE WHEN cum > u THEN item END), max(item))::INTEGER AS item,
         round(coalesce(arg_min(logprob, CASE WHEN cum > u THEN item END), arg_max(logprob, item)), 6) + 0.0 AS logprob
  FROM (SELECT *, sum(prob) OVER (PARTITION BY vec_id ORDER BY item) AS cum, {uniform_sql("vec_id")} AS u FROM kept)
  GROUP BY vec_id""",
)
def g8(spark, sf_dir):
    drawn = vocab.draw_item(F.col("logits"), uniform(42, F.col("vec_id")), 1.2, 10)
    rows = _coarse(spark, sf_dir).select("vec_id", drawn.alias("d"))
    return rows.select("vec_id", "d.item", V.r6("d.logprob").alias("logprob"))


@query(
    "j4_pair_policies",
    """SELECT user_id AS seq_id, event_id AS pos, -value / 100 AS lp, -(value + user_id % 7) / 100 AS lp_old
       FROM events""",
)
def j4(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    keys = [F.col("user_id").alias("seq_id"), F.col("event_id").alias("pos")]
    current = events.select(*keys, (-F.col("value") / 100).alias("lp"))
    old = events.select(*keys, (-(F.col("value") + F.pmod("user_id", F.lit(7))) / 100).alias("lp"))
    return S.pair_policies(current, old)


@query(
    "j5_pair_logits",
    V.with_views(
        "scores",
        body="""
  SELECT any_value(s.seq_id) AS seq_id, any_value(s.pos) AS pos, round(sum(s.x * t.x), 6) + 0.0 AS dot
  FROM scores s JOIN scores t ON t.vec_id = s.vec_id + 1 AND t.item = s.item GROUP BY s.vec_id""",
    ),
)
def j5(spark, sf_dir):
    products = F.zip_with("logits", "teacher_logits", lambda a, b: a.cast("double") * b.cast("double"))
    dot = F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
    return _pairs(spark, sf_dir).select("seq_id", "pos", V.r6(dot).alias("dot"))
