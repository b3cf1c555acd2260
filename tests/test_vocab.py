import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollspark.functions import ragged
from rollspark.functions import vocab as V
from rollspark.functions.determinism import uniform

rng = np.random.default_rng(3)
# Rows of different sizes, so that ragged batches are covered too.
ROWS = [list(map(float, rng.normal(size=n).round(1))) for n in (7, 7, 3, 1, 12, 7)]


def log_softmax(x):
    top = max(x)
    lse = top + math.log(sum(math.exp(v - top) for v in x))
    return [v - lse for v in x]


@pytest.mark.parametrize("piece", [1, 7, 15, 1 << 21])
def test_pieces_cover_all_rows(monkeypatch, piece):
    monkeypatch.setattr(ragged, "PIECE", piece)
    for rows in (ROWS, [r for r in ROWS if len(r) == 7]):
        column = ragged.Ragged(pa.array([None, *rows, []], pa.list_(pa.float32())))
        got = {int(i): list(m[j]) for chosen, m in column.matrices() for j, i in enumerate(chosen)}
        assert got == {i + 1: list(np.float32(r)) for i, r in enumerate(rows)}


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(i, x, ROWS[-1 - i] if len(ROWS[-1 - i]) == len(x) else x[::-1]) for i, x in enumerate(ROWS)]
    return spark.createDataFrame(rows, "i int, a array<double>, b array<double>").coalesce(1)


def test_softmax(scores):
    for r in scores.select("a", V.softmax("a").alias("p"), V.log_softmax("a").alias("lp")).collect():
        assert r["lp"] == pytest.approx(log_softmax(r["a"]))
        assert r["p"] == pytest.approx([math.exp(v) for v in log_softmax(r["a"])])


def test_item_logprob(scores):
    for r in scores.select("a", "i", V.item_logprob("a", "i").alias("lp")).collect():
        expected = log_softmax(r["a"])[r["i"]] if r["i"] < len(r["a"]) else None
        assert r["lp"] == (None if expected is None else pytest.approx(expected))


def test_null_and_empty_rows(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [1.0, 1.0])], "i int, a array<double>").coalesce(1)
    got = df.orderBy("i").select(
        V.softmax("a").alias("p"), V.item_logprob("a", F.lit(0)).alias("lp"), V.distill_terms("a", "a").alias("t")
    )
    rows = got.collect()
    assert [r["p"] for r in rows] == [None, [], [0.5, 0.5]]
    assert [r["lp"] for r in rows] == [None, None, pytest.approx(-math.log(2))]
    assert [r["t"]["kl"] for r in rows] == [None, None, 0.0]


def test_divergence_and_entropy(scores):
    got = scores.select(
        "a", "b", V.distill_terms("a", "b").alias("t"), V.distill_terms("a", "b", "student_teacher").alias("r")
    )
    for r in got.collect():
        s, t = log_softmax(r["a"]), log_softmax(r["b"])
        assert r["t"]["kl"] == pytest.approx(sum(math.exp(q) * (q - p) for p, q in zip(s, t)), abs=1e-12)
        assert r["r"]["kl"] == pytest.approx(sum(math.exp(p) * (p - q) for p, q in zip(s, t)), abs=1e-12)
        assert r["t"]["entropy"] == pytest.approx(-sum(math.exp(q) * q for q in t), abs=1e-12)
        assert r["t"]["kl"] >= -1e-12
        assert r["t"]["items"] == len(r["a"])


def test_divergence_ignores_impossible_items(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.0, float("-inf")])], "s array<double>, t array<double>")
    terms = df.select(V.distill_terms("s", "t").alias("t")).first()["t"]
    assert terms["kl"] == pytest.approx(math.log(2))
    assert terms["entropy"] == 0.0


def test_vectors_of_different_size_are_an_error(spark):
    df = spark.createDataFrame([([0.0], [0.0, 1.0])], "s array<double>, t array<double>")
    with pytest.raises(Exception, match="same size"):
        df.select(V.distill_terms("s", "t")).collect()


def test_entropy_weight(one):
    value = one("h double, n int", math.log(4), 4)
    assert value(V.entropy_weight(F.col("h"), F.col("n"), 0.01)) == pytest.approx(0.99)
    assert one("h double, n int", 0.0, 1)(V.entropy_weight(F.col("h"), F.col("n"), 0.01)) == 1.0


def test_soft_cap(one):
    value = one("x array<double>", [0.0, 1.0, -100.0])
    assert value(V.soft_cap(F.col("x"), 2.0)) == pytest.approx([0.0, 2 * math.tanh(0.5), -2.0])
    assert value(V.soft_cap(F.col("x"), None)) == [0.0, 1.0, -100.0]


def kept_items(x, temperature, k):
    scaled = [v / temperature for v in x]
    limit = sorted(scaled, reverse=True)[k - 1] if 0 < k <= len(x) else -math.inf
    kept = [i for i, v in enumerate(scaled) if v >= limit]
    return dict(zip(kept, [math.exp(v) for v in log_softmax([scaled[i] for i in kept])]))


@pytest.mark.parametrize("k", [0, 1, 3, 7, 50])
def test_top_k_keeps_ties_and_raw_logprobs(scores, k):
    for r in scores.select("a", V.top_k_items(F.col("a"), 1.2, k).alias("kept")).collect():
        expected = kept_items(r["a"], 1.2, k)
        assert [x["item"] for x in r["kept"]] == list(expected)
        assert [x["prob"] for x in r["kept"]] == pytest.approx(list(expected.values()))
        assert [x["logprob"] for x in r["kept"]] == pytest.approx([log_softmax(r["a"])[i] for i in expected])


def test_tie_at_the_threshold(one):
    kept = one("x array<double>", [1.0, 2.0, 1.0, 0.0])(V.top_k_items(F.col("x"), 1.0, 2))
    assert [x["item"] for x in kept] == [0, 1, 2]


def test_draw_follows_running_probability(spark):
    rows = [(i, [random.Random(i).random() for _ in range(9)]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    u = uniform(7, F.col("i"))
    for r in df.select("x", u.alias("u"), V.draw_item(F.col("x"), u, 0.7, 4).alias("d")).collect():
        total, picked = 0.0, None
        for item, p in kept_items(r["x"], 0.7, 4).items():
            total += p
            if picked is None and total > r["u"]:
                picked = item
        assert r["d"]["item"] == picked
        assert r["d"]["logprob"] == pytest.approx(log_softmax(r["x"])[picked])


def test_draw_falls_back_to_the_last_kept_item(one):
    drawn = one("x array<double>, u double", [5.0, 4.0, -9.0], 1.0)(V.draw_item(F.col("x"), F.col("u"), 1.0, 2))
    assert drawn["item"] == 1


def test_compare_scores(spark):
    rows = [(0, 0, [1.0, 3.0, 3.0], [1.0, 2.0, 2.5]), (0, 1, [1.0, 2.0], [1.5, 2.0]), (1, 0, [math.nan], [0.0])]
    df = spark.createDataFrame(rows, "prompt int, pos int, a array<double>, b array<double>")
    from rollspark.operators.selection import compare_tables

    pairs = df.withColumn("cmp", V.compare_scores("a", "b"))
    first, second = compare_tables(pairs, ["prompt"]).orderBy("prompt").collect()
    assert (first["max_abs"], first["mean_abs"]) == (1.0, pytest.approx(2.0 / 5))
    assert first["same_top"] and not first["has_nan"]
    assert (first["low"], first["high"]) == (1.0, 3.0)
    assert second["has_nan"]


def test_vectors_with_nan_have_no_order(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, [1.0, nan, 2.0]), (1, [1.0, 0.0, 2.0])], "i int, x array<double>")
    rows = df.select("i", V.top_k_items(F.col("x"), 1.0, 2).alias("kept"), V.draw_item(F.col("x"), F.lit(0.5), 1.0, 2).alias("d"))
    got = {r["i"]: r for r in rows.collect()}
    assert got[0]["kept"] is None and got[0]["d"] is None
    assert [k["item"] for k in got[1]["kept"]] == [0, 2] and got[1]["d"]["item"] == 2


def test_capped_log_softmax(spark):
    df = spark.createDataFrame([([1.0, -3.0, 2.0],), ([],), (None,)], "x array<double>")
    both = df.select(V.soft_capped_log_softmax(F.col("x"), 2.0).alias("a"), V.log_softmax(V.soft_cap(F.col("x"), 2.0)).alias("b"))
    for r in both.collect():
        assert r["a"] == r["b"] or r["a"] == pytest.approx(r["b"])


def test_infinite_scores(spark):
    inf = float("inf")
    rows = [(0, [inf, 0.0, 1.0]), (1, [-inf, -inf]), (2, [-inf, 0.0, -inf, 0.0]), (3, [inf, -inf])]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    for k in (0, 1, 2):
        got = {r["i"]: r for r in df.select("i", V.top_k_items(F.col("x"), 1.0, k).alias("top"), V.draw_item(F.col("x"), F.lit(0.7), 1.0, k).alias("draw")).collect()}
        assert all(got[i]["top"] is None and got[i]["draw"] is None for i in (0, 1, 3))
        assert [(t["item"], round(t["prob"], 6)) for t in got[2]["top"]] == [(1, 0.5), (3, 0.5)]
        assert got[2]["draw"]["item"] == 3 and got[2]["draw"]["logprob"] == pytest.approx(math.log(0.5))
