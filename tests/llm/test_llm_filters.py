"""Language, quality, language-model scores, decontamination."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollspark.llm import decontam, langid, lm, quality, queries
from rollspark.llm.common import load, remainder


def brute_length(train, text):
    """PPM by dictionaries, byte by byte."""
    counts = [Counter() for _ in range(langid.ORDER + 1)]
    pad = bytes(langid.ORDER)
    for t in train:
        data = pad + t.encode()
        for i in range(langid.ORDER, len(data)):
            for k in range(langid.ORDER + 1):
                counts[k][data[i - k : i], data[i]] += 1
    bits, data = 0.0, pad + text.encode()
    for i in range(langid.ORDER, len(data)):
        for k in range(langid.ORDER, -1, -1):
            seen = {s: n for (c, s), n in counts[k].items() if c == data[i - k : i]}
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits += math.log2(whole / seen[data[i]])
                break
            if seen:
                bits += math.log2(whole / len(seen))
        else:
            bits += 8
    return bits


def trees_of(spark, rows):
    df = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(rows)], "doc_id long, text string, lang string")
    return langid.train(df, F.lit(True))


def test_code_lengths_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    a, b = [make(["th", "e", "ing"], 30) for _ in range(3)], [make(["der", "ü", "sch"], 30) for _ in range(3)]
    trees = trees_of(spark, [(t, "a") for t in a] + [(t, "b") for t in b])
    texts = ["the thing", "übersch", "", "zzz\x00\x00", "x" * 300, make(["th", "sch", "q"], 40)]
    for block in (langid.BLOCK, 7, 64):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = trees.lengths(texts)
        for i, text in enumerate(texts):
            assert got[i] == pytest.approx([brute_length(a, text), brute_length(b, text)], rel=1e-5, abs=1e-4)


def test_index():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    index = langid.Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(rng.integers(0, 1 << 40, 5000).astype(np.uint64), keys)
    assert (index.find(others) == -1).all()
    assert (langid.Index(keys[:0]).find(others) == -1).all()


def test_language_of_odd_texts(spark, odd_docs):
    trees = langid.train(odd_docs, F.lit(True))
    assert trees.languages == ["de", "en", "ja"]
    rows = langid.identify(odd_docs, trees).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        lettered = r["text"] is not None and langid.LETTER.search(r["text"])
        assert (r["language"]["lang"] == "und") == (not lettered) and 0 <= r["language"]["score"] <= 1
        if lettered and r["lang"]:
            assert r["language"]["lang"] == r["lang"]
    kept = langid.keep_known(odd_docs, trees)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({3, 4, 5, 8})
    nothing = langid.train(odd_docs.limit(0), F.lit(True))
    assert {r["language"]["lang"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
    assert langid.identify(odd_docs.limit(0), trees).count() == 0


def test_sample_of_languages_is_bounded(spark, odd_docs):
    trees = langid.train(odd_docs.filter("lang = 'en'"), F.lit(True), per_language=1)
    assert trees.languages == ["en"]


def test_held_out_languages(spark, sf_dir):
    got = queries.language_id(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").collect()
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95


def test_languages_whose_rows_share_a_key_are_learnt(spark):
    """One key on a whole language, and on a third of all rows; identical rows by the thousand; one text of 50 MB."""
    rng = random.Random(3)
    word = lambda parts: "".join(rng.choice(parts) for _ in range(3))
    text = lambda parts, n=12: " ".join(word(parts) for _ in range(n))
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["qu", "ux", "zy"], "dd": ["vv", "hh", "jj"]}
    rows = [(7, text(parts["aa"]), "aa") for _ in range(3000)]  # all of one key
    rows += [(i if i % 3 else 7, text(parts["bb"]), "bb") for i in range(3000)]
    rows += [(9, "qu ux", "cc")] * 4000 + [(i, text(parts["cc"]), "cc") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.unionAll(spark.range(1).selectExpr("id", "repeat('vvhhjj jjvvhh ', 3500000) AS text", "'dd' AS lang")).repartition(8)
    for bound in (20, 400):
        sample = langid.sampled(df, F.lit(True), "doc_id", "text", "lang", bound)
        counts = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
        assert counts == {"aa": bound, "bb": bound, "cc": min(bound, 51), "dd": 1}
    trees = langid.train(df, F.lit(True), per_language=60)
    assert trees.languages == sorted(parts)
    names, _, _ = trees.judge([text(p, 30) for p in parts.values()])
    assert names == list(parts)


# -- quality -----------------------------------------------------------------


def test_passages():
    texts = [b"", b"a b " * 100, b"  x", b"Und Und Und"]
    features, first = quality.passages(texts)
    assert first.tolist() == [0, 1, 5, 6] and len(features) == 7
    assert not features[0].any()
    assert features[6][-4] == pytest.approx(2 / 3) and features[6][-3] == pytest.approx(1 / 3)
    assert features[1][-3] == pytest.approx(2 / 64)
    alone, _ = quality.passages([b"Und Und Und"])
    assert np.allclose(alone[0], features[6])


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model = quality.AttentionModel()
    model.weights = {k: rng.normal(0, 0.4, v.shape) for k, v in model.weights.items()}
    first, y = np.array([0, 3, 4, 9]), np.array([1.0, 0.0, 0.0, 1.0])
    x = rng.normal(0, 1, (11, quality.FEATURES)) * (rng.random(quality.FEATURES) < 0.05)
    for name, gradient in model.gradient(x, first, y).items():
        w = model.weights[name]
        assert gradient.shape == w.shape
        places = list(zip(*np.unravel_index(rng.choice(w.size, min(w.size, 25), replace=False), w.shape)))
        places += list(zip(*np.nonzero(np.abs(gradient) == np.abs(gradient).max())))[:1]
        for place in places:
            old, step, sides = w[place], 1e-5, []
            for sign in (1, -1):
                w[place] = old + sign * step
                sides.append(model.loss(x, first, y))
            w[place] = old
            assert gradient[place] == pytest.approx((sides[0] - sides[1]) / (2 * step), rel=1e-4, abs=1e-8)


def test_attention_pools_as_by_hand():
    texts = ["good words here " * 60, "", "BAD!! x# x# x# " * 30, "one"]
    model = quality.AttentionModel()
    model.fit(texts, np.array([1, 0, 0, 1]), epochs=20)
    w, scores = model.weights, []
    for text in texts:
        features, _ = quality.passages([text.encode()])
        top = under = 0.0
        for f in (features - model.mean) / model.scale:
            code = np.tanh(f @ w["encode"] + w["encode_0"])
            weight = np.exp((np.tanh(code @ w["gate_t"]) / (1 + np.exp(-(code @ w["gate_s"])))) @ w["attend"])
            top, under = top + weight * code, under + weight
        scores.append(1 / (1 + np.exp(-((top / under) @ w["score"] + w["score_0"][0]))))
    assert model.probability(texts) == pytest.approx(scores, rel=1e-4)


def test_long_documents_teach_by_passages_spread_over_them(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    part = quality.spread(long).split()
    assert len(part) == quality.SPREAD * quality.WORDS and part[0] == "w0" and int(part[-1][1:]) > 99_900
    assert quality.spread("short  text") == "short  text" and quality.spread(None) is None
    docs = spark.createDataFrame([(1, "x " * 25_000_000), (2, "good words here"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    assert quality.train(docs, labels, F.lit(True)).fitted


def test_held_out_quality(spark, sf_dir):
    got = queries.quality_scores(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id")
    rows = got.collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.9


def test_quality_of_odd_texts(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 0), (7, None), (None, 1), (99, 0)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels, F.lit(True))
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["quality_score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["quality_score"]) == pytest.approx(r["quality_score"])
    kept = quality.keep_good(odd_docs, model, threshold=0.0)
    assert kept.columns == odd_docs.columns and kept.count() == len(rows)
    unfit = quality.train(odd_docs, labels.limit(0), F.lit(True))
    assert {r["quality_score"] for r in quality.score(odd_docs, unfit).collect()} == {0.5}
    assert quality.score(odd_docs.limit(0), model).count() == 0


# -- language model ----------------------------------------------------------


def test_base_scores_equal_brute_force(spark, odd_docs):
    learn = F.col("doc_id").isNull() | (F.col("doc_id") < 7)
    model, vocabulary = lm.train(odd_docs, learn)
    rows = lm.score(odd_docs, model, vocabulary).select("record.doc_id", "record.lang", "*").collect()
    assert len(rows) == odd_docs.count()
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter()
    texts = odd_docs.select("doc_id", "text").collect()
    for r in texts:
        if r["doc_id"] is None or r["doc_id"] < 7:
            counts.update(tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (len(w := tokens(r["text"])), sum(x in counts for x in w), sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        for r in texts
    )
    got = sorted((r["n_tokens"], r["n_known"], r["base_score"]) for r in rows)
    for g, e in zip(got, expected):
        assert g[:2] == e[:2] and g[2] == pytest.approx(e[2])
    assert {r["train_tokens"] for r in rows} == {n} and all(r["score"] < 0 for r in rows)


def test_probabilities_add_up(spark):
    rows = [(i, "a b c a b d", ) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, _ = lm.train(df, F.lit(True))
    tokens, begins = lm.tokens_of([b"a b c"])
    _, hashes, _ = model.lexicon.look_up(tokens)
    given = np.exp(lm.log_softmax(model.weights, lm.features(hashes, begins)))
    assert given.sum(axis=1) == pytest.approx(1)
    # Within a class: its words and one unseen word.
    for c in range(lm.CLASSES + 1):
        own = (model.lexicon.counts + 0.5)[model.lexicon.classes == c].sum() + 0.5
        assert own == pytest.approx(model.mass[c])


def test_model_beats_single_words(spark, sf_dir):
    rows = queries.lm_scores(spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    crc = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    assert all(r["held_out"] == crc(r["doc_id"]) for r in rows)


def test_model_of_nothing(spark, odd_docs):
    model, vocabulary = lm.train(odd_docs.limit(0), F.lit(True))
    rows = lm.score(odd_docs, model, vocabulary).collect()
    assert len(rows) == odd_docs.count() and {r["n_known"] for r in rows} == {0}
    assert lm.score(odd_docs.limit(0), model, vocabulary).count() == 0


# -- decontamination ---------------------------------------------------------


def brute_contained(docs, items, width=5, threshold=0.8):
    words_of = lambda text: (text or "").encode().lower().split()
    cut = lambda words, n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    by_key = {}
    for k, t in docs:
        by_key.setdefault(k, []).append(words_of(t))
    for (k, texts), (i, t) in itertools.product(by_key.items(), items):
        n = min(len(words_of(t)), width)
        own = cut(words_of(t), n) if n else set()
        have = set().union(*[cut(words, n) for words in texts])
        if own and len(own & have) >= threshold * len(own) - 1e-9:
            yield k, i, len(own & have), len(own)


@pytest.mark.parametrize("few", [True, False])
def test_containment_equals_brute_force(spark, odd_docs, monkeypatch, few):
    if not few:
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 7, 8, 9, 15, 16, 31, 40])]
    docs = [(None, None), (50, ""), (51, items[0][1]), (52, items[2][1].upper())]
    for n in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(300))]
        for i, t in rng.sample(items, 2):
            part = t.split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((n, " ".join(text)))
    items += [(90, None), (91, " "), (None, items[9][1]), (92, items[9][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_item", F.lit(3)).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("_key", F.lit(1))
    got = sorted(map(str, (tuple(r)[:4] for r in decontam.contaminated(df, bench).collect())))
    expected = sorted(map(str, brute_contained(docs, items)))
    assert got == expected and len(got) > 60
    # The item of two words stands inside long documents too.
    assert sum(i == 1 for _, i, _, _ in brute_contained(docs, items)) > 3
    clean = decontam.keep_clean(df, bench)
    assert clean.columns == df.columns
    held = {e[0] for e in brute_contained(docs, items)}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(k) for k, _ in docs if k not in held)


def test_nothing_to_look_for(spark, odd_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(odd_docs, bench).count() == 0
    assert decontam.keep_clean(odd_docs, bench).count() == odd_docs.count()
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog.")], "item_id long, text string")
    got = decontam.contaminated(odd_docs, items).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2]
    assert decontam.contaminated(odd_docs.limit(0), items).count() == 0


def test_signatures_reach_the_size_they_need():
    for n in range(1, 500):
        upper = 2 ** (int(math.log2(n + 0.5)) + 1) - 1
        k = upper - math.ceil(upper * 0.8 - 1e-9) + 1
        assert k >= n - math.ceil(n * 0.8 - 1e-9) + 1


def test_remainders(spark):
    rows = spark.createDataFrame([(17,), (None,)], "doc_id long").select("doc_id", remainder("doc_id", 5).alias("r")).collect()
    assert [r["r"] for r in rows] == [zlib.crc32(b"17") % 5, 0]


def test_texts_are_judged_in_little_memory():
    """What a worker holds at once beside its texts does not grow with them."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 1 << 16))) for _ in range(24)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y"] * 2), pa.array(texts[:4])], names=["lang", "text"])
    rows = pa.Table.from_batches(langid._count(iter([batch]))).to_pandas().groupby(["lang", "k"])
    trees = langid.Trees({at: (own["gram"].to_numpy().astype(np.uint64), own["n"].to_numpy()) for at, own in rows})
    tracemalloc.start()
    try:
        trees.judge(texts)
        assert tracemalloc.get_traced_memory()[1] < 20e6
        print("peak", tracemalloc.get_traced_memory()[1])
    finally:
        tracemalloc.stop()
