"""One-permutation MinHash, exact vector codes, the trie of conversations."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rollspark.llm import codes, minhash, prefixes


# -- 11 ----------------------------------------------------------------------


def test_sets_are_given_out_some_at_a_time():
    some = [f"{i} " * (1 + i % 7) for i in range(1000)]
    for made, texts in ((minhash._sets(4), some), (minhash._signatures(4, True), [*some, "", None])):
        parts = list(made.func(iter([pa.array(texts), pa.array(texts[:3])])))
        assert max(map(len, parts)) <= 256
        whole = [x for part in parts for x in part.to_pylist()]
        alone = [next(made.func(iter([pa.array([t], pa.string())]))).to_pylist()[0] for t in texts]
        assert whole == alone + alone[:3]


def brute_groups(texts, width=4, percent=80):
    """Number of shingles of each text and the least place that links lead to."""
    sets = []
    for text in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(len(words) - width, 0) + 1)} if words else set())
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if root[i] != root[j] and a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return [len(s) for s in sets], root


def near_texts():
    rng = random.Random(5)
    texts = ["", None, " \t\x0b ", "one", "ONE", "one two three", "one  two\x0cthree", "one two three four", "one two three five"]
    for _ in range(10):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 9, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(7):
            base = list(base) if rng.random() < 0.5 else texts[-1].split()
            base[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(base))
    passage = [f"p{i}" for i in range(60)]
    # Texts that share a passage of half their length and more, but are no near copies of one another.
    texts += [" ".join([*passage, *[f"q{i}.{j}" for j in range(10 + i % 50)]]) for i in range(120)]
    line = [f"l{i}" for i in range(200)]
    texts += [" ".join([*line[:-2], f"e{i}", "end"]) for i in range(100)]  # all near one another
    texts += [texts[-1]] * 20 + ["É kept " + texts[-1], "é kept " + texts[-1]]
    return texts


@pytest.mark.parametrize(("few", "block", "printed"), [(256, 1024, 1024), (0, 16, 30)])
def test_groups_are_those_of_brute_force(spark, monkeypatch, few, block, printed):
    monkeypatch.setattr(minhash, "FEW", few)  # 0: as many turns as there may be
    monkeypatch.setattr(minhash, "PRINTED", printed)
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_texts()
    sizes, root = brute_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (sizes[i], root[i], root[i] == i)
    assert 20 < len(set(root)) < len(texts) - 80


def test_densification_fills_every_bin_evenly():
    bins = minhash.Bins()
    assert (np.sort(bins.order, axis=1) == np.arange(bins.n)).all()
    assert set(bins.values(np.array([3 << 60], np.uint64)).tolist()) == {0}
    for size in (1, 2, 30, 70, 200, 900):  # the short way finds what the order says
        shingles = np.unique(np.random.default_rng(size).integers(0, 1 << 64, size, np.uint64))
        values = bins.values(shingles)
        own = {int(b): int(v) for b, v in sorted(zip(((shingles >> np.uint64(32)) * np.uint64(bins.n)) >> np.uint64(32), shingles & np.uint64(0xFFFFFFFF)), key=lambda x: -int(x[1]))}
        for i in range(bins.n):
            assert values[i] == (own[i] if i in own else next(own[j] for j in bins.order[i].tolist() if j in own))
    rng = np.random.default_rng(1)
    shingles = np.unique(rng.integers(0, 1 << 64, 6, np.uint64))
    counts = Counter(bins.values(shingles).tolist())
    assert set(counts) == set(shingles.astype(np.uint32).tolist()) and min(counts.values()) > 40


@pytest.mark.parametrize("size", [5, 10, 40, 200, 1000, 4000])
def test_agreement_of_bins_estimates_similarity(size):
    rng = np.random.default_rng(size)
    bins, agree, equal = minhash.Bins(), [], []
    for _ in range(300):
        union = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
        part = np.sort(rng.permutation(union)[: size * 4 // 5])
        agree.append((bins.values(union) == bins.values(part)).mean())
        one, two = (np.frombuffer(minhash.sketch(x, bins), np.uint8) for x in (union, part))
        equal.append((one == two).sum())
    assert np.mean(agree) == pytest.approx(0.8, abs=0.01)
    assert min(equal) >= (minhash.least_agreement(80) if size * 4 // 5 >= minhash.SMALL else bins.n // 2)  # no pair of this similarity is dropped


def test_minhash_of_odd_rows(spark, odd_docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    assert sorted(g for g in got if g[0] in (1, 2)) == [(1, 9, 1, True), (1, 9, 1, True), (2, 9, 1, False)]
    assert [g[1:] for g in got if g[0] == 4] == [(0, 4, True)] and [g[1:] for g in got if g[0] == 3] == [(0, 3, True)]
    assert [g[1:] for g in got if g[0] is None] == [(5, None, False)] * 2
    assert minhash.near_duplicates(odd_docs.limit(0)).count() == 0


# -- 12 ----------------------------------------------------------------------


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """By Python integers. ``rows`` are (key, vector of integers) in order of their keys."""
    length = len(rows[0][1])
    cuts = codes.bounds(length, parts)
    out = [["", 0] for _ in rows]
    books = []
    for p in range(parts):
        own = [v[cuts[p] : cuts[p + 1]] for _, v in rows]
        book = [list(v) for v in own[:entries]]
        for turn in range(rounds + 1):
            found = [min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book)) for v in own]
            if turn < rounds:
                for i in range(len(book)):
                    mine = [v for v, (_, at) in zip(own, found) if at == i]
                    if mine:
                        book[i] = [sum(c) // len(mine) for c in zip(*mine)]
        for o, (apart, at) in zip(out, found):
            o[0] += f"{at:02x}"
            o[1] += apart
        books += [str(x) for e in book for x in e]
    return out, hashlib.sha256(",".join(books).encode()).hexdigest()


@pytest.mark.parametrize(("scale", "length"), [(1.0, 8), (9000.0, 10), (0.01, 3)])
def test_codes_are_those_of_whole_numbers(spark, scale, length):
    rng = random.Random(length)
    rows = [(i, [rng.gauss(0, scale) for _ in range(length)]) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(30)]  # ties
    expected, digest = brute_codes([(k, [int(np.floor(1024 * x)) for x in v]) for k, v in rows])
    df = spark.createDataFrame([(k, v, k % 3 if k % 7 else None) for k, v in rows], "vec_id long, embedding array<double>, label int").repartition(4)
    got = sorted(codes.compress(df).collect())
    assert [(r["code"], r["error"]) for r in got] == [tuple(e) for e in expected]
    assert {r["codebooks_sha256"] for r in got} == {digest}
    sums = Counter()
    for (k, _), (_, error) in zip(rows, expected):
        sums[k % 3 if k % 7 else None] += error
    assert [r["label_error"] for r in got] == [sums[k % 3 if k % 7 else None] for k, _ in rows]


@pytest.mark.parametrize("bits", [8, 20, 24, 25, 27])
def test_limb_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    top = min(1 << bits, codes.greatest(16))
    a, b = rng.integers(-top + 1, top, (50, 16)), rng.integers(-top + 1, top, (9, 16))
    a[0], b[0] = top - 1, -top + 1
    exact = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
    assert codes.dots(a, b).tolist() == exact
    places, apart = codes.nearest(a, b)
    for i, r in enumerate(a):
        assert (int(apart[i]), int(places[i])) == min((sum((int(x) - int(y)) ** 2 for x, y in zip(r, c)), j) for j, c in enumerate(b))


def test_a_sum_of_limb_products_stays_below_the_bound():
    for length in (1, 16, 64, 4096):
        assert length * ((1 << codes.limb_bits(length)) - 1) ** 2 < 1 << 53
        assert length * (2 * codes.greatest(length)) ** 2 < 1 << 63


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (3, [1.0, 2.0, 3.0, 4.0], "a"), (1, [0.0, 0.0, 0.0, 0.0], None), (1, [0.0, 0.0, 0.0, -0.5], "a"), (None, [1.0, 2.0, 3.0, 4.0], "a"),
        (4, None, "a"), (5, [1.0, None, 2.0, 3.0], "a"), (6, [1.0, nan, 2.0, 3.0], "a"), (7, [inf, 1.0, 2.0, 3.0], "a"),
        (8, [1.0], "b"), (9, [1e30, 0.0, 0.0, 0.0], "b"), (10, [], "b"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for name in ("code", "error", "_key", "_v", "_label"):
        df = df.selectExpr("*", f"label as `{name}`")
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in codes.compress(df).collect()]
    # Rows of key 1 come first, the lesser vector before the other, whose first three parts are equal: the first entry wins.
    expected = [
        (1, "00000000", 0, 0), (1, "00000001", 0, 0), (3, "02020202", 0, 0), (None, "02020202", 0, 0),
        (8, None, None, None), (9, None, None, None), (10, None, None, None),
    ]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert codes.compress(df.limit(0)).count() == 0
    assert codes.compress(df.filter("vec_id = 4")).count() == 0
    assert [r["code"] for r in codes.compress(df.filter("vec_id = 10")).collect()] == ["00000000"]
    assert [r["code"] for r in codes.compress(df.filter("vec_id is null")).collect()] == [None]  # nothing starts a codebook


# -- 13 ----------------------------------------------------------------------


def brute_trie(rows):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(turns)] for c, turns in talks.items()}
    members, ends = {}, {}
    for c, turns in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = talks.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        path = tuple(base[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = []
    for node, own in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = sum(not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in members) for m in below)
        saved = sum((len(members[m]) - 1) * (len(m[-1][1]) if m else 0) for m in below)
        joined = ",".join(map(str, sorted(ends.get(node, []))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), len(children), leaves, saved, hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=str)


def talk_rows(seed, convs, longest, kinds):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(rng.randrange(longest + 1)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), "é" * rng.randrange(kinds)))
    return rows


TALK = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("band", "longest"), [(3, 30), (16, 6)])
def test_trie_is_that_of_brute_force(spark, monkeypatch, band, longest):
    monkeypatch.setattr(prefixes, "BAND", band)
    monkeypatch.setattr(prefixes, "BLOCK", band**3)
    monkeypatch.setattr(prefixes, "PIECE_BITS", 5)
    rows = talk_rows(band, [0, 1, 2, 3, 5, 8, 99, 100, 101, 102, 199, 207, 350, -7, -150, *range(1000, 1040)], longest, 2)
    rows += [(c, t, "user", "same") for c in range(2000, 2020) for t in range(longest)]
    got = prefixes.trie(spark.createDataFrame(rows, TALK).repartition(4))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (0, None, "system", "null first"), (0, 2, None, "c"), (0, 1, "user", None), (0, 2, None, "c"), (1, 7, "user", "x"), (2, None, None, None),
        (None, 0, "user", "no conversation"), (401, 0, "user", "y" * 300_000), (402, 0, "user", "y" * 300_000), (403, 5, "user", "short"),
    ]
    df = spark.createDataFrame(rows, TALK)
    for name in ("id", "depth", "pos", "_h", "_len", "chars", "chain"):
        df = df.selectExpr("*", f"conv_id as `{name}`")
    assert sorted(map(tuple, prefixes.trie(df).collect()), key=str) == brute_trie(rows)
    assert prefixes.trie(df.limit(0)).count() == 0
    # Conversations may lose all their turns; they still belong to the root.
    rows = [(c, 0, "user", "gone") for c in range(401, 420)]
    assert sorted(map(tuple, prefixes.trie(spark.createDataFrame(rows, TALK)).collect()), key=str) == brute_trie(rows)


def test_ties_of_a_turn_have_one_order(spark):
    rows = [(c, 0, "user", f"t{i}") for c in (500, 501) for i in range(5)]
    first = sorted(map(tuple, prefixes.trie(spark.createDataFrame(rows, TALK)).collect()), key=str)
    again = sorted(map(tuple, prefixes.trie(spark.createDataFrame(rows[::-1], TALK).repartition(5)).collect()), key=str)
    assert first == again
