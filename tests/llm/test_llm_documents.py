"""Sharding, near-duplicates, sketches, archives, and the pipeline."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from rollspark.llm import alike, common, minhash, queries, sharding, simhash, sketch, warc

# -- sharding ----------------------------------------------------------------


@pytest.mark.parametrize("shards,bucket_bytes", [(5, 1 << 25), (7, 300), (40, 1000)])
def test_shards_are_even_and_gapless(spark, shards, bucket_bytes):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit(9).alias("shard"))
    got = sharding.shard(rows, shards, bucket_bytes=bucket_bytes).select("shard", "slot", "record.doc_id", "record.shard").collect()
    slots = {}
    for r in got:
        slots.setdefault(r[0], []).append(r["slot"])
    assert sorted(r["doc_id"] for r in got) == list(range(1000))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == shards and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(rows.repartition(6), shards, bucket_bytes=bucket_bytes).select("shard", "slot", "record.doc_id", "record.shard")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r[0], r["slot"]))]
    assert abs(np.corrcoef(order, range(1000))[0, 1]) < 0.15


def test_shards_of_odd_rows(spark, odd_docs):
    got = sharding.shard(odd_docs, 4, bucket_bytes=500)
    assert sorted(map(str, got.select("record.*").collect())) == sorted(map(str, odd_docs.collect()))
    assert sharding.shard(odd_docs.limit(0), 4).count() == 0
    assert sharding.shard(odd_docs, 40).select("shard").distinct().count() == odd_docs.count()


@pytest.mark.parametrize("key,text", [("7L", "concat('text ', id)"), ("cast(null as long)", "'the same'"), ("id", "'x'")])
def test_hot_records_are_scattered(spark, key, text):
    """One key, or one null key and text, on all rows; wide extra columns count. No bucket, here a file per shard, takes much more than its share."""
    rows = spark.range(4000).selectExpr(f"{key} as doc_id", f"{text} as text", "repeat('w', 200) as wide").repartition(4)
    path = sharding.fresh_dir(spark, "hot")
    got = sharding.shard(rows, 1, bucket_bytes=40_000, path=path)
    assert sorted(r["slot"] for r in got.select("slot").collect()) == list(range(4000))
    assert got.select("record.*").exceptAll(rows).count() == 0
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 20 and max(sizes) < 400


def test_shard_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.sharded(spark, sf_dir).collect()}
    for d in common.load(spark, sf_dir, "documents").collect():
        r = rows[d["doc_id"]]
        assert r["size"] == len(d["text"].encode()) + 16 and r["text_crc32"] == zlib.crc32(d["text"].encode())
        assert r["law"] == "rows" and r["grown_shard"] is None


# -- near-duplicates ---------------------------------------------------------


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def clusters(rng, groups, size, steps):
    """Fingerprints in chains and clouds around random centres."""
    out = set()
    for _ in range(groups):
        own = [rng.getrandbits(64)]
        for _ in range(rng.randrange(1, size)):
            x = own[rng.randrange(len(own))] if rng.random() < 0.5 else own[-1]
            for _ in range(rng.randrange(steps) + 1):
                x ^= 1 << rng.randrange(64)
            own.append(x)
        out.update(own)
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_walk_joins_what_links_join():
    rng = random.Random(5)
    for size in (2, 30, 400):
        members = clusters(rng, 4, size, 5)
        edges = simhash.walk(np.array(members, np.uint64), simhash.reference_fingerprints())
        assert all((members[a] ^ members[b]).bit_count() <= 3 for a, b in edges)
        expected = brute_components(members, lambda a, b: (a ^ b).bit_count() <= 3)
        pairs = {(members[a], members[b]) for a, b in edges}
        got = brute_components(members, lambda a, b: (a, b) in pairs or (b, a) in pairs)
        assert got == expected and len(edges) == len(members) - len(set(expected.values()))


def test_links_lose_nothing(spark):
    rng = random.Random(6)
    members = clusters(rng, 60, 12, 4) + clusters(rng, 1, 300, 2)
    df = spark.createDataFrame([(signed(m),) for m in set(members)], "fingerprint long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(df)).collect()}
    expected = brute_components([signed(m) for m in set(members)], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert {n: found.get(n, n) for n in expected} == expected


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert {got.get(i, i) for i in range(201)} == {0} and got.get(501) == 500
    assert simhash.components(edges.limit(0)).count() == 0


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_of_odd_rows(spark, odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    for r in odd_docs.collect():
        if r["doc_id"] is not None:
            assert prints[r["doc_id"]] == signed(brute_fingerprint(r["text"]))
    of = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == odd_docs.count() and of[2] == of[1] == 1 and of[3] == of[4] == of[5] == 3 and of[None] is None
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 6, 7, None, 8, 9]))
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0 and simhash.keep_one(odd_docs.limit(0)).count() == 0


def test_fingerprint_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(400))
    whole = simhash.fingerprint_of([text])
    monkeypatch.setattr(simhash, "GROUP", 16)
    assert simhash.fingerprint_of([text]) == whole == brute_fingerprint(text)


def test_simhash_query_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: int(brute_fingerprint(r["text"])) for r in common.load(spark, sf_dir, "documents").collect()}
    expected = brute_components(docs, lambda a, b: (docs[a] ^ docs[b]).bit_count() <= 3)
    for r in queries.simhash_groups(spark, sf_dir).collect():
        assert int(r["fingerprint"], 16) == docs[r["doc_id"]] and len(r["fingerprint"]) == 16
        assert r["component_id"] == expected[r["doc_id"]]


# -- sketches ----------------------------------------------------------------


def test_differences_are_recovered():
    rng = np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    left, right = [], []
    for shared, a, b in [(0, 0, 0), (100, 0, 0), (50, 3, 1), (0, 300, 500), (2000, 40, 0), (0, 1, 0)]:
        both = draw(shared)
        left.append(np.concatenate([both, draw(a)]))
        right.append(np.concatenate([draw(b), both]))
    lost, gained = sketch.differences(left, right)
    for a, b, x, y in zip(left, right, lost, gained):
        assert set(x.tolist()) == set(a.tolist()) - set(b.tolist()) and set(y.tolist()) == set(b.tolist()) - set(a.tolist())
    assert sketch.differences([], []) == ([], [])


def test_paragraphs_are_distinct_and_local():
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)) + "\nsame\nsame\n\n"
    digests = sketch.paragraphs(text)
    assert len(set(digests.tolist())) == len(digests)
    other = sketch.paragraphs(text.replace("w3x4 ", "other "))
    assert len(set(digests.tolist()) ^ set(other.tolist())) <= 6
    assert sketch.sketches_of([digests])[0] == sketch.sketches_of([digests[::-1]])[0]
    assert len(sketch.paragraphs(None)) == len(sketch.paragraphs(" \n")) == 0


@pytest.mark.parametrize("partition_bytes", [1 << 25, 200])
def test_versions_of_odd_rows(spark, odd_docs, partition_bytes):
    rows = sketch.versions(odd_docs, partition_bytes=partition_bytes).collect()
    assert len(rows) == odd_docs.count()
    docs = odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    docs.sort(key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    expected = []
    for d, n in zip(docs, docs[1:] + docs[:1]):
        k = len(d["text"]) // 3
        edited = d["text"][: len(d["text"]) - k] + n["text"][:k]
        a, e, f = (set(sketch.paragraphs(t).tolist()) for t in (d["text"], edited, n["text"]))
        near = lambda x, y: 1.0 if not x and not y else 1 - len(x ^ y) / (len(x) + len(y))
        expected.append((str(d["doc_id"]), len(d["text"]), hashlib.sha256(edited.encode()).hexdigest(), round(near(a, e), 9), round(near(a, f), 9)))
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows]
    assert sorted(got) == sorted(expected)
    by_text = {}
    for r in rows:
        by_text.setdefault(bytes(r["sketch"]), set()).add(r["n_chars"])
    assert sketch.versions(odd_docs.limit(0)).count() == 0
    one = sketch.versions(odd_docs.filter("doc_id = 9")).first()
    assert one["near_next"] == 1.0
    nameless = sketch.versions(odd_docs.filter("doc_id is null"))
    assert nameless.count() == 2


def test_sketches_of_frames(spark, odd_docs):
    rows = sketch.fingerprints(odd_docs).select("text", "sketch").collect()
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", bytes(r["sketch"])) == bytes(r["sketch"])


# -- archives ----------------------------------------------------------------


@pytest.fixture
def pages(spark):
    same = "<p>" + "x" * 200
    rows = [
        (5, "http://a/ü \r\nX: y", same), (3, "http://b/", same), (9, None, same), (9, None, same), (None, "u", same),
        (1, "http://c/", "small"), (2, "http://c/", "small"), (4, "d", None), (6, "e", ""), (7, "f", "日本\r\n\r\nWARC/1.1" + "é" * 300_000),
        (8, "g", "y" * 100), (10, "h", "y" * 100), (11, "i", "z" * 99), (12, "j", "z" * 99),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as digest", "html as payload", "page_id as key").repartition(4)


def test_archive_round_trip(spark, pages):
    bundles = warc.archive(pages)
    got = sorted(((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.records(bundles).collect()), key=str)
    rows = pages.collect()
    least = {}
    for r in rows:
        body = (r["html"] or "").encode()
        if len(body) >= 100 and r["page_id"] is not None:
            least[body] = min(least.get(body, r["page_id"]), r["page_id"])
    expected = []
    for r in rows:
        body = (r["html"] or "").encode()
        to = least.get(body)
        again = to is not None and to != r["page_id"]
        expected.append((r["page_id"], len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", to if again else None))
    assert got == sorted(expected, key=str)
    wanted = spark.createDataFrame([(3,), (7,), (5,), (77,)], "page_id long")
    found = {r["record_id"]: r["payload"] for r in warc.payloads(bundles, wanted).collect()}
    html = {r["page_id"]: r["html"] for r in rows}
    assert set(found) == {3, 5, 7} and bytes(found[7]).decode() == html[7] and found[5] is None
    assert warc.records(warc.archive(pages.limit(0))).count() == 0


def test_bundles_are_plain_zstandard(spark, pages, tmp_path):
    files = warc.export(warc.archive(pages), tmp_path.as_uri()).collect()
    whole = b""
    for f in files:
        data = open(f["path"], "rb").read()
        assert len(data) == f["bytes"]
        whole += zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == pages.count() and b"\r\nX: y" not in whole


def test_frames_and_seek_table(monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 100)
    writer = warc.BundleWriter()
    records = [bytes([65 + i]) * (30 + i) for i in range(20)]
    for i, r in enumerate(records):
        writer.add(i, r)
    bundle, index = writer.done()
    reader = warc.BundleReader(bundle)
    assert len(reader.starts) > 4
    for e in index:
        assert reader.record(e["frame"], e["offset"], e["length"]) == records[e["record_id"]]


def test_one_row_of_each_group_stays_whatever_its_key(spark):
    """Rows that share a key, in unlike groups; a row of the same key next to a near copy."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(80)) for w in "abc")
    rows = [(5, a), (5, b), (3, b + " "), (7, c), (7, c), (None, "alone"), (None, "alone too"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = sorted([(5, a), (3, b + " "), (7, c), (None, "alone"), (None, "alone too")], key=str)
    assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=str) == expected
    assert sorted(map(tuple, simhash.keep_one(docs, width=5, grouped=alike.group).collect()), key=str) == expected


# -- pipeline ----------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "decontamination", "bpe"]
    docs = common.load(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == before
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() == before


def test_duplicate_stage_finds_all_alike(spark):
    """Equals brute force over all pairs: chains, near copies just above and below 0.8, texts far over three bits apart."""
    import corpus_pipeline

    rng = random.Random(12)
    texts = ["", None, " ", "one two", "One  two"]
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(8):
            base = list(base) if rng.random() < 0.5 else texts[-1].split()
            for _ in range(rng.randrange(1, max(2, len(base) // 40))):
                base[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(base))
    line = [f"l{i}" for i in range(400)]
    texts += [" ".join([*line[:-2], f"e{i}", "end"]) for i in range(150)]  # a large group
    sets = [set(minhash.shingle_set(t, alike.SHINGLE).tolist()) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        before = list(root)
        for i in range(len(texts)):
            for j in range(i):
                same = sets[i] == sets[j] or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
                if same:
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.duplicate_stage(spark, docs, "").collect())
    assert kept == sorted(set(root)) and 15 < len(kept) < 100


def test_duplicate_stage_links_by_fingerprints(spark, monkeypatch):
    """Near copies are found by fingerprints and their pivot tables even if no bucket is shared; the exact Jaccard decides."""
    import corpus_pipeline

    lone = iter(range(1 << 40))
    monkeypatch.setattr(minhash, "buckets", lambda shingles, bins: np.array([hash(shingles.tobytes()) + next(lone)] * bool(len(shingles)), np.int64))
    base = [f"w{i}" for i in range(400)]
    near, far = " ".join([*base[:-1], "end"]), " ".join(reversed(base))
    # Shingles that repeat rule a fingerprint, not a set: equal fingerprints, Jaccard below 0.8.
    loop = " ".join(["a", "b", "c", "d", "e"] * 400)
    texts = [" ".join(base), near, far, loop, " ".join([loop, "f", "g", "h"])]
    prints = simhash.fingerprint_of(texts, alike.SHINGLE)
    assert np.bitwise_count(prints[0] ^ prints[1]) <= 3 and np.bitwise_count(prints[3] ^ prints[4]) <= 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.duplicate_stage(spark, docs, "").collect())
    assert kept == [0, 2, 3, 4]


def test_pipeline_of_odd_rows(spark, odd_docs, sf_dir):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs, sf_dir).count() <= odd_docs.count()
        assert stage(spark, odd_docs.limit(0), sf_dir).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
