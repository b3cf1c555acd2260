"""Language-model scoring with a hashed maximum-entropy model.

The probability of a word is that of its class given the words before it, times
that of the word in its class. The first factor is a softmax over classes whose
features are the last word, the one before it (a skip), both together (an n-gram)
and a bias, hashed into ``SLOTS`` rows of weights. The second is the maximum-entropy
model of the word itself, whose weights have a closed form: counts plus a half, with
a half for all unseen words of the class.

Everything is gathered from all training texts: counts of all words, the contexts of
frequent words, from which classes are formed, and the weights. Weights are
trained in rounds: each task makes gradient steps over its texts from the shared
weights, and a round ends with the mean of the tasks' steps, by how often each row
was used. Texts are scored in batches of numpy rows.

Words are runs of non-space characters, A-Z in lower case; each text ends with one
end token. Null counts as empty: the end token alone. Repeated rows score alike.
Without training texts every word is unseen and the classes are even.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rollspark.llm.common import share, slices, store

END = b""
CLASSES = 16  # of words; the end token is a class of its own
SLOTS = 1 << 15
BLOCK = 1 << 7  # rows of weights that travel together
BUCKETS = 64  # of the words before a word, for its signature
BATCH = 1 << 13  # tokens of a gradient step
GROUP = 1 << 19  # letters of consecutive texts that are held as words at once
RATE = 0.3
# Words with at least 1/HEAD of all tokens are looked up in memory; there are at most
# HEAD of them, whatever the corpus. Classes are learnt for those with 1/SIGNED.
HEAD = 1 << 19
SIGNED = 1 << 15
HELD_WORDS = 400_000  # distinct words a task counts before it hands them on


def groups(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """Consecutive texts in bytes, A-Z in lower case."""
    group, held = [], 0
    for text in texts:
        group.append((text or "").encode().lower())
        held += len(group[-1])
        if held >= GROUP:
            yield group
            group, held = [], 0
    if group:
        yield group


def tokens_of(group: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All tokens of the texts on end, and where each text begins (and the end)."""
    tokens: list[bytes] = []
    begins = [0]
    for text in group:
        tokens += text.split()
        tokens.append(END)
        begins.append(len(tokens))
    return tokens, np.array(begins)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for group in groups(t for part in slices(batch.column(0)) for t in part):
            counts.update(tokens_of(group)[0])
            if len(counts) > HELD_WORDS:
                yield handed()
                counts.clear()
    yield handed()


class Lexicon:
    """Frequent words with their counts, and the class of any word."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.place = {w: i for i, w in enumerate(words)}
        self.counts = counts
        self.hashes = np.array([zlib.crc32(w) for w in words], np.uint64)
        self.classes = np.zeros(len(words), np.int64)
        self.endings: dict[bytes, int] = {}
        self.end = self.place.get(END, -1)

    def form_classes(self, signatures: np.ndarray, signed: np.ndarray, rounds: int = 15) -> None:
        """Classes by k-means of signatures (rows of counts for the places ``signed``); other words go by their endings."""
        words = list(self.place)
        if len(signed):
            mean = signatures.sum(axis=0) + 1e-9
            rows = signatures + 2 * mean / mean.sum()
            rows = np.sqrt(rows / rows.sum(axis=1, keepdims=True))
            weight = self.counts[signed].astype(np.float64)
            rng = np.random.default_rng(11)
            centres = rows[rng.choice(len(rows), CLASSES, p=weight / weight.sum())]
            for _ in range(rounds):
                nearest = (rows @ centres.T).argmax(axis=1)
                sums = np.zeros_like(centres)
                np.add.at(sums, nearest, rows * weight[:, None])
                norm = np.linalg.norm(sums, axis=1, keepdims=True)
                centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
            self.classes[signed] = 1 + nearest
            votes: dict[bytes, np.ndarray] = {}
            for place, own in zip(signed.tolist(), nearest.tolist()):
                for width in (1, 2, 3):
                    votes.setdefault(words[place][-width:], np.zeros(CLASSES))[own] += self.counts[place]
            self.endings = {ending: 1 + int(v.argmax()) for ending, v in votes.items()}
        known = set(signed.tolist())
        for word, place in self.place.items():
            if place not in known:
                self.classes[place] = self.class_of(word)

    def class_of(self, word: bytes) -> int:
        """Class of a word by its ending: 1 to CLASSES, 0 for the end token."""
        if not word:
            return 0
        of = self.endings
        return of.get(word[-3:]) or of.get(word[-2:]) or of.get(word[-1:]) or 1

    def look_up(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place (-1 for words not held), hash and class of each token."""
        places = np.fromiter(map(self.place.get, tokens, repeat(-1)), np.int64, len(tokens))
        if len(self.classes):
            hashes, classes = self.hashes[places], self.classes[places]
        else:
            hashes, classes = np.zeros(len(tokens), np.uint64), np.zeros(len(tokens), np.int64)
        rest = np.flatnonzero(places < 0)
        words = [tokens[i] for i in rest.tolist()]
        hashes[rest] = np.array(list(map(zlib.crc32, words)), np.uint64)
        classes[rest] = list(map(self.class_of, words))
        return places, hashes, classes


def features(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Rows of weights for each token: last word, the one before it, both. Row 0 is the bias of all."""
    start = np.uint64(0xFFFFFFFFFF)
    one = np.concatenate([[start], hashes[:-1]])
    one[begins[:-1]] = start
    two = np.concatenate([[start], one[:-1]])
    two[begins[:-1]] = start
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    mixed = [one * odd[0], two * odd[1] + odd[2], (one * odd[2]) ^ (two * odd[0] + odd[1])]
    return np.stack([1 + ((m * odd[0] >> np.uint64(33)) % np.uint64(SLOTS - 1)).astype(np.int64) for m in mixed])


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of all classes for tokens with the given rows of weights."""
    scores = weights[rows[0]] + weights[rows[1]] + weights[rows[2]] + weights[0]
    scores -= scores.max(axis=1, keepdims=True)
    scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
    return scores


class Steps:
    """Gradient steps from shared weights, with one step size per row that shrinks as the row is used (AdaGrad)."""

    def __init__(self, weights: np.ndarray):
        self.start, self.weights = weights, weights.copy()
        self.squares = np.zeros(len(weights), np.float32)
        self.uses = np.zeros(len(weights), np.float32)

    def learn(self, rows: np.ndarray, classes: np.ndarray) -> None:
        for at in range(0, rows.shape[1], BATCH):
            own, told = rows[:, at : at + BATCH], classes[at : at + BATCH]
            gradient = np.exp(log_softmax(self.weights, own))
            gradient[np.arange(len(told)), told] -= 1
            flat = own.ravel().astype(np.uint16)  # SLOTS fit; numpy sorts small numbers by their digits
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            used, times = flat[first].astype(np.int64), np.diff(np.append(first, len(flat)))
            sums = np.add.reduceat(np.take(gradient, order % len(told), axis=0), first, axis=0)
            self._step(used, sums / times[:, None], times)
            self._step(np.array([0]), gradient.mean(axis=0, keepdims=True), np.array([len(told)]))

    def _step(self, used: np.ndarray, gradient: np.ndarray, times: np.ndarray) -> None:
        self.squares[used] += (gradient * gradient).sum(axis=1)
        self.weights[used] -= RATE * gradient / np.sqrt(self.squares[used] + 1e-6)[:, None]
        self.uses[used] += times

    def handed(self) -> Iterator[tuple[int, bytes]]:
        """Blocks of used rows: how often each was used, and its whole step times that."""
        step = (self.weights - self.start) * self.uses[:, None]
        both = np.concatenate([self.uses[:, None], step], axis=1).astype(np.float32)
        for block in range(SLOTS // BLOCK):
            rows = both[block * BLOCK : (block + 1) * BLOCK]
            if rows[:, 0].any():
                yield block, rows.tobytes()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the blocks of each number; as many are held as the model has."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = np.frombuffer(rows, np.float32).astype(np.float64)
            sums[block] = sums[block] + rows if block in sums else rows
    yield pa.RecordBatch.from_arrays(
        [pa.array(sums.keys(), pa.int32()), pa.array([s.astype(np.float32).tobytes() for s in sums.values()], pa.binary())], names=["block", "rows"]
    )


class MaxentModel:
    """Lexicon, weights, and what the words of each class weigh together."""

    def __init__(self, lexicon: Lexicon, tokens: int, words: int):
        self.lexicon, self.tokens, self.words = lexicon, tokens, words
        self.weights = np.zeros((SLOTS, CLASSES + 1), np.float32)
        self.mass = np.full(CLASSES + 1, 0.5)

    def score(self, texts: Iterable[str | None]) -> dict[str, list]:
        """For each text what needs no rare words, and its rare words with their numbers."""
        out: dict[str, list] = {"n_tokens": [], "held": [], "logs": [], "classes": [], "rare": []}
        lexicon, mass = self.lexicon, np.log10(self.mass)
        logs = np.append(np.log10(lexicon.counts + 0.5), 0.0)  # place -1 is a rare word
        for group in groups(texts):
            tokens, begins = tokens_of(group)
            places, hashes, classes = lexicon.look_up(tokens)
            rows = features(hashes, begins)
            given = np.empty(len(tokens))
            for at in range(0, len(tokens), BATCH):
                told = classes[at : at + BATCH]
                given[at : at + BATCH] = log_softmax(self.weights, rows[:, at : at + BATCH])[np.arange(len(told)), told]
            given = given / np.log(10) - mass[classes]
            first = begins[:-1]
            out["n_tokens"] += np.diff(begins).tolist()
            out["held"] += np.add.reduceat(places >= 0, first, dtype=np.int64).tolist()
            out["logs"] += np.add.reduceat(logs[places], first).tolist()
            out["classes"] += np.add.reduceat(given, first).tolist()
            rest = np.flatnonzero(places < 0)
            cuts = np.searchsorted(rest, begins).tolist()
            words = [tokens[i] for i in rest.tolist()]
            out["rare"] += [Counter(words[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return out


def _lexicon(vocabulary: DataFrame) -> tuple[Lexicon, int, int]:
    total, words = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # At most HEAD words can have 1/HEAD of the tokens each.
    frequent = vocabulary.filter(F.col("n") * HEAD >= F.lit(total)).toArrow()
    frequent = frequent.sort_by([("n", "descending"), ("word", "ascending")])
    return Lexicon(frequent["word"].to_pylist(), frequent["n"].to_numpy()), total, words


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", rounds: int = 2) -> tuple[MaxentModel, DataFrame]:
    """2. Model and stored vocabulary (word, n) of all rows where ``learn`` holds.

    Each round's gradient steps go over another part of the rows, dealt by a hash of the key, so that every row is
    used once. Only the frequent words, their signatures and the weights come to the driver: all of fixed bounds.
    """
    spark = docs.sparkSession
    texts = docs.filter(learn).select(F.col(text).alias("text"), F.col(key).alias("key"))
    counted = texts.select("text").mapInArrow(_counted, "word binary, n long")
    vocabulary = store(counted.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    lexicon, total, words = _lexicon(vocabulary)
    signed = np.flatnonzero((lexicon.counts * SIGNED >= total) & (np.arange(len(lexicon.counts)) != lexicon.end))
    shared = share(spark, (lexicon, signed))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chosen = shared()
        row = np.full(len(own.counts) + 1, -1)
        row[chosen] = np.arange(len(chosen))
        seen = np.zeros(len(chosen) * BUCKETS, np.int64)
        of_word = np.array([zlib.crc32(w[-3:]) % BUCKETS for w in own.place] + [0])
        for batch in batches:
            for group in groups(t for part in slices(batch.column(0)) for t in part):
                tokens, begins = tokens_of(group)
                places = np.fromiter(map(own.place.get, tokens, repeat(-1)), np.int64, len(tokens))
                buckets = of_word[places]
                for i in np.flatnonzero(places < 0).tolist():
                    buckets[i] = zlib.crc32(tokens[i][-3:]) % BUCKETS
                inner = np.ones(len(tokens), bool)
                inner[begins[:-1]] = False
                at = np.flatnonzero(inner & (row[places] >= 0))
                seen += np.bincount(row[places[at]] * BUCKETS + buckets[at - 1], minlength=len(seen))
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(seen[cells])], names=["cell", "n"])

    cells = texts.select("text").mapInArrow(signatures, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(len(signed) * BUCKETS)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    lexicon.form_classes(table.reshape(-1, BUCKETS), signed)
    model = MaxentModel(lexicon, total, words)
    formed = share(spark, lexicon)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, place, classes = formed().class_of, formed().place, formed().classes
        sums = np.zeros(CLASSES + 1)
        for batch in batches:
            own = [int(classes[place[w]]) if w in place else class_of(w) for w in batch.column(0).to_pylist()]
            sums += np.bincount(own, batch.column(1).to_numpy() + 0.5, CLASSES + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES + 1, dtype=np.int32)), pa.array(sums)], names=["class", "mass"])

    for row in vocabulary.mapInArrow(masses, "class int, mass double").groupBy("class").agg(F.sum("mass").alias("mass")).collect():
        model.mass[row["class"]] += row["mass"]

    for turn in range(rounds):
        current = share(spark, model)

        def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = current()
            made = Steps(own.weights)
            for batch in batches:
                for group in groups(t for part in slices(batch.column(0)) for t in part):
                    tokens, begins = tokens_of(group)
                    _, hashes, classes = own.lexicon.look_up(tokens)
                    made.learn(features(hashes, begins), classes)
            blocks = list(made.handed())
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([r for _, r in blocks], pa.binary())], names=["block", "rows"])

        part = texts.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == turn).select("text")
        made = part.mapInArrow(steps, "block int, rows binary").repartition("block").mapInArrow(_summed, "block int, rows binary").toArrow()
        for block, rows in zip(made["block"].to_pylist(), made["rows"].to_pylist()):
            rows = np.frombuffer(rows, np.float32).reshape(BLOCK, -1)
            model.weights[block * BLOCK : (block + 1) * BLOCK] += rows[:, 1:] / np.maximum(rows[:, :1], 1)
    return model, vocabulary


def score(docs: DataFrame, model: MaxentModel, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """2. Each row with ``n_tokens``, ``n_known``, ``base_score`` (words alone) and ``score``, log10 probabilities of the whole text.

    The columns of the input are within ``record``. Rare words are looked up by a join: none has 1/HEAD of the tokens.
    """
    shared = share(docs.sparkSession, model)
    kind = "struct<n_tokens: long, held: long, logs: double, classes: double, rare: array<struct<word: binary, n: int>>>"
    arrow = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    @F.arrow_udf(kind)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared()
        for batch in batches:
            out = own.score(t for part in slices(batch) for t in part)
            words = pa.array([w for c in out["rare"] for w in c], pa.binary())
            times = pa.array([n for c in out["rare"] for n in c.values()], pa.int32())
            ends = pa.array(np.cumsum([0, *map(len, out["rare"])]), pa.int32())
            rare = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([words, times], names=["word", "n"])).cast(arrow)
            parts = [pa.array(out["n_tokens"], pa.int64()), pa.array(out["held"], pa.int64()), pa.array(out["logs"], pa.float64()), pa.array(out["classes"], pa.float64()), rare]
            yield pa.StructArray.from_arrays(parts, names=["n_tokens", "held", "logs", "classes", "rare"])

    kept = F.struct(*[c for c in docs.columns if c != text]) if len(docs.columns) > 1 else F.struct(F.lit(None).alias("_"))
    rows = docs.select(kept.alias("record"), scored(text).alias("found"), F.monotonically_increasing_id().alias("row"))
    # Written once, so that row numbers stay the same whatever is computed again.
    rows = store(rows, "scored")
    rare = rows.select("row", F.explode("found.rare").alias("rare")).select("row", F.col("rare.word").alias("word"), F.col("rare.n").alias("times"))
    met = rare.join(vocabulary, "word", "left")
    logs = F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)).alias("rare_logs")
    sums = met.groupBy("row").agg(logs, F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    whole = rows.select("record", "row", "found.n_tokens", "found.held", "found.logs", "found.classes").join(sums, "row", "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return whole.select(
        "record",
        "n_tokens",
        (F.col("held") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + 0.5 * (model.words + 1))))).alias("base_score"),
        (logs + F.col("classes")).alias("score"),
    )
