"""Quality classifier by attention over passages (multiple-instance learning).

A document is a bag of passages of ``WORDS`` words, cut over its whole text; only
the document has a label. Each passage is encoded, gated attention weighs the
passages of a document against each other, and the weighted mean of their codes is
scored. Encoder, attention and scorer are learnt together from the labels.

What a passage shows to the encoder: shares of bytes and of hashed byte pairs, how
often a word follows itself, the share of distinct words, and its length. Nothing
but the text enters a score. Null and empty texts are one empty passage and get
the model's score for it. Repeated rows score alike. Without labelled rows every
score is 0.5. A column with the name of the new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rollspark.llm.common import share, slices, unused

WORDS = 64
PAIRS = 256
FEATURES = 256 + PAIRS + 4
CODE = 16
GATE = 8
GROUP = 1 << 19  # bytes of consecutive texts that are encoded at once
THRESHOLD = 0.3
SPREAD = 32  # passages that one document of the sample teaches

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Odd multipliers of a word's bytes by their position, for word hashes.
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the first passage of each text. Every text has at least one."""
    data = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    space = SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    at = np.flatnonzero(starts)
    text_of_word = np.searchsorted(begins, at, "right") - 1
    words_of_text = np.bincount(text_of_word, minlength=len(texts))
    passages_of_text = np.maximum(1, -(-words_of_text // WORDS))
    first = np.cumsum(passages_of_text) - passages_of_text
    n = int(passages_of_text.sum())
    features = np.zeros((n, FEATURES), np.float32)
    if not len(at):
        return features, first
    number = np.arange(len(at)) - (np.cumsum(words_of_text) - words_of_text)[text_of_word]
    passage = first[text_of_word] + number // WORDS
    word = np.cumsum(starts) - 1  # of each byte; white space belongs to the word before it
    inside = np.flatnonzero(~space)
    of_byte = passage[word[inside]]
    shown = data[inside]
    size = np.bincount(of_byte, minlength=n).astype(np.float32)[:, None] + 1
    features[:, :256] = np.bincount(of_byte * 256 + shown, minlength=n * 256).reshape(n, 256)
    pair = ((data[inside - 1].astype(np.uint32) * 256 + shown) * np.uint32(2654435761) >> np.uint32(24)) % PAIRS
    features[:, 256 : 256 + PAIRS] = np.bincount(of_byte * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS)
    features[:, : 256 + PAIRS] = np.sqrt(features[:, : 256 + PAIRS] / size)
    mixed = (shown.astype(np.uint64) + np.uint64(1)) * POWERS[(inside - at[word[inside]]) % 64]
    hashed = np.add.reduceat(mixed, np.searchsorted(inside, at))
    words = np.bincount(passage, minlength=n).astype(np.float32)
    again = (hashed[1:] == hashed[:-1]) & (passage[1:] == passage[:-1])
    features[:, -4] = np.bincount(passage[1:][again], minlength=n) / np.maximum(words, 1)
    keys = np.unique((passage.astype(np.uint64) << np.uint64(40)) | (hashed >> np.uint64(24)))
    features[:, -3] = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(words, 1)
    features[:, -2] = np.log1p(words)
    features[:, -1] = np.log1p(size[:, 0] - 1) - np.log1p(words)
    return features, first


def in_groups(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Consecutive texts in bytes, about GROUP of them together."""
    group, held = [], 0
    for text in texts:
        group.append((text or "").encode())
        held += len(group[-1])
        if held >= GROUP:
            yield group
            group, held = [], 0
    if group:
        yield group


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class AttentionModel:
    """Encoder, gated attention and scorer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.weights = {
            "encode": draw(FEATURES, CODE), "encode_0": np.zeros(CODE, np.float32),
            "gate_t": draw(CODE, GATE), "gate_s": draw(CODE, GATE), "attend": draw(GATE),
            "score": draw(CODE), "score_0": np.zeros(1, np.float32),
        }
        self.fitted = False

    def codes(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes and attention of passages, with both halves of the gate."""
        return self._encoded((features - self.mean) / self.scale)

    def pooled(self, code: np.ndarray, attention: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted mean code of each document, and the weights."""
        owner = np.repeat(np.arange(len(first)), np.diff([*first, len(code)]))
        weight = np.exp(attention - np.maximum.reduceat(attention, first)[owner])
        weight /= np.add.reduceat(weight, first)[owner]
        return np.add.reduceat(weight[:, None] * code, first, axis=0), weight

    def probability(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        if not self.fitted:
            return np.full(len(texts), 0.5)
        out = [np.zeros(0)]
        for group in in_groups(texts):
            features, first = passages(group)
            code, attention, _, _ = self.codes(features)
            z, _ = self.pooled(code, attention, first)
            out.append(sigmoid((z @ self.weights["score"] + self.weights["score_0"]).astype(np.float64)))
        return np.concatenate(out)

    def loss(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> float:
        """Mean log loss of documents, given the standardised features of their passages."""
        code, attention = self._encoded(x)[:2]
        z, _ = self.pooled(code, attention, first)
        p = sigmoid(z @ self.weights["score"] + self.weights["score_0"])
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    def _encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w = self.weights
        code = np.tanh(x @ w["encode"] + w["encode_0"])
        t, s = np.tanh(code @ w["gate_t"]), sigmoid(code @ w["gate_s"])
        return code, (t * s) @ w["attend"], t, s

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of ``loss`` by all weights."""
        w = self.weights
        owner = np.repeat(np.arange(len(first)), np.diff([*first, len(x)]))
        code, attention, t, s = self._encoded(x)
        z, weight = self.pooled(code, attention, first)
        d_score = (sigmoid(z @ w["score"] + w["score_0"]) - y) / len(y)
        d_z = (d_score[:, None] * w["score"])[owner]
        d_weight = (d_z * code).sum(axis=1)
        d_attention = weight * (d_weight - np.add.reduceat(weight * d_weight, first)[owner])
        d_t = d_attention[:, None] * w["attend"] * s * (1 - t * t)
        d_s = d_attention[:, None] * w["attend"] * t * s * (1 - s)
        d_code = weight[:, None] * d_z + d_t @ w["gate_t"].T + d_s @ w["gate_s"].T
        d_in = d_code * (1 - code * code)
        return {
            "encode": x.T @ d_in, "encode_0": d_in.sum(axis=0), "gate_t": code.T @ d_t, "gate_s": code.T @ d_s,
            "attend": (d_attention[:, None] * t * s).sum(axis=0), "score": z.T @ d_score, "score_0": d_score.sum(keepdims=True),
        }

    def fit(self, texts: list[str | None], labels: np.ndarray, epochs: int = 150, rate: float = 0.01, decay: float = 1e-3) -> None:
        """Adam on the mean log loss of all documents; gradients of all weights from the document labels alone."""
        if not len(texts):
            return
        parts = [passages(group) for group in in_groups(texts)]
        before = np.cumsum([0, *[len(f) for f, _ in parts]])
        first = np.concatenate([f + b for (_, f), b in zip(parts, before)])
        x = np.concatenate([f for f, _ in parts])
        del parts
        self.mean = x.mean(axis=0)
        self.scale = x.std(axis=0) + 0.05  # rare bytes must not count for more than they show
        x -= self.mean
        x /= self.scale
        y = labels.astype(np.float32)
        w = self.weights
        first_moment = {k: np.zeros_like(v) for k, v in w.items()}
        second_moment = {k: np.zeros_like(v) for k, v in w.items()}
        self.fitted = True
        for step in range(1, epochs + 1):
            for k, g in self.gradient(x, first, y).items():
                g = g + decay * w[k] * (k != "score_0")
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * g * g
                w[k] = (
                    w[k] - rate * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
                ).astype(np.float32)


def spread(text: str | None) -> str | None:
    """What a document of the sample teaches: all of it, or of a long one ``SPREAD`` passages spread evenly over it."""
    words = (text or "").encode().split()
    if len(words) <= SPREAD * WORDS:
        return text
    begins = np.linspace(0, len(words) // WORDS - 1, SPREAD).astype(np.int64) * WORDS
    return b" ".join(b" ".join(words[b : b + WORDS]) for b in begins.tolist()).decode()


def _spread():
    @F.arrow_udf("string")
    def spread_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([spread(text) for texts in slices(batch) for text in texts], pa.string())

    return spread_texts


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
    label: str = "quality", max_documents: int = 3000,
) -> AttentionModel:
    """4. Fit on labelled documents, ``max_documents`` at most, taken in the order of their keys' hashes.

    ``learn`` is a condition on the label table. Several labels of one key count by their majority. What is
    fitted is a model of fixed size; all that reaches the driver is its sample, of long texts ``SPREAD`` passages.
    """
    usable = labels.filter(learn & F.col(label).isNotNull() & F.col(key).isNotNull())
    voted = usable.groupBy(F.col(key).alias("_key")).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    there = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    chosen = voted.orderBy(F.xxhash64("_key"), "_key").limit(max_documents)
    rows = there.join(F.broadcast(chosen), "_key").select("_text", "_label", "_key")
    rows = rows.orderBy(F.xxhash64("_key"), "_key", F.xxhash64("_text")).limit(max_documents)
    rows = rows.select(_spread()("_text").alias("_text"), "_label").toArrow()
    model = AttentionModel()
    model.fit(rows["_text"].to_pylist(), rows["_label"].to_numpy())
    return model


def score(docs: DataFrame, model: AttentionModel, text: str = "text", out: str = "quality_score") -> DataFrame:
    """4. Adds the probability of good quality of each whole text."""
    shared = share(docs.sparkSession, model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = shared()
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0), *[fitted.probability(texts) for texts in slices(batch)]]), pa.float64())

    return docs.withColumn(out, scored(text))


def keep_good(docs: DataFrame, model: AttentionModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """4. Rows whose score reaches the threshold."""
    out = unused(docs, "_quality")
    return score(docs, model, text, out).filter(F.col(out) >= threshold).select(*docs.columns)
