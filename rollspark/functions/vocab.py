"""Operators over score vectors: one row per position, one array per vocabulary.

A vocabulary holds up to some hundred thousand scores. Spark's higher-order
functions walk arrays element by element without generated code, so these run
as Arrow UDFs: whole batches as numpy matrices, no row loop. Every position
stays in its row, so nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from rollspark.functions.ragged import Ragged, list_array


def soft_cap(logits: Column, cap: float | None) -> Column:
    """F20. Squash scores into (-cap, cap); no cap leaves them alone."""
    return logits if cap is None else _capped(float(cap))(logits)


def _capped(cap: float):
    @arrow_udf(T.ArrayType(T.DoubleType()))
    def capped(scores: pa.Array) -> pa.Array:
        rows = Ragged(scores)
        return list_array(cap * np.tanh(rows.values / cap), rows)

    return capped


def soft_capped_log_softmax(logits: Column, cap: float) -> Column:
    """F20, F10. Log-probabilities of capped scores, with one crossing to Python."""

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def both(scores: pa.Array) -> pa.Array:
        rows = Ragged(scores)
        return _flat(rows, [(chosen, _log_softmax(cap * np.tanh(m / cap))) for chosen, m in rows.matrices()])

    return both(logits)


def _log_softmax(matrix: np.ndarray) -> np.ndarray:
    top = matrix.max(axis=1, keepdims=True)
    shifted = matrix - top
    return shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))


def _nullable(values: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~known)


def _flat(rows: Ragged, pieces: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    out = np.empty(len(rows.values))
    for chosen, matrix in pieces:
        at = rows.starts[np.searchsorted(rows.rows, chosen)]
        out[at[:, None] + np.arange(matrix.shape[1])] = matrix
    return list_array(out, rows)


@arrow_udf(T.ArrayType(T.DoubleType()))
def log_softmax(logits: pa.Array) -> pa.Array:
    """F10. Log-probabilities of all items."""
    rows = Ragged(logits)
    return _flat(rows, [(chosen, _log_softmax(m)) for chosen, m in rows.matrices()])


@arrow_udf(T.ArrayType(T.DoubleType()))
def softmax(logits: pa.Array) -> pa.Array:
    """F10. Probabilities of all items."""
    rows = Ragged(logits)
    return _flat(rows, [(chosen, np.exp(_log_softmax(m))) for chosen, m in rows.matrices()])


@arrow_udf(T.DoubleType())
def item_logprob(logits: pa.Array, item: pa.Array) -> pa.Array:
    """D8, G7. Log-softmax of the scores at one item; null when the item is not in range."""
    rows = Ragged(logits)
    items = item.fill_null(-1).to_numpy(zero_copy_only=False)
    values, known = np.zeros(rows.length), np.zeros(rows.length, dtype=bool)
    for chosen, matrix in rows.matrices():
        wanted = items[chosen]
        inside = (wanted >= 0) & (wanted < matrix.shape[1])
        at = chosen[inside]
        values[at] = _log_softmax(matrix[inside])[np.arange(len(at)), wanted[inside]]
        known[at] = True
    return _nullable(values, known)


def _paired(left: pa.Array, right: pa.Array):
    """Matrix pairs of the rows whose two vectors have the same size."""
    a, b = Ragged(left), Ragged(right)
    sizes = [np.zeros(r.length, dtype=np.int64) for r in (a, b)]
    for size, r in zip(sizes, (a, b)):
        size[r.rows] = r.sizes
    if (sizes[0] != sizes[1]).any():
        raise ValueError("both score vectors of a position must have the same size")
    for (chosen, m), (_, n) in zip(a.matrices(), b.matrices()):
        yield chosen, m, n


_TERMS = T.StructType().add("kl", T.DoubleType()).add("entropy", T.DoubleType()).add("items", T.IntegerType())


def _distill_terms(student: pa.Array, teacher: pa.Array, reverse: bool) -> pa.Array:
    length = len(student)
    kl, entropy = np.zeros(length), np.zeros(length)
    items, known = np.zeros(length, dtype=np.int32), np.zeros(length, dtype=bool)
    for chosen, s, t in _paired(student, teacher):
        log_s, log_t = _log_softmax(s), _log_softmax(t)
        p_t = np.exp(log_t)
        # Items of probability 0 add nothing, also where their log is minus infinity.
        p, log_p, log_q = (np.exp(log_s), log_s, log_t) if reverse else (p_t, log_t, log_s)
        gap = np.subtract(log_p, log_q, out=np.zeros_like(p), where=p > 0)
        kl[chosen] = (p * gap).sum(axis=1)
        entropy[chosen] = -np.multiply(p_t, log_t, out=np.zeros_like(p_t), where=p_t > 0).sum(axis=1)
        items[chosen] = s.shape[1]
        known[chosen] = True
    return pa.StructArray.from_arrays(
        [_nullable(kl, known), _nullable(entropy, known), _nullable(items, known)], names=["kl", "entropy", "items"]
    )


@arrow_udf(_TERMS)
def _terms_teacher_student(student: pa.Array, teacher: pa.Array) -> pa.Array:
    return _distill_terms(student, teacher, reverse=False)


@arrow_udf(_TERMS)
def _terms_student_teacher(student: pa.Array, teacher: pa.Array) -> pa.Array:
    return _distill_terms(student, teacher, reverse=True)


def distill_terms(student: Column, teacher: Column, direction: str = "teacher_student") -> Column:
    """F11, F12. Struct of the KL divergence, the teacher entropy and the vocabulary size.

    ``teacher_student`` is KL(teacher || student).
    """
    if direction == "teacher_student":
        return _terms_teacher_student(student, teacher)
    if direction == "student_teacher":
        return _terms_student_teacher(student, teacher)
    raise ValueError(f"unknown direction {direction!r}")


def entropy_weight(entropy: Column, items: Column, weight: float) -> Column:
    """F13. Less weight where the teacher is uncertain; 1 for a vocabulary of one item."""
    spread = F.when(items > 1, entropy / F.ln(items)).otherwise(0.0)
    return F.lit(1.0) - F.lit(float(weight)) * spread


def _kept(matrix: np.ndarray, temperature: float, k: int) -> np.ndarray:
    """Log-probabilities after temperature and top-k; minus infinity for dropped items."""
    scaled = matrix / temperature
    size = matrix.shape[1]
    if 0 < k < size:
        threshold = np.partition(scaled, size - k, axis=1)[:, size - k][:, None]
        scaled = np.where(scaled < threshold, -np.inf, scaled)
    return _log_softmax(scaled)


def _without_law(matrix: np.ndarray) -> np.ndarray:
    """Rows whose scores give no probabilities: with NaN or plus infinity, or with minus infinity alone."""
    return np.isnan(matrix).any(axis=1) | (matrix == np.inf).any(axis=1) | (matrix == -np.inf).all(axis=1)


def top_k_items(logits: Column, temperature: float, k: int) -> Column:
    """G6, G7. Array of the kept items with sampling probability and raw log-probability.

    Items below the k-th largest score are dropped, ties with it stay; k <= 0 keeps all.
    The raw log-probability ignores temperature and top-k. Items of minus infinity are
    dropped. A vector with NaN or plus infinity, or of minus infinity alone, has no
    probabilities and gives null.
    """

    @arrow_udf("array<struct<item:int,prob:double,logprob:double>>")
    def kept_items(scores: pa.Array) -> pa.Array:
        rows = Ragged(scores)
        sizes = np.zeros(rows.length, dtype=np.int32)
        unordered = np.zeros(rows.length, dtype=bool)
        found = []
        for chosen, matrix in rows.matrices():
            broken = _without_law(matrix)
            unordered[chosen[broken]] = True
            chosen, matrix = chosen[~broken], matrix[~broken]
            kept, raw = _kept(matrix, temperature, k), _log_softmax(matrix)
            at, item = np.nonzero(kept > -np.inf)
            sizes[chosen] = np.bincount(at, minlength=len(chosen))
            found.append((chosen[at], item, np.exp(kept[at, item]), raw[at, item]))
        row, item, prob, raw = (
            [np.concatenate(parts) for parts in zip(*found)] if found else [np.zeros(0)] * 4
        )
        order = np.argsort(row, kind="stable")
        fields = pa.StructArray.from_arrays(
            [pa.array(item[order].astype(np.int32)), pa.array(prob[order]), pa.array(raw[order])],
            names=["item", "prob", "logprob"],
        )
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), fields, mask=pa.array(unordered))

    return kept_items(logits)


def draw_item(logits: Column, u: Column, temperature: float, k: int) -> Column:
    """G8. Struct of the drawn item and its raw log-probability, for a uniform ``u``.

    Items are lined up by number; the first whose running probability exceeds
    ``u`` is drawn, the last kept one if rounding leaves none. Null for vectors that ``top_k_items`` gives null for.
    """

    @arrow_udf("struct<item:int,logprob:double>")
    def drawn(scores: pa.Array, point: pa.Array) -> pa.Array:
        rows = Ragged(scores)
        points = point.to_numpy(zero_copy_only=False)
        item, raw = np.zeros(rows.length, dtype=np.int32), np.zeros(rows.length)
        known = np.zeros(rows.length, dtype=bool)
        for chosen, matrix in rows.matrices():
            whole = ~_without_law(matrix)
            chosen, matrix = chosen[whole], matrix[whole]
            if not len(chosen):
                continue
            kept = _kept(matrix, temperature, k)
            above = np.cumsum(np.exp(kept), axis=1) > points[chosen][:, None]
            last = matrix.shape[1] - 1 - np.argmax(kept[:, ::-1] > -np.inf, axis=1)
            picked = np.where(above.any(axis=1), above.argmax(axis=1), last)
            item[chosen] = picked
            raw[chosen] = _log_softmax(matrix)[np.arange(len(chosen)), picked]
            known[chosen] = True
        fields = [_nullable(item, known), _nullable(raw, known)]
        return pa.StructArray.from_arrays(fields, names=["item", "logprob"], mask=pa.array(~known))

    return drawn(logits, u)


_COMPARED = T.StructType(
    [
        T.StructField("max_abs", T.DoubleType()),
        T.StructField("sum_abs", T.DoubleType()),
        T.StructField("items", T.IntegerType()),
        T.StructField("top_a", T.IntegerType()),
        T.StructField("top_b", T.IntegerType()),
        T.StructField("has_nan", T.BooleanType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
    ]
)


@arrow_udf(_COMPARED)
def compare_scores(a: pa.Array, b: pa.Array) -> pa.Array:
    """F21. Differences of two score vectors of one position, top items (first on ties), range of ``a``."""
    length = len(a)
    numbers = {name: np.zeros(length) for name in ("max_abs", "sum_abs", "low", "high")}
    counts = {name: np.zeros(length, dtype=np.int32) for name in ("items", "top_a", "top_b")}
    has_nan, known = np.zeros(length, dtype=bool), np.zeros(length, dtype=bool)
    for chosen, m, n in _paired(a, b):
        gap = np.abs(m - n)
        numbers["max_abs"][chosen] = gap.max(axis=1)
        numbers["sum_abs"][chosen] = gap.sum(axis=1)
        numbers["low"][chosen] = m.min(axis=1)
        numbers["high"][chosen] = m.max(axis=1)
        counts["items"][chosen] = m.shape[1]
        counts["top_a"][chosen] = m.argmax(axis=1)
        counts["top_b"][chosen] = n.argmax(axis=1)
        has_nan[chosen] = np.isnan(m).any(axis=1) | np.isnan(n).any(axis=1)
        known[chosen] = True
    columns = {
        "max_abs": numbers["max_abs"],
        "sum_abs": numbers["sum_abs"],
        "items": counts["items"],
        "top_a": counts["top_a"],
        "top_b": counts["top_b"],
        "has_nan": has_nan,
        "low": numbers["low"],
        "high": numbers["high"],
    }
    return pa.StructArray.from_arrays([_nullable(v, known) for v in columns.values()], names=list(columns))
