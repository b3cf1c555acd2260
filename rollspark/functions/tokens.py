"""Token-array operators (D1-D7), all row-local: no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from rollspark.functions.ragged import Ragged, list_array


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def truncate_prompt(ids: Column, max_tokens) -> Column:
    """D1. Keep the head of the prompt."""
    return F.slice(ids, F.lit(1), _column(max_tokens))


def cut_at_eos(ids: Column, prompt_len: Column, eos_id) -> Column:
    """D2. Cut after the first end token of the response; one in the prompt does not count."""
    response = F.slice(ids, prompt_len + 1, F.greatest(F.size(ids) - prompt_len, F.lit(0)))
    at = F.array_position(response, _column(eos_id)).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), prompt_len + at)).otherwise(ids)


def _zeros_then_ones(zeros: Column, length: Column) -> Column:
    zeros = F.least(F.greatest(zeros, F.lit(0)), length)
    return F.concat(F.array_repeat(F.lit(0), zeros), F.array_repeat(F.lit(1), length - zeros))


def response_mask(length: Column, prompt_len: Column) -> Column:
    """D3. 0 over the prompt, 1 over the response."""
    return _zeros_then_ones(prompt_len, length)


def align_logprobs(token_lp: Column, length: Column, prompt_len: Column) -> Column:
    """D4. Log-probs of the tokens that survived the cut; empty when none were returned."""
    kept = F.slice(token_lp, F.lit(1), F.greatest(length - prompt_len, F.lit(0)))
    return F.coalesce(kept, F.array().cast("array<double>"))


def training_window(ids: Column, prompt_len: Column, max_tokens) -> tuple[Column, Column]:
    """D5. Last ``max_tokens`` ids and the prompt length within them; off when not positive."""
    limit = F.coalesce(_column(max_tokens).cast("int"), F.lit(0))
    dropped = F.when(limit > 0, F.greatest(F.size(ids) - limit, F.lit(0))).otherwise(F.lit(0))
    return F.slice(ids, dropped + 1, F.size(ids) - dropped), F.greatest(prompt_len - dropped, F.lit(0))


def loss_start(prompt_len: Column) -> Column:
    """First position that can carry a loss: the first token has no predecessor."""
    return F.greatest(prompt_len, F.lit(1))


def loss_mask(length: Column, prompt_len: Column) -> Column:
    """1 on the positions that carry a loss."""
    return _zeros_then_ones(loss_start(prompt_len), length)


def response_tokens(length: Column, prompt_len: Column) -> Column:
    """Number of positions that carry a loss."""
    return F.greatest(length - loss_start(prompt_len), F.lit(0))


@arrow_udf(T.ArrayType(T.IntegerType()))
def mask_positions(mask: pa.Array) -> pa.Array:
    """D6. Running count of the mask less one; 0 where masked out."""
    rows = Ragged(mask)
    counts = np.cumsum(rows.values, dtype=np.int64)
    before = counts[rows.starts] - rows.values[rows.starts].astype(np.int64)
    positions = counts - np.repeat(before, rows.sizes) - 1
    positions[rows.values == 0] = 0
    return list_array(positions.astype(np.int32), rows)


def is_unpadded(mask: Column) -> Column:
    """D7. True if the mask covers every position of the row."""
    return F.aggregate(mask, F.lit(0.0), lambda total, m: total + m) == F.size(mask)


def require_unpadded(ids: Column, mask: Column) -> Column:
    """D7. The ids, or an error if the row is padded."""
    return F.when(is_unpadded(mask), ids).otherwise(F.raise_error(F.lit("rows must not be padded")))
