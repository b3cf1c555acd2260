"""Explicit schemas of everything read from files."""

from __future__ import annotations

from pyspark.sql import types as T


def struct_of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


MBPP_ROW = struct_of(
    problem_id=T.StringType(), prompt=T.StringType(), code=T.StringType(), test_list=T.ArrayType(T.StringType())
)
FUNCTION_ROW = struct_of(
    problem_id=T.StringType(), prompt=T.StringType(), test=T.StringType(), entry_point=T.StringType()
)
PROBLEM = struct_of(
    problem_id=T.StringType(), source=T.StringType(), prompt=T.StringType(), test=T.StringType(), entry=T.StringType()
)

METRIC_FIELDS = struct_of(
    step=T.IntegerType(),
    T=T.IntegerType(),
    loss=T.DoubleType(),
    grpo_loss=T.DoubleType(),
    sdpo_loss=T.DoubleType(),
    reward_mean=T.DoubleType(),
    n_correct=T.IntegerType(),
    n_failed=T.IntegerType(),
    rho=T.DoubleType(),
)
SAMPLE_FIELDS = struct_of(
    prompt_index=T.IntegerType(),
    completion_index=T.IntegerType(),
    prompt=T.StringType(),
    model_prompt=T.StringType(),
    completion=T.StringType(),
    reward=T.IntegerType(),
    feedback=T.StringType(),
)
# The column order of the sample log.
SAMPLE_LOG = T.StructType(METRIC_FIELDS.fields + SAMPLE_FIELDS.fields)
