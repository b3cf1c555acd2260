"""Rollout analytics on Spark.

Problems, sampled completions, token log-probabilities and logits go in as
DataFrames; rewards, advantages, loss values, feedback prompts, metrics and
reports come out as DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
