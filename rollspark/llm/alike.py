"""Groups of texts whose sets of shingles have a Jaccard similarity of ``PERCENT`` or more.

The pipeline's stage uses these. Candidates are the pairs that operator 8 links, by
SimHash fingerprints of these shingles and its tables of distances to reference
fingerprints. That cannot find all such pairs: at similarity 0.8 two fingerprints differ in ten bits on
average and in seventeen at times, and so far apart lie unrelated texts too. So further
candidates come from buckets of minima, and every candidate pair is verified by
the exact Jaccard of its two sets; how, and why no pair that shares a bucket goes unseen,
is told in ``minhash``.

Null and blank texts have the empty set; they are equal to one another and like nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollspark.llm import minhash

SHINGLE = 5
PERCENT = 80
EMPTY = -1  # no row has this number


def group(rows: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Stored ``rows`` with their number ``_row`` and their ``_text``: the other columns and ``group``, the number of a row of the group."""
    grouped = minhash.group(rows, width, percent, printed=True).drop("n_shingles")
    return grouped.withColumn("group", F.coalesce("group", F.lit(EMPTY).cast("long")))
