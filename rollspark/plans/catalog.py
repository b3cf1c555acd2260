"""All registered queries."""

from rollspark.plans import ingest_queries, scoring_queries, text_queries, token_queries  # noqa: F401
from rollspark.plans.registry import QUERIES  # noqa: F401
