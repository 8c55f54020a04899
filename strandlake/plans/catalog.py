"""Registered queries of the engine's own operators and their SQL counterparts."""

from strandlake.plans import sequence_queries, structure_queries  # noqa: F401
from strandlake.plans.registry import ORACLES, QUERIES  # noqa: F401
