"""Imports every query module, which registers its queries."""

from tracelab.plans import cell_queries, curve_queries, feature_queries, model_queries, score_queries, text_queries  # noqa: F401
from tracelab.plans.registry import ORACLES, QUERIES  # noqa: F401
