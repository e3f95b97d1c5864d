"""All queries of the engine by name, and their SQL."""

from quadrille.plans import q_analysis, q_clean, q_grid, q_merge, q_more, q_parts, q_stream, q_views
from quadrille.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "q_analysis", "q_clean", "q_grid", "q_merge", "q_more", "q_parts", "q_stream", "q_views"]
