"""All registered queries."""

from lorekeep.plans import q_active, q_eval, q_graph, q_history, q_hygiene, q_plugs, q_retrieval, q_rollups, q_similarity, q_sources, q_streaming  # noqa: F401
from lorekeep.plans.registry import ORACLES, QUERIES  # noqa: F401
