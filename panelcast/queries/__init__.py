from panelcast.queries import q_catalog, q_explore, q_features, q_models, q_panel, q_profile, q_scores  # noqa: F401
from panelcast.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
