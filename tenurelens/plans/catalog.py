"""All registered queries; importing this module fills the registry."""
from tenurelens.plans import decision_queries, feature_queries, model_queries, quality_queries, survival_queries  # noqa: F401
from tenurelens.plans.registry import ORACLE, QUERIES  # noqa: F401
