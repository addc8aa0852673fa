"""Import every query module so that the registry is complete."""

from signalmill.plans import queries_control, queries_core, queries_live, queries_multivariate, queries_patterns, queries_profile, queries_relate  # noqa: F401
from signalmill.plans.registry import QUERIES, SQL, Tables, run  # noqa: F401
