"""The registered queries."""

from isohyet.plans import analysis_queries, column_queries, cycle_queries, field_queries, impact_queries, queries, source_queries, volume_queries  # noqa: F401  (they register themselves)
from isohyet.plans.registry import ORACLES, QUERIES  # noqa: F401
