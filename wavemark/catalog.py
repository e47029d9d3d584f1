"""Every query of the library with its oracle SQL."""

from .plans import marker_queries, sample_queries, scalar_queries, signal_queries  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
