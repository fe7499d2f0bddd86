"""All registered queries."""

from workload import checks, cleaning, files, responses  # noqa: F401
from workload.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
