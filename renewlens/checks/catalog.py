"""All registered queries."""

from renewlens.checks import (  # noqa: F401
    queries_clean,
    queries_features,
    queries_model,
    queries_profile,
    queries_stats,
)
from renewlens.checks.registry import QUERIES

__all__ = ["QUERIES"]
