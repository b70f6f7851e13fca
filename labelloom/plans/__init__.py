"""Registered queries: operators wired to the given tables, each with its SQL twin."""

from labelloom.plans import (  # noqa: F401  (importing registers the queries)
    features, labels, model_reports, models, reports, splits, statistics, tables_io, text,
)
from labelloom.plans.registry import oracles, registered

__all__ = ["oracles", "registered"]
