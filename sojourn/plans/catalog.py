"""All registered queries; importing the parts fills the registry."""

from __future__ import annotations

from sojourn.plans import catalog_context, catalog_ingest, catalog_scenario, catalog_trace  # noqa: F401
from sojourn.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
