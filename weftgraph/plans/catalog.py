"""All registered queries over the driver's tables."""

from __future__ import annotations

from weftgraph.plans import catalog_events, catalog_filters, catalog_matches, catalog_state, catalog_store, catalog_streams, catalog_user  # noqa: F401
from weftgraph.plans.registry import ORACLES, QUERIES  # noqa: F401
