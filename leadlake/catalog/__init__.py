"""Registered queries over the driver tables, each with an equivalent DuckDB statement."""

from leadlake.catalog.core import ORACLES, QUERIES  # noqa: F401
from leadlake.catalog import (  # noqa: F401
    analytics_q, discovery_q, enrich_q, intake_q, messaging_q, outreach_q, quality_q, sources_q, streams_q,
)
