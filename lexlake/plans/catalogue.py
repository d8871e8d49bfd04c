"""All named queries over the engine's operators, and the same in SQL."""

from __future__ import annotations

from . import browse, changes, ingest, readers, records, reports, service, texts, upkeep  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "browse_filtered_page"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
