"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import analytics, conversations, documents, evaluation, ingest, records, reports, requests, streams, vectors
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "FLAGSHIP", "analytics", "conversations", "documents", "evaluation", "ingest", "records", "reports", "requests", "streams", "vectors"]

FLAGSHIP = "validate_route"
