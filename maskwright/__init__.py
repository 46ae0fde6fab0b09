"""Finding, removing and learning to find personal data in text tables, on Spark."""

from maskwright.plans.redaction import entity_totals, find, redact_documents
from maskwright.session import get_session
from maskwright.sources.catalog import Catalog, default_catalog, load_catalog

__all__ = ["Catalog", "default_catalog", "entity_totals", "find", "get_session", "load_catalog", "redact_documents"]
