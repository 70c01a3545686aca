"""Schemas, loaders, the enriched star join, sinks and table adapters."""

from shelfwise.sources.tables import (
    enrich,
    load_customers,
    load_enriched,
    load_products,
    load_transactions,
    with_calendar,
)

__all__ = [
    "enrich",
    "load_customers",
    "load_enriched",
    "load_products",
    "load_transactions",
    "with_calendar",
]
