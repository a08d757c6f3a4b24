"""Queries over the driver's tables, one per operator, with their SQL."""

from leafwright.plans import claim_queries, form_queries, intake_queries, page_queries, queries, raster_queries, run_queries  # noqa: F401  (all fill the same tables of queries)
