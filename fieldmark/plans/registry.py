"""Named queries over the bound tables, and the SQL each must agree with."""

from __future__ import annotations

from fieldmark.plans import challenger_queries, checklist_queries, event_queries, habitat_queries, ingest_queries, model_queries, nested_queries, place_queries, prior_queries, record_queries, split_queries, stream_queries  # noqa: F401  (all fill the same tables)


def queries() -> dict:
    return dict(checklist_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(checklist_queries.SQL)
