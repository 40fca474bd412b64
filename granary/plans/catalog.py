"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from . import documents, evaluation, graph, indexed, ingest, lexical, links, relational, retrieval, review, similarity, textual, themes, usage  # noqa: F401  registers the queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
