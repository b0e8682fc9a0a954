"""All registered queries and their SQL."""

from corpusflow.plans import catalog_corpus, catalog_rows, catalog_scoring, catalog_state  # noqa: F401
from corpusflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
