"""All registered queries of the document operators."""

from lexmill.plans import page_queries, table_queries, text_queries  # noqa: F401  they register on import
from lexmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
