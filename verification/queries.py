"""Collects the registered queries of all parts."""

from verification import q_claims, q_records, q_retrieval, q_structure, q_text  # noqa: F401
from verification.registry import QUERIES

__all__ = ["QUERIES"]
