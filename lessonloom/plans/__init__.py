"""Registered queries of the practice domain and their oracles."""

from lessonloom.plans import compositions, progress, tables, texts  # noqa: F401  (they register themselves)
from lessonloom.plans.frames import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
