"""Queries over the driver tables, each with its SQL equivalent where SQL can say it."""

from __future__ import annotations

from slabspark.registry import catalogue, evaluation, grading, operations, scans, search, texts, training  # noqa: F401
from slabspark.registry.core import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
