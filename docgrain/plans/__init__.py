"""Registered queries: each pairs a Spark job over the given tables with the same result in SQL."""

from __future__ import annotations

from . import blocks, fields, history, quality, refinement, reviews, streams, uploads
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
_MODULES = (blocks, fields, history, quality, refinement, reviews, streams, uploads)
