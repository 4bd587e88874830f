"""Registered queries of the reading-level engine."""

from __future__ import annotations

from storyscale.plans import evaluation, files, texts
from storyscale.plans.query import QUERIES

__all__ = ["QUERIES", "evaluation", "files", "texts"]
