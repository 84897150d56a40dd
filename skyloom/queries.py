"""All registered queries of the catalog engine."""

from __future__ import annotations

from .registry import ORACLE, QUERIES
from .workload import details, events, files, frames, history, images, matching, orders, planning, sky, storage, streams, texts

__all__ = ["ORACLE", "QUERIES", "details", "events", "files", "frames", "history", "images", "matching", "orders", "planning", "sky", "storage", "streams", "texts"]
