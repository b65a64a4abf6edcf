"""Composite pipelines and the registered queries."""

from versewise.plans import aligned, annotated, bound, frames, judged, measures, rules, scans, streamed, texts, timelines  # noqa: F401  (they register their queries)
from versewise.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
