"""All registered queries of the engine, without those of the training-data operators."""

from __future__ import annotations

from .catalog import derived, documents, evaluation, evidence, facts, feeds, grid, kept, messages, people, profiles, python_functions, retrieval, schedules, streams, text_tools, timelines, vector_cells  # noqa: F401
from .catalog.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
