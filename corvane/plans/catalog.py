"""Queries of the engine by name, with the SQL that a second engine can check them with."""

from __future__ import annotations

from corvane.plans import catalogue, files, frames, matches, measured, naming, ordered, packs, records, rules, series, verdicts  # noqa: F401
from corvane.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
