"""Registered queries over the driver's tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ingestion", "tables", "quality_checks", "stress_index", "forecasting", "documents", "live")


def all_queries() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"furrow.plans.{name}")
