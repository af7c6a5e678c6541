"""Registered queries: each runs a library function and states the same result in SQL."""

from __future__ import annotations

from importlib import import_module

from bizpanel.checks.registry import CHECKS, Check

MODULES = ("sources", "relational", "scalars", "reports")


def all_checks() -> dict[str, Check]:
    """Every registered query by name."""
    for module in MODULES:
        import_module(f"bizpanel.checks.{module}")
    return CHECKS
