"""Registered queries, each with the SQL that states the same result."""

from __future__ import annotations

import importlib

MODULES = ("texts", "bindings", "ledgers", "gating", "styles", "webs", "archives", "templating", "streams")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"provena.plans.{name}")
