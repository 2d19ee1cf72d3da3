"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = ["flagship", "encoding", "joining", "aggregating", "windows", "betting", "reports", "statistics", "scoring", "audits", "files", "learning", "streams", "flows"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"formline.plans.{name}")
