"""Loads every module that registers queries."""

from __future__ import annotations

import importlib

from featlake.plans import registry

_MODULES = ("features", "shapes", "describing", "access", "records", "events", "files")


def load():
    for name in _MODULES:
        importlib.import_module(f"featlake.plans.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
