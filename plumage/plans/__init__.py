"""Named queries over the operators."""

from __future__ import annotations

import importlib

from plumage.plans.registry import Registry

#: Modules with a ``reg``, in the order of registration.
MODULES = ["corpus", "users", "annotation", "models", "spread"]


def all_queries() -> Registry:
    out = Registry()
    for name in MODULES:
        out.include(importlib.import_module(f"plumage.plans.{name}").reg)
    return out
