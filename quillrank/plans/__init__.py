"""Registered queries over the driver tables, by area."""

from __future__ import annotations

import importlib

AREAS = ("text", "retrieval", "labels", "business", "traces", "sources")


def load():
    """(queries, oracles) of every area."""
    from quillrank.plans import registry

    for area in AREAS:
        importlib.import_module(f"quillrank.plans.{area}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
