"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

GROUPS = ("trends", "places", "texts", "networks", "scores", "reviews", "roles", "stores", "streams", "ordered", "lookups")


def registered() -> dict:
    """name -> (callable(spark, folder), SQL or None)."""
    out: dict = {}
    for group in GROUPS:
        module = importlib.import_module(f"{__name__}.{group}")
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query names registered twice: {sorted(clash)}")
        out.update(module.QUERIES)
    return out
