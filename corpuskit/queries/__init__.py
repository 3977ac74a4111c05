"""Registered queries: each area module holds ``QUERIES`` = name -> (function, oracle SQL or None)."""

from __future__ import annotations

import importlib

AREAS = ("corpus", "search", "resolve", "texts", "forms", "native")


def registry() -> dict:
    out: dict = {}
    for area in AREAS:
        for name, pair in importlib.import_module(f"corpuskit.queries.{area}").QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} registered twice")
            out[name] = pair
    return out
