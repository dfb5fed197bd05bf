"""All registered queries with their SQL texts."""

from __future__ import annotations

from importlib import import_module

AREAS = ("cleaning", "grouped", "encoding", "chains", "scored", "fitted", "reported")


def all_queries() -> dict:
    out: dict = {}
    for area in AREAS:
        out |= import_module(f"seqlytics.plans.{area}").QUERIES
    return out
