"""All registered queries and their checking SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("telemetry", "sets", "reconcile", "credentials", "dump", "survey", "config", "probe", "inventory")


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        for key, value in getattr(import_module(f"siteferry.plans.queries_{module}"), name).items():
            if key in found:
                raise ValueError(f"{key} is registered twice")
            found[key] = value
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
