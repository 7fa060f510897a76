"""Registered plans, grouped by subject."""

from __future__ import annotations

import importlib

_MODULES = (
    "calibration scoring decisions evidence promotion priors callgraph imports ledger "
    "recall experiment ranking storage streams"
).split()


def _load():
    from oddsmith.plans import catalog

    for m in _MODULES:
        importlib.import_module(f"oddsmith.plans.{m}")
    return catalog


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
