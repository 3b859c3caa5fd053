"""Registered queries over views derived from the driver's tables."""

import importlib
import pkgutil


def _load():
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")


def all_queries():
    from workload.registry import QUERIES
    _load()
    return dict(QUERIES)


def all_oracles():
    from workload.registry import ORACLES
    _load()
    return dict(ORACLES)
