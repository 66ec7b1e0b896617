"""All queries of the library, by family."""

from __future__ import annotations

import importlib

from tessera.plans import Catalog

FAMILIES = (
    "tessera.operators.search",
    "tessera.operators.positions",
    "tessera.operators.catalogue",
    "tessera.operators.aggregates",
    "tessera.operators.linking",
    "tessera.operators.sequences",
    "tessera.operators.graph",
    "tessera.operators.failures",
    "tessera.operators.paths",
    "tessera.operators.walks",
    "tessera.operators.quality",
    "tessera.operators.series",
    "tessera.streaming.monitors",
    "tessera.streaming.timeouts",
    "tessera.sources.export",
    "tessera.sources.log",
)


def build() -> Catalog:
    found = Catalog()
    for name in FAMILIES:
        found.merge(importlib.import_module(name).catalog)
    return found
