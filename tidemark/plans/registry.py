"""All queries of the core, by name."""

from __future__ import annotations

from tidemark.plans import extras, known, models, panels, reports, study, texts

MODULES = (known, study, reports, panels, texts, extras, models)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
