"""Operators for training data. Nothing outside this package imports it.

The catalogue is imported here, so that where one of its libraries is missing the import of this
package fails, and with it nothing else."""

from __future__ import annotations

from tidemark.llm import catalogue


def queries() -> dict:
    return dict(catalogue.QUERIES)


def oracles() -> dict[str, str]:
    return dict(catalogue.ORACLES)
