"""All queries of the library but those of optional subpackages."""

from __future__ import annotations

from sparkloom.plans import corpus, relational, scoring, structure
from sparkloom.plans.base import Query

_PARTS = (corpus.plans, scoring.plans, structure.plans, relational.plans)


def queries() -> dict[str, Query]:
    return {name: query for part in _PARTS for name, query in part.queries.items()}


def oracle() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle.items()}
