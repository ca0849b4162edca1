"""Registry of the queries on the territory operators, each beside its SQL for the oracle."""

from __future__ import annotations

import functools

from terrane.plans import aggregates, containment, files, graphs, landmarks, ownership, rebuilt, records, rules, scenarios, scores, sources, streams, text_geometry
from terrane.session import measured_joins

MODULES = (containment, ownership, aggregates, rules, scenarios, text_geometry, files, streams, graphs, landmarks, scores, records, sources, rebuilt)


def _measured(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        return query(measured_joins(spark), sf_dir)

    return run


def queries() -> dict:
    return {name: _measured(q) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
