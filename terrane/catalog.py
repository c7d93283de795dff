"""All queries of the analytics engine, by name, with the SQL that checks them."""

from __future__ import annotations

from terrane.plans import areas, coverage, documents, evaluation, layers, network, procedural, questions, representations, routes, rules, spatial, store, twin, upkeep, views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _plan in (evaluation, spatial, network, procedural, store, coverage, views, rules, routes, layers, representations, areas, twin, documents, upkeep, questions):
    QUERIES |= _plan.QUERIES
    ORACLE |= _plan.ORACLE
