"""All cases in one place."""

from __future__ import annotations

from cases import clinical, funnel, money, scalars

MODULES = (money, clinical, funnel, scalars)


def queries():
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql():
    return {name: sql.strip() for m in MODULES for name, sql in m.ORACLE.items()}
