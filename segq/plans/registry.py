"""All queries of the engine and their oracle SQL."""

from __future__ import annotations

import importlib

from segq.plans.core import oracle_texts, spark_queries

MODULES = ("duplicates", "memory", "terms", "scoring", "routing", "cost", "qa", "issues", "consistency", "approval", "glossary", "text_rules", "dml", "pages", "filters", "report", "scalars", "etl", "mutations")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"segq.operators.{name}")


def queries():
    _load()
    from segq.operators.calls import queries as calls
    from segq.operators.providers import queries as providers
    from segq.sources.queries import queries as sources
    from segq.sources.state_queries import queries as states
    from segq.streaming.queries import queries as streams

    return spark_queries() | providers() | calls() | sources() | states() | streams()


def oracle_sql():
    _load()
    from segq.operators.calls import oracle_sql as calls
    from segq.operators.providers import oracle_sql as providers
    from segq.sources.queries import oracle_sql as sources
    from segq.sources.state_queries import oracle_sql as states
    from segq.streaming.queries import oracle_sql as streams

    return oracle_texts() | providers() | calls() | sources() | states() | streams()
