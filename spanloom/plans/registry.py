"""All queries by name. The subpackage ``llm`` is optional: ``__spark_entry__`` adds it."""

from __future__ import annotations

from . import corpus, evaluation, learning, records, streams, traces

MODULES = [records, traces, corpus, evaluation, learning, streams]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}
