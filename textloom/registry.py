"""All registered queries outside the training-data subpackage."""

from __future__ import annotations

from .operators import analyze, chat, mixing, preference, records, validate
from .plans import pages
from .streaming import queries as streams

MODULES = (analyze, validate, records, preference, mixing, chat, pages, streams)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
