"""The queries of this subpackage and the SQL that checks them."""

from . import decontaminate, kneser_ney, language, near_dup, packing, pii, quality, sharding, topk, toxicity

_MODULES = (pii, near_dup, quality, sharding, toxicity, kneser_ney, packing, language, topk, decontaminate)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
