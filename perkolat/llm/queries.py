"""All queries of this package and their SQL."""

from . import contentstore, decontaminate, htmltext, linededup, lm, mixing, quality, sharding, simhash, toxicity

MODULES = (decontaminate, mixing, linededup, contentstore, htmltext, lm, quality, toxicity, simhash, sharding)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
