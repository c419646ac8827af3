"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from loam.llm import decontaminate, html, langid, licences, mixing, neighbours, repeats, sharding, simhash, warc

MODULES = [mixing, html, langid, simhash, neighbours, sharding, decontaminate, warc, licences, repeats]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()} | corpus_pipeline.QUERIES


def oracle_sql() -> dict[str, str]:
    found = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
