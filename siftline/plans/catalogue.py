"""All core queries by name, and their SQL."""

from __future__ import annotations

from siftline.plans import data_queries, frame_queries, search_queries

MODULES = (data_queries, search_queries, frame_queries)


def flagship(spark, d):
    return data_queries.p3_found(spark, d)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
