"""All queries on the embedding and star-schema tables, with their SQL."""

from __future__ import annotations

from . import on_tables, on_vectors, registry


def flagship(spark, sf_dir):
    return on_vectors.screen_by_label(spark, sf_dir)


def queries():
    assert on_tables and on_vectors
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
