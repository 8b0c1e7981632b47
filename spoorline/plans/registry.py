"""Queries of the track operators and the SQL that gives the same rows."""

from __future__ import annotations

from . import geometry, images, scoring

ALL = {**scoring.QUERIES, **geometry.QUERIES, **images.QUERIES}


def queries() -> dict:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
