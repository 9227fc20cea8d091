"""All queries of the core with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirelake.plans import analyses, capabilities, dashboards, details, labelled, packed_fields, resolution, searches, states

FLAGSHIP = "cap_count_by_area"
_PARTS = (capabilities, dashboards, details, searches, resolution, analyses, labelled, states)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = dict(packed_fields.QUERIES)
    for p in _PARTS:
        out |= p.register.queries
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for p in _PARTS:
        out |= p.register.sql
    return out
