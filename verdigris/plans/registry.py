"""All registered queries of the library, with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdigris.plans import aggregates, base, composites, decisions, filters, joins, sampling, scalars, sets, sources, streams, windows  # noqa: F401

FLAGSHIP = "j01_accepted_by_category"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
