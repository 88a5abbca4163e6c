"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver tables of ``sf_dir`` (or files Spark writes from
them) in full; limits appear only where a top-k list is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from reviewlens.plans import input_queries, ml_queries, report_queries  # noqa: F401
    return dict(QUERIES)
