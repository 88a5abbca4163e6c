"""Report tables: replace, read back, key assertions.

A report replaces its table as a whole, written by the executors (no collect
to the driver).  A Parquet table is a folder of versions and a small log of
them: a replacement is written to a fresh version folder, its keys are checked,
and only then its name is appended to the log, so readers see the old table or
the new one and a write that fails changes nothing.  ``jdbc.py`` does the same
in a database.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "number bigint, folder string"


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_LOG).parquet(f"{path}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def replace_table(df: DataFrame, path: str, keys: Sequence[str] = ()) -> int:
    """Make ``df`` the table at ``path``; returns how many rows were left out.

    With ``keys`` the table has a primary key: rows with a NULL in it are left
    out, and duplicates fail the replacement, the old table staying in place.
    """
    spark = df.sparkSession
    log = _versions(spark, path)
    number = 0 if log is None else 1 + (log.agg(F.max("number")).first()[0] or 0)
    folder = f"{path}/v{number}-{uuid.uuid4().hex[:12]}"
    dropped = 0
    if keys:
        df.write.parquet(f"{folder}-unchecked")
        made = spark.read.schema(df.schema).parquet(f"{folder}-unchecked")
        check = key_check(made.dropna(subset=list(keys)), keys).first()
        if check["duplicate_keys"]:
            raise ValueError(f"{path}: {check['duplicate_keys']} rows repeat a key of {tuple(keys)}")
        dropped = made.count() - check["rows"]
        if dropped:
            made.dropna(subset=list(keys)).write.parquet(folder)
        else:
            folder = f"{folder}-unchecked"
    else:
        df.write.parquet(folder)
    (spark.createDataFrame([(number, folder)], _LOG).coalesce(1)
     .write.mode("append").parquet(f"{path}/versions"))
    return dropped


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of the table at ``path``."""
    log = _versions(spark, path)
    if log is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(log.agg(F.max_by("folder", "number")).first()[0])


def key_check(df: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """One row: ``rows``, ``null_keys`` (rows with a NULL key column) and
    ``duplicate_keys`` (rows beyond the first per key).  A primary key holds
    when both are 0."""
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0).cast("bigint")).alias("rows"),
        F.coalesce(F.sum(F.when(any_null, F.col("c"))), F.lit(0).cast("bigint")).alias("null_keys"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0).cast("bigint")).alias("duplicate_keys"))
