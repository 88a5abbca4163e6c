"""File sources with declared schemas (no inference pass over the data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.schemas import METADATA_SCHEMA, REVIEW_SCHEMA, TRAINING_SCHEMA


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Product metadata, JSON lines.  Malformed lines become all-null rows
    (PERMISSIVE) and are dropped by the clean-up's not-null filters."""
    return spark.read.schema(METADATA_SCHEMA).option("mode", "PERMISSIVE").json(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews, JSON lines, declared schema."""
    return spark.read.schema(REVIEW_SCHEMA).option("mode", "PERMISSIVE").json(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Training text: TSV, no header, quoted fields, blanks trimmed.

    The label arrives as text and is cast with ``try_cast``: ``true``/``false``
    and ``1``/``0`` become booleans, anything else NULL (rows kept).
    """
    raw = (spark.read.schema(TRAINING_SCHEMA)
           .option("sep", "\t").option("header", False)
           .option("quote", '"').option("escape", '"')
           .option("ignoreLeadingWhiteSpace", True)
           .option("ignoreTrailingWhiteSpace", True)
           .csv(path))
    return raw.select("text", F.trim("sentiment").try_cast("boolean").alias("sentiment"))
