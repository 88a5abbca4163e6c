"""Parallelism for CPU-heavy steps.

Text featurisation and scoring cost far more per byte than scanning.  By
default the file splits of the input decide how many tasks do that work; a
caller whose input is one unsplittable file names a number of ``partitions``,
which costs one round-robin shuffle; ``text_partitions`` finds one that grows with
the texts, so that what a task holds does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_BYTES = 8 << 20      # of text that a task featurises; its features are several times as large


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    return df.repartition(partitions) if partitions else df


def text_partitions(texts: DataFrame, text_col: str = "text") -> int:
    """One partition for every ``TEXT_BYTES`` of text, at least one a core (a job that adds up their lengths)."""
    size = texts.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_BYTES))
