"""A stored layout for the reports' join: bucketed by asin, so that it needs no shuffle.

``add_reviews`` reduces scored reviews to one row per (asin, time bucket) and
appends them; ``replace_items`` stores the item weights.  Both tables have the
same buckets of ``asin``, so ``fact`` groups and joins them bucket by bucket,
without moving a row.  Counts are additive, so new reviews are added without
touching the old ones; an asin with a third of all reviews is a few rows a batch.

The tables are external ones below ``spark.checkpoint.dir``; the session's
catalog knows their buckets.  A bucket is one task: ``buckets`` should grow with
the items.  ``compact`` merges the batches into one file a bucket.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.fact import item_weights, join_fact, review_stats
from reviewlens.session import shared_path

BUCKETS = 64
ITEMS_PER_BUCKET = 8192
STATS_KEYS = ("asin", "year", "week_year", "month")


def buckets_for(items: DataFrame, least: int = 1) -> int:
    """How many buckets keep a bucket's items, and so the memory of its task, the same however many items there are."""
    return max(least, math.ceil(items.count() / ITEMS_PER_BUCKET))


class ReviewStore:
    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.stats_table, self.items_table = f"{name}_stats", f"{name}_items"

    def _write(self, df: DataFrame, table: str, mode: str, folder: str | None = None) -> None:
        writer = (df.repartition(self.buckets, "asin").write.mode(mode).format("parquet")
                  .bucketBy(self.buckets, "asin").sortBy("asin"))
        if folder:
            writer = writer.option("path", folder)
        writer.saveAsTable(table)

    def _stats(self) -> DataFrame:
        return (self.spark.table(self.stats_table).groupBy(*STATS_KEYS)
                .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))

    def add_reviews(self, scored: DataFrame) -> None:
        """Add clean reviews with an int ``sentiment``."""
        new = not self.spark.catalog.tableExists(self.stats_table)
        folder = shared_path(self.spark, self.stats_table) if new else None
        self._write(review_stats(scored), self.stats_table, "append", folder)

    def replace_items(self, items: DataFrame, parity: bool = True) -> None:
        """The clean items of the join; the old ones stay until the new are written."""
        made = f"{self.items_table}_{uuid.uuid4().hex[:8]}"
        self._write(item_weights(items, parity), made, "errorifexists", shared_path(self.spark, made))
        self.spark.sql(f"DROP TABLE IF EXISTS {self.items_table}")
        self.spark.sql(f"ALTER TABLE {made} RENAME TO {self.items_table}")

    def compact(self) -> None:
        """One row per (asin, time bucket), one file a bucket."""
        made = f"{self.stats_table}_{uuid.uuid4().hex[:8]}"
        self._write(self._stats(), made, "errorifexists", shared_path(self.spark, made))
        self.spark.sql(f"DROP TABLE {self.stats_table}")
        self.spark.sql(f"ALTER TABLE {made} RENAME TO {self.stats_table}")

    def fact(self) -> DataFrame:
        """What ``build_fact`` gives for all reviews added and the items."""
        return join_fact(self._stats(), self.spark.table(self.items_table))
