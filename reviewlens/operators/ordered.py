"""Prefix sums in a global order without a single-task window.

A window ordered over a whole table runs in one task.  Instead the rows are
cut into value ranges at approximate quantiles, each range is summed in its own
task, and the range totals (one small row each) are summed up in order to give
each range its offset.  The cuts are a one-row aggregate within the plan:
building it runs no job, and nothing passes through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.session import shared_path


def prefix_sums(df: DataFrame, order_col: str, cols: list[str], buckets: int | None = None,
                accuracy: int = 10_000) -> DataFrame:
    """Add ``<c>_before``: the sum of integral ``c`` over rows strictly earlier,
    and ``<c>_total``, the sum over all, in the ascending order of ``order_col`` (NULLs excluded, NaN after every
    number).  ``order_col`` values should be distinct (aggregate by it first),
    which keeps the ranges balanced.  There are as many ranges as shuffle
    partitions unless ``buckets`` says otherwise."""
    if buckets is None:
        buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    v = F.col(order_col).cast("double")
    data = df.where(v.isNotNull()).withColumn("_v", v)
    qs = [i / buckets for i in range(1, buckets)]
    if qs:
        # a value's range is the number of cuts below it, found in two steps:
        # among every ``step``-th cut, then among the ``step`` cuts there
        step = max(1, math.isqrt(len(qs)))
        none = F.array().cast("array<double>")
        cuts = data.where(~F.isnan("_v")).select(F.coalesce(F.percentile_approx("_v", qs, accuracy), none).alias("c"))
        cuts = cuts.select(F.struct("c", F.filter("c", lambda c, i: i % step == 0).alias("coarse"))).scalar()
        data = data.withColumn("_cuts", cuts).withColumn(
            "_coarse", F.size(F.filter("_cuts.coarse", lambda c: c < F.col("_v"))))
        start = F.greatest(F.lit(0), (F.col("_coarse") - 1) * step)
        data = data.withColumn("_b", start + F.size(F.filter(
            F.slice("_cuts.c", start + 1, F.lit(step)), lambda c: c < F.col("_v")))).drop("_cuts", "_coarse")
    else:
        data = data.withColumn("_b", F.lit(0))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = data.groupBy("_b").agg(*[F.sum(c).cast("bigint").alias(f"_t_{c}") for c in cols])
    # one row per range: a running sum over them is small whatever the table
    whole = earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}")
                                    for c in cols], *[F.sum(f"_t_{c}").over(whole).alias(f"{c}_total") for c in cols])
    within = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    out = data.join(F.broadcast(offsets), "_b")
    for c in cols:
        out = out.withColumn(f"{c}_before",
                             F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return out.drop("_v", "_b", *[f"_o_{c}" for c in cols])


def numbered(df: DataFrame, order: list[Column], column: str = "id") -> DataFrame:
    """``df`` with each row's number, from 0, in the order of ``order``.

    The rows are range-sorted and written to the shared folder, so that a
    partition is what it was when it is read again; a row's number is its place
    in its partition and the rows of the partitions before it (one row a
    partition).  ``order`` should tell all rows apart.
    """
    spark = df.sparkSession
    path = shared_path(spark, "numbered")
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .withColumn("_at", F.monotonically_increasing_id()).write.parquet(path))
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count("*").alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = F.col("_at") - F.shiftleft("_part", 33)
    return (placed.join(F.broadcast(offsets), "_part").withColumn(column, F.col("_before") + inside)
            .select(*df.columns, column))
