"""The one join of reviews and items, pre-aggregated.

Every report is a COUNT / SUM over ``reviews JOIN items`` grouped by item
attributes (category, brand, title) and a time bucket (year, month).  So the
reviews are first reduced to one row per (asin, year, week_year, month) with
``n`` reviews and ``pos`` positives (partial aggregation map-side, so a hot
asin holding a third of all reviews becomes a handful of rows before the
shuffle).  Items are reduced to one row per (asin, title, brand, main_cat)
with the number of ``copies``.  The join multiplies by copies, which keeps the
row multiplicity of the row-level join exactly:

* the known-items join repeats a review once per metadata row of its asin
  (k = total copies of the asin), and
* the report join repeats it once more per metadata row (copies).

So a review counts ``copies * k`` times (``parity=True``, the application's
behaviour) or ``copies`` times (``parity=False``: known-items as a semi join).
The join input is now proportional to distinct items, not to reviews, and no
pair of rows within a group is ever emitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.scalars import calendar_year, month_of_year, week_year

FACT_KEYS = ("asin", "title", "brand", "main_cat", "year", "week_year", "month")


def review_stats(scored: DataFrame) -> DataFrame:
    """(asin, year, week_year, month) -> n reviews, pos = sum(sentiment)."""
    return (scored
            .groupBy("asin",
                     calendar_year("unix_time").alias("year"),
                     week_year("unix_time").alias("week_year"),
                     month_of_year("unix_time").alias("month"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.col("sentiment").cast("bigint")).alias("pos")))


def item_weights(items: DataFrame, parity: bool = True) -> DataFrame:
    """(asin, title, brand, main_cat) -> weight each review of the asin gets, and ``k``, how
    often the known-items join yields it."""
    # Group first: the map-side partial count collapses the copies of an
    # asin before any shuffle (an asin listed a million times moves as one
    # row per map task).  The window then sees one row per distinct
    # (asin, title, brand, main_cat), a handful per asin.
    grouped = (items.select("asin", "title", "brand", "main_cat")
               .groupBy("asin", "title", "brand", "main_cat")
               .agg(F.count(F.lit(1)).alias("copies")))
    k = F.sum("copies").over(Window.partitionBy("asin"))
    if not parity:
        return grouped.select("asin", "title", "brand", "main_cat", F.col("copies").alias("weight"),
                              F.lit(1).cast("bigint").alias("k"))
    return grouped.select("asin", "title", "brand", "main_cat",
                          (F.col("copies") * k).alias("weight"), k.alias("k"))


def build_fact(items: DataFrame, scored: DataFrame, parity: bool = True) -> DataFrame:
    """Items x scored reviews, one row per (item group, time bucket).

    ``items``: clean metadata (asin, title, brand, main_cat, ...).
    ``scored``: clean reviews with asin, unix_time and int ``sentiment``;
    reviews of unknown items drop out in the join, as in the known-items join.
    """
    return join_fact(review_stats(scored), item_weights(items, parity))


def join_fact(stats: DataFrame, weights: DataFrame, with_reviews: bool = False) -> DataFrame:
    """``review_stats`` x ``item_weights`` on asin, counts multiplied by weight.

    ``with_reviews=True`` adds ``reviews``, n * k on exactly one row per stats
    row, so ``sum(reviews)`` is the number of rows of the known-items join
    without another pass.
    """
    weighted = [(F.col("n") * F.col("weight")).alias("n"),
                (F.col("pos") * F.col("weight")).alias("pos")]
    if not with_reviews:
        return stats.join(weights, "asin").select(*FACT_KEYS, *weighted)
    by_asin = Window.partitionBy("asin").orderBy("title", "brand", "main_cat")
    flagged = weights.withColumn("_first", F.row_number().over(by_asin) == 1)
    carried = F.when(F.col("_first"), F.col("n") * F.col("k")).otherwise(F.lit(0))
    return stats.join(flagged, "asin").select(*FACT_KEYS, *weighted, carried.cast("bigint").alias("reviews"))
