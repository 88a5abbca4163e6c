"""Metadata and review clean-up, and the known-items join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.scalars import date_to_epoch, price_to_float, rank_to_long
from reviewlens.schemas import EXCLUDED_CATEGORIES

ITEM_REQUIRED = ("asin", "title", "main_cat", "brand")
REVIEW_REQUIRED = ("reviewerID", "asin", "reviewText")
REVIEW_RENAMES = {"reviewerID": "rid", "reviewText": "review_text", "unixReviewTime": "unix_time"}


def all_not_null(*cols: str):
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def filter_items(raw: DataFrame, excluded=EXCLUDED_CATEGORIES) -> DataFrame:
    """Rows with asin, title, main_cat and brand present, outside the excluded
    categories.  Empty strings are values, not missing."""
    keep = all_not_null(*ITEM_REQUIRED)
    if excluded:
        keep = keep & ~F.col("main_cat").isin(*excluded)
    return raw.where(keep)


def clean_items(raw: DataFrame, excluded=EXCLUDED_CATEGORIES) -> DataFrame:
    """Filtered metadata with price, date and rank parsed.

    Output order: the raw columns without price/date/rank, then ``price``
    (float), ``unixTime`` (double epoch seconds) and ``rank`` (long); -1 marks
    unparsable text.
    """
    kept = filter_items(raw, excluded)
    carried = [c for c in kept.columns if c not in ("price", "date", "rank")]
    return kept.select(
        *carried,
        price_to_float("price").alias("price"),
        date_to_epoch("date").alias("unixTime"),
        rank_to_long("rank").alias("rank"))


def clean_reviews(raw: DataFrame) -> DataFrame:
    """Reviews with reviewer, item and text present (time may be NULL),
    renamed to rid / review_text / unix_time.  Other columns pass through."""
    return raw.where(all_not_null(*REVIEW_REQUIRED)).withColumnsRenamed(REVIEW_RENAMES)


def known_items(reviews: DataFrame, items: DataFrame, semi: bool = False) -> DataFrame:
    """Reviews of items present in the metadata.

    ``semi=False`` is an inner join on the raw id list, so an asin listed k
    times repeats each of its reviews k times (what the application does);
    ``semi=True`` keeps each review once.
    """
    ids = items.select(F.col("asin").alias("id"))
    if semi:
        return reviews.join(ids, reviews["asin"] == ids["id"], "left_semi")
    return reviews.join(ids, reviews["asin"] == ids["id"]).drop("id")
