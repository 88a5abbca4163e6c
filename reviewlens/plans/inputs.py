"""Shared report inputs built from the driver tables of one scale factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlens.operators.cleanup import clean_reviews, filter_items
from reviewlens.operators.fact import build_fact
from reviewlens.operators.reports import brand_sentiment, product_sentiment
from reviewlens.operators.sentiment import label_sentiment, observed_sentiment
from reviewlens.sources.tables import items_from_parts, raw_reviews_from_tables, table


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_items(items_from_parts(table(spark, sf_dir, "part")))


def reviews(spark: SparkSession, sf_dir: str, blank_text_every: int | None = None) -> DataFrame:
    """Clean reviews (rid, asin, review_text, unix_time, outcome, doc_id...)."""
    raw = raw_reviews_from_tables(table(spark, sf_dir, "lineitem"),
                                  table(spark, sf_dir, "orders"),
                                  table(spark, sf_dir, "documents"),
                                  blank_text_every=blank_text_every)
    return clean_reviews(raw)


def scored(spark: SparkSession, sf_dir: str, provider: str = "observed") -> DataFrame:
    r = reviews(spark, sf_dir)
    if provider == "observed":
        return observed_sentiment(r)
    if provider == "labels":
        return label_sentiment(r, table(spark, sf_dir, "labels"))
    raise ValueError(f"unknown sentiment provider {provider!r}")


def fact(spark: SparkSession, sf_dir: str, provider: str = "observed",
         parity: bool = True) -> DataFrame:
    return build_fact(items(spark, sf_dir), scored(spark, sf_dir, provider), parity=parity)


def brand_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_sentiment(fact(spark, sf_dir))


def product_report_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_sentiment(fact(spark, sf_dir))
