"""Declared schemas of the inputs and of the six reports.

Schemas are always declared, never inferred: a JSON or TSV scan with a given
schema needs no inference pass over the data.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the source application's for equal results.
# ---------------------------------------------------------------------------
EXCLUDED_CATEGORIES = ("Grocery", "Pet Supplies", "Baby", "Books",
                       "Appstore for Android", "Gift Cards")
BRAND_MIN_REVIEWS = 2000
PRODUCT_MIN_REVIEWS = 100
RANKING_SIZE = 20
TOP_BRANDS = 10
SAMPLE_LINES = 1000
MODEL_SEED = 1024
MODEL_BUDGET_SECONDS = 300
MISSING_NUMBER = -1
# ---------------------------------------------------------------------------

METADATA_SCHEMA = T.StructType([
    T.StructField("asin", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("main_cat", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("category", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
    T.StructField("image", T.ArrayType(T.StringType())),
    T.StructField("date", T.StringType()),
    T.StructField("rank", T.StringType()),
])

REVIEW_SCHEMA = T.StructType([
    T.StructField("reviewerID", T.StringType(), False),
    T.StructField("asin", T.StringType(), False),
    T.StructField("reviewText", T.StringType()),
    T.StructField("unixReviewTime", T.LongType()),
])

# The development sample re-serialises reviews with one more field, in this
# field order.
REVIEW_SAMPLE_SCHEMA = T.StructType([
    T.StructField("reviewerID", T.StringType()),
    T.StructField("asin", T.StringType()),
    T.StructField("reviewText", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("unixReviewTime", T.LongType()),
])

# Training text is read as strings; the label is cast afterwards so that
# "1"/"0" as well as "true"/"false" are accepted.
TRAINING_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("sentiment", T.StringType()),
])

# Report column names and their keys (the keys become table assertions).
REPORT_KEYS = {
    "category_sentiment": ("main_cat",),
    "brand_sentiment": ("brand",),
    "brand_sentiment_by_year": ("brand", "year"),
    "product_sentiment": ("id",),
    "category_demand": ("main_cat", "month"),
    "brand_demand": ("brand", "month"),
}

REPORT_SCHEMAS = {
    "category_sentiment": T.StructType([
        T.StructField("main_cat", T.StringType()),
        T.StructField("sentiment_rank", T.DoubleType()),
        T.StructField("review_count", T.LongType()),
    ]),
    "brand_sentiment": T.StructType([
        T.StructField("brand", T.StringType()),
        T.StructField("sentiment_rank", T.DoubleType()),
        T.StructField("review_count", T.LongType()),
    ]),
    "brand_sentiment_by_year": T.StructType([
        T.StructField("brand", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("sentiment_rank", T.DoubleType()),
    ]),
    "product_sentiment": T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("sentiment_rank", T.DoubleType()),
        T.StructField("review_count", T.LongType()),
    ]),
    "category_demand": T.StructType([
        T.StructField("main_cat", T.StringType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("demand", T.LongType()),
    ]),
    "brand_demand": T.StructType([
        T.StructField("brand", T.StringType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("demand", T.LongType()),
    ]),
}
