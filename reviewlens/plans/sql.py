"""SQL façade: the fact and the reports as session temp views.

Users who prefer SQL query the views with ``spark.sql``; Catalyst plans the
text exactly like the DataFrame calls (same optimiser, same physical plan).
View names are matched case-insensitively, as Spark SQL does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlens.operators import reports as R
from reviewlens.operators.fact import build_fact
from reviewlens.schemas import BRAND_MIN_REVIEWS, PRODUCT_MIN_REVIEWS, TOP_BRANDS

_JOIN = """FROM {p}scored_reviews r
        JOIN (SELECT asin AS id FROM {p}items) ids ON r.asin = ids.id
        JOIN {p}items i ON i.asin = r.asin"""
_DAY = "date_from_unix_date(CAST(floor(r.unix_time / 86400) AS INT))"
_SHARE = "SUM(r.sentiment) / COUNT(1) * 100"

# The six reports at row level, over the views of one ``register_views`` call.
REPORT_SQL = {
    "category_sentiment": f"""
        SELECT i.main_cat, {_SHARE} AS sentiment_rank, COUNT(1) AS review_count
        {_JOIN} GROUP BY i.main_cat""",
    "brand_sentiment": f"""
        SELECT i.brand, {_SHARE} AS sentiment_rank, COUNT(1) AS review_count
        {_JOIN} GROUP BY i.brand HAVING COUNT(1) >= {BRAND_MIN_REVIEWS}""",
    "brand_sentiment_by_year": f"""
        SELECT i.brand, year({_DAY}) AS year, {_SHARE} AS sentiment_rank
        {_JOIN} WHERE i.brand IN (SELECT brand FROM {{p}}brand_sentiment
                                  ORDER BY sentiment_rank DESC, review_count ASC, brand LIMIT {TOP_BRANDS})
        GROUP BY i.brand, year({_DAY}) ORDER BY year, i.brand""",
    "product_sentiment": f"""
        SELECT i.title, i.brand, {_SHARE} AS sentiment_rank, COUNT(1) AS review_count
        {_JOIN} GROUP BY i.title, i.brand HAVING COUNT(1) >= {PRODUCT_MIN_REVIEWS}""",
    "category_demand": f"""
        SELECT i.main_cat, month({_DAY}) AS month, COUNT(1) AS demand
        {_JOIN} GROUP BY i.main_cat, month({_DAY}) ORDER BY i.main_cat, month""",
    "brand_demand": f"""
        SELECT i.brand, month({_DAY}) AS month, COUNT(1) AS demand
        {_JOIN} WHERE i.brand IN (SELECT brand FROM {{p}}brand_sentiment
                                  ORDER BY review_count DESC, sentiment_rank ASC, brand LIMIT {TOP_BRANDS})
        GROUP BY i.brand, month({_DAY}) ORDER BY i.brand, month""",
}


def register_views(spark: SparkSession, items: DataFrame, scored: DataFrame, prefix: str = "") -> dict[str, DataFrame]:
    """Register the clean ``items``, ``reviews``, ``scored_reviews``, the
    ``fact`` and the six reports (all lazy) as temp views; ``prefix`` keeps
    several sets of views apart."""
    fact = build_fact(items, scored)
    brands = R.brand_sentiment(fact)
    views = {
        "items": items,
        "reviews": scored.drop("sentiment", "score"),
        "scored_reviews": scored,
        "fact": fact,
        "category_sentiment": R.category_sentiment(fact),
        "brand_sentiment": brands,
        "brand_sentiment_by_year": R.brand_sentiment_by_year(fact, brands),
        "product_sentiment": R.product_sentiment(fact),
        "category_demand": R.category_demand(fact),
        "brand_demand": R.brand_demand(fact, brands),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    return views


def report_sql(name: str, prefix: str = "") -> str:
    return REPORT_SQL[name].format(p=prefix)
