"""The six reports, their rankings, slices and the product union.

All take the pre-aggregated fact (``operators.fact.build_fact``) and return
DataFrames; nothing is collected.  Shares are ``sum(positives) / count * 100``
in that order (true double division), exactly as the row-level SQL computes.

Rankings have no total order in the source application; every ranking here
appends the group key ascending so ties cut deterministically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.schemas import (
    BRAND_MIN_REVIEWS, PRODUCT_MIN_REVIEWS, RANKING_SIZE, TOP_BRANDS,
)

YEAR_MODES = {"calendar": "year", "week": "week_year"}
KEY_SEPARATOR = "\u0001"


def share(pos: str = "pos", n: str = "n") -> Column:
    return (F.sum(pos) / F.sum(n)) * 100


def _sentiment_by(fact: DataFrame, *keys: str) -> DataFrame:
    return fact.groupBy(*keys).agg(share().alias("sentiment_rank"),
                                   F.sum("n").alias("review_count"))


Order = list[tuple[str, bool]]   # (column, ascending)


def ranked(df: DataFrame, order: Order, keys: list[str],
           limit: int | None = None) -> DataFrame:
    """Order by ``order`` then the keys ascending; ``limit`` makes it a top-k
    (planned as TakeOrderedAndProject: a bounded heap per partition)."""
    cols = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    out = df.orderBy(*cols, *[F.col(k).asc() for k in keys])
    return out.limit(limit) if limit is not None else out


# -- category ---------------------------------------------------------------

def category_sentiment(fact: DataFrame) -> DataFrame:
    return _sentiment_by(fact, "main_cat")


def category_sentiment_ranked(fact: DataFrame) -> DataFrame:
    return ranked(category_sentiment(fact),
                  [("sentiment_rank", False), ("review_count", False)], ["main_cat"])


# -- brand ------------------------------------------------------------------

def brand_sentiment(fact: DataFrame, min_reviews: int = BRAND_MIN_REVIEWS) -> DataFrame:
    return _sentiment_by(fact, "brand").where(F.col("review_count") >= min_reviews)


BRAND_RANKINGS: dict[str, Order] = {
    "most_popular": [("review_count", False)],
    "best_sentiment": [("sentiment_rank", False), ("review_count", False)],
    "least_popular": [("review_count", True)],
    "worst_sentiment": [("sentiment_rank", True), ("review_count", True)],
}


def brand_ranking(report: DataFrame, which: str, n: int = RANKING_SIZE) -> DataFrame:
    return ranked(report, BRAND_RANKINGS[which], ["brand"], n)


def top_brands_by_sentiment(report: DataFrame, n: int = TOP_BRANDS) -> DataFrame:
    """Best share first, fewer reviews first among equal shares."""
    return ranked(report, [("sentiment_rank", False), ("review_count", True)], ["brand"], n)


def top_brands_by_reviews(report: DataFrame, n: int = TOP_BRANDS) -> DataFrame:
    """Most reviews first, lower share first among equal counts."""
    return ranked(report, [("review_count", False), ("sentiment_rank", True)], ["brand"], n)


def _only_brands(fact: DataFrame, brands: DataFrame, bounded: bool = True) -> DataFrame:
    # A semi join instead of a literal IN list: quotes in names are harmless
    # and an empty list simply yields no rows.  Our callers pass a top-n list
    # (n rows at most), so broadcasting it is bounded; a caller's own frame
    # (``bounded=False``) is left to AQE, which broadcasts it only if small.
    keep = brands.select("brand")
    return fact.join(F.broadcast(keep) if bounded else keep, "brand", "left_semi")


def brand_sentiment_by_year(fact: DataFrame, brand_report: DataFrame,
                            top: int = TOP_BRANDS, year_mode: str = "calendar") -> DataFrame:
    """Share per (brand, year) for the top brands by sentiment.

    ``year_mode="week"`` buckets by the US week-based year, which is what the
    application's ``YYYY`` pattern computed; ``"calendar"`` by the calendar
    year.  Ordered by year, then brand.
    """
    year = F.col(YEAR_MODES[year_mode]).alias("year")
    picked = _only_brands(fact, top_brands_by_sentiment(brand_report, top))
    return (picked.groupBy("brand", year).agg(share().alias("sentiment_rank"))
            .orderBy("year", "brand"))


# -- product ----------------------------------------------------------------

def product_sentiment(fact: DataFrame, min_reviews: int = PRODUCT_MIN_REVIEWS) -> DataFrame:
    """Products are (title, brand) groups, not asins."""
    return _sentiment_by(fact, "title", "brand").where(F.col("review_count") >= min_reviews)


PRODUCT_RANKINGS = BRAND_RANKINGS


def product_ranking(report: DataFrame, which: str, n: int = RANKING_SIZE) -> DataFrame:
    return ranked(report, PRODUCT_RANKINGS[which], ["title", "brand"], n)


def all_rankings(report: DataFrame, rankings: dict[str, Order], keys: list[str], n: int = RANKING_SIZE) -> DataFrame:
    """The first n rows of every ranking, with ``ranking`` and ``place`` (from 1), from one pass over ``report``.

    Each row stands once per ranking with its sort values (falling ones negated),
    and a window per ranking keeps the first n; Spark keeps the first n of each
    partition before the shuffle, so a ranking's group has at most n rows a task.
    """
    longest = max(len(order) for order in rankings.values())

    def entry(name: str, order: Order) -> Column:
        values = [(F.col(c) if up else -F.col(c)).cast("double") for c, up in order]
        values += [F.lit(0.0)] * (longest - len(order))
        return F.struct(F.lit(name).alias("ranking"), *[v.alias(f"by{i}") for i, v in enumerate(values)])

    entries = F.array(*[entry(name, order) for name, order in rankings.items()])
    rows = report.withColumn("_e", F.explode(entries))
    first = Window.partitionBy("_e.ranking").orderBy(*[F.col(f"_e.by{i}") for i in range(longest)], *keys)
    return (rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n)
            .select(F.col("_e.ranking").alias("ranking"), "place", *report.columns))


def product_report(report: DataFrame, n: int = RANKING_SIZE) -> DataFrame:
    """Distinct union of the four top-n product lists (at most 4n rows).

    Keyed by the (title, brand) pair, so ("A-B", "C") and ("A", "B-C") stay
    apart.  Rows of one key are equal (same aggregate), so keeping any is
    keeping the last.
    """
    return (all_rankings(report, PRODUCT_RANKINGS, ["title", "brand"], n).drop("ranking", "place")
            .dropDuplicates(["title", "brand"]))


def product_key(title: str = "title", brand: str = "brand") -> Column:
    """Deterministic surrogate id of a product (hex SHA-256 of the pair)."""
    return F.sha2(F.concat_ws(KEY_SEPARATOR, F.col(title), F.col(brand)), 256)


def product_report_keyed(report: DataFrame, n: int = RANKING_SIZE) -> DataFrame:
    return product_report(report, n).select(
        product_key().alias("id"), "title", "brand", "sentiment_rank", "review_count")


# -- demand -----------------------------------------------------------------

def category_demand(fact: DataFrame) -> DataFrame:
    """Reviews per (category, month of year), all years folded together."""
    return (fact.groupBy("main_cat", "month").agg(F.sum("n").alias("demand"))
            .orderBy("main_cat", "month"))


def demand_categories(demand: DataFrame) -> DataFrame:
    return demand.select("main_cat").distinct()


def category_demand_for(demand: DataFrame, category: str) -> DataFrame:
    return demand.where(F.col("main_cat") == F.lit(category))


def brand_demand(fact: DataFrame, brand_report: DataFrame, top: int = TOP_BRANDS) -> DataFrame:
    """Reviews per (brand, month) for the top brands by review count."""
    picked = _only_brands(fact, top_brands_by_reviews(brand_report, top))
    return (picked.groupBy("brand", "month").agg(F.sum("n").alias("demand"))
            .orderBy("brand", "month"))


def brand_demand_for(demand: DataFrame, brand: str | DataFrame) -> DataFrame:
    """Slice of one brand: a name, or a frame with a ``brand`` column."""
    if isinstance(brand, DataFrame):
        return _only_brands(demand, brand, bounded=False)
    return demand.where(F.col("brand") == F.lit(brand))


# -- keep last per key --------------------------------------------------------

def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key: the row with the largest ``seq``.

    ``max_by`` over a struct is an ordinary aggregate with a map-side partial
    step, so a key holding a third of the rows is reduced per partition
    before the shuffle (a row_number window would sort all of them in one
    task).
    """
    others = [c for c in df.columns if c not in keys]
    # a NULL ``seq`` sorts first, so a key that has nothing else keeps its row
    order = F.struct(F.col(seq).isNotNull(), F.col(seq))
    last = F.max_by(F.struct(*others), order).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)
