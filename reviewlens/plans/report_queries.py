"""Report queries (category, brand, product, demand, providers, keep-last)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reviewlens.operators import reports as R
from reviewlens.plans import inputs as I
from reviewlens.plans.queries import query
from reviewlens.plans.store import ReviewStore, buckets_for
from reviewlens.sources.tables import table

# A category slice needs one concrete value; this one exists at every scale.
SLICE_CATEGORY = "STANDARD"


# -- category ---------------------------------------------------------------

@query
def category_sentiment(spark, sf_dir):
    return R.category_sentiment(I.fact(spark, sf_dir))


@query
def category_sentiment_stored(spark, sf_dir):
    """The category report over the bucketed store, filled with two batches of reviews."""
    items, scored = I.items(spark, sf_dir), I.scored(spark, sf_dir)
    store = ReviewStore(spark, f"reviews_{uuid.uuid4().hex[:8]}", buckets=buckets_for(items, least=8))
    store.replace_items(items)
    for half in (0, 1):
        store.add_reviews(scored.where(F.pmod(F.xxhash64("rid"), F.lit(2)) == half))
    return R.category_sentiment(store.fact())


@query
def category_sentiment_ranked(spark, sf_dir):
    return R.category_sentiment_ranked(I.fact(spark, sf_dir))


# -- brand ------------------------------------------------------------------

@query
def brand_sentiment(spark, sf_dir):
    return I.brand_report(spark, sf_dir)


@query
def brands_most_popular(spark, sf_dir):
    return R.brand_ranking(I.brand_report(spark, sf_dir), "most_popular")


@query
def brands_best_sentiment(spark, sf_dir):
    return R.brand_ranking(I.brand_report(spark, sf_dir), "best_sentiment")


@query
def brands_least_popular(spark, sf_dir):
    return R.brand_ranking(I.brand_report(spark, sf_dir), "least_popular")


@query
def brands_worst_sentiment(spark, sf_dir):
    return R.brand_ranking(I.brand_report(spark, sf_dir), "worst_sentiment")


@query
def top_brands_by_sentiment(spark, sf_dir):
    return R.top_brands_by_sentiment(I.brand_report(spark, sf_dir))


@query
def top_brands_by_reviews(spark, sf_dir):
    return R.top_brands_by_reviews(I.brand_report(spark, sf_dir))


@query
def brand_sentiment_by_year(spark, sf_dir):
    fact = I.fact(spark, sf_dir)
    return R.brand_sentiment_by_year(fact, R.brand_sentiment(fact), year_mode="calendar")


@query
def brand_sentiment_by_week_year(spark, sf_dir):
    fact = I.fact(spark, sf_dir)
    return R.brand_sentiment_by_year(fact, R.brand_sentiment(fact), year_mode="week")


# -- product ----------------------------------------------------------------

@query
def product_sentiment(spark, sf_dir):
    return I.product_report_base(spark, sf_dir)


@query
def products_most_popular(spark, sf_dir):
    return R.product_ranking(I.product_report_base(spark, sf_dir), "most_popular")


@query
def products_best_sentiment(spark, sf_dir):
    return R.product_ranking(I.product_report_base(spark, sf_dir), "best_sentiment")


@query
def products_least_popular(spark, sf_dir):
    return R.product_ranking(I.product_report_base(spark, sf_dir), "least_popular")


@query
def products_worst_sentiment(spark, sf_dir):
    return R.product_ranking(I.product_report_base(spark, sf_dir), "worst_sentiment")


@query
def product_rankings(spark, sf_dir):
    """The four lists with their places, from one pass over the aggregate."""
    return R.all_rankings(I.product_report_base(spark, sf_dir), R.PRODUCT_RANKINGS, ["title", "brand"])


@query
def product_report(spark, sf_dir):
    return R.product_report(I.product_report_base(spark, sf_dir))


@query
def product_report_keyed(spark, sf_dir):
    return R.product_report_keyed(I.product_report_base(spark, sf_dir))


# -- demand -----------------------------------------------------------------

@query
def category_demand(spark, sf_dir):
    return R.category_demand(I.fact(spark, sf_dir))


@query
def category_demand_for(spark, sf_dir):
    return R.category_demand_for(R.category_demand(I.fact(spark, sf_dir)), SLICE_CATEGORY)


@query
def demand_categories(spark, sf_dir):
    return R.demand_categories(R.category_demand(I.fact(spark, sf_dir)))


@query
def brand_demand(spark, sf_dir):
    fact = I.fact(spark, sf_dir)
    return R.brand_demand(fact, R.brand_sentiment(fact))


@query
def brand_demand_for(spark, sf_dir):
    """The slice of the brand-demand report for the brand with most reviews
    (the application prints one such slice per top brand)."""
    fact = I.fact(spark, sf_dir)
    report = R.brand_sentiment(fact)
    return R.brand_demand_for(R.brand_demand(fact, report), R.top_brands_by_reviews(report, 1))


# -- providers and keep-last -------------------------------------------------

@query
def sentiment_labels(spark, sf_dir):
    """Category shares with stored labels as the sentiment provider."""
    return R.category_sentiment(I.fact(spark, sf_dir, provider="labels"))


@query
def last_write_wins(spark, sf_dir):
    return R.keep_last(table(spark, sf_dir, "events"), ["user_id"], "event_id")


# -- SQL façade --------------------------------------------------------------------

def _views(spark, sf_dir):
    """Views of one scale factor, under a prefix of its own."""
    from reviewlens.plans.sql import register_views
    prefix = "sf_" + "".join(c if c.isalnum() else "_" for c in sf_dir.rstrip("/").rsplit("/", 1)[-1]) + "_"
    register_views(spark, I.items(spark, sf_dir), I.scored(spark, sf_dir), prefix)
    return prefix


@query
def category_sentiment_ranked_sql(spark, sf_dir):
    """The ranked category report written as SQL over the registered views."""
    return spark.sql(f"SELECT * FROM {_views(spark, sf_dir)}Category_Sentiment "
                     "ORDER BY sentiment_rank DESC, review_count DESC, main_cat")


def _row_level(name):
    def run(spark, sf_dir):
        from reviewlens.plans.sql import report_sql
        return spark.sql(report_sql(name, _views(spark, sf_dir)))
    run.__name__, run.__doc__ = f"{name}_sql", f"The {name} report as row-level SQL over the items and scored reviews."
    return query(run)


for _name in ("category_sentiment", "brand_sentiment", "brand_sentiment_by_year", "product_sentiment",
              "category_demand", "brand_demand"):
    _row_level(_name)
