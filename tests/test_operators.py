"""Operators on small literal frames: filters, multiplicity, ranking edges."""

import random

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import reports as R
from reviewlens.operators.cleanup import clean_items, clean_reviews, filter_items, known_items
from reviewlens.operators.fact import build_fact

ITEM_COLS = "asin string, title string, brand string, main_cat string"
REVIEW_COLS = "asin string, unix_time bigint, sentiment int"


def items_df(spark, rows):
    return spark.createDataFrame(rows, ITEM_COLS)


def scored_df(spark, rows):
    return spark.createDataFrame(rows, REVIEW_COLS)


def test_filter_items_nulls_excluded_and_empty_kept(spark):
    rows = [("1", "t", "b", "Audio"), (None, "t", "b", "Audio"),
            ("2", None, "b", "Audio"), ("3", "t", None, "Audio"),
            ("4", "t", "b", None), ("5", "t", "b", "Books"), ("6", "t", "b", "Gift Cards"),
            ("7", "", "", "")]
    got = sorted(r.asin for r in filter_items(items_df(spark, rows)).collect())
    assert got == ["1", "7"]


def test_clean_items_columns_and_order(spark):
    raw = spark.createDataFrame(
        [("1", "t", "b", "E", "$1,234.56", ["c"], "d", [], "October 1, 2013", ">#5 in X")],
        "asin string, title string, brand string, main_cat string, price string, "
        "category array<string>, description string, image array<string>, date string, rank string")
    out = clean_items(raw)
    assert out.columns == ["asin", "title", "brand", "main_cat", "category", "description",
                           "image", "price", "unixTime", "rank"]
    row = out.first()
    assert row.price == pytest.approx(1234.56) and row.unixTime == 1380585600.0 and row.rank == 5


def test_clean_reviews_rename_and_null_time_kept(spark):
    raw = spark.createDataFrame(
        [("r1", "a", "good", 10), ("r2", "a", None, 11), (None, "a", "x", 12), ("r3", "a", "ok", None)],
        "reviewerID string, asin string, reviewText string, unixReviewTime bigint")
    out = clean_reviews(raw)
    assert out.columns == ["rid", "asin", "review_text", "unix_time"]
    assert sorted(r.rid for r in out.collect()) == ["r1", "r3"]


def test_known_items_multiplicity(spark):
    items = items_df(spark, [("a", "t", "b", "E"), ("a", "t", "b", "E"), ("b", "t", "b", "E")])
    reviews = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "zzz")], "rid string, asin string")
    assert known_items(reviews, items).count() == 3        # a twice, b once, unknown dropped
    assert known_items(reviews, items, semi=True).count() == 2


def brute_force_fact(items, scored, parity=True):
    """Row-level join as the application ran it: reviews x ids x items."""
    ids = [i[0] for i in items]
    out = []
    for r in scored:
        k = ids.count(r[0]) if parity else (1 if r[0] in ids else 0)
        for _ in range(k):
            for it in items:
                if it[0] == r[0]:
                    out.append((it[1], it[2], it[3], r[1], r[2]))
    return out


def test_fact_matches_row_level_join(spark):
    rnd = random.Random(7)
    items = [(str(rnd.randint(0, 6)), f"t{rnd.randint(0, 2)}", f"b{rnd.randint(0, 2)}",
              f"c{rnd.randint(0, 1)}") for _ in range(12)]
    scored = [(str(rnd.randint(0, 8)), rnd.randint(0, 3) * 86400 * 40, rnd.randint(0, 1))
              for _ in range(300)]
    for parity in (True, False):
        fact = build_fact(items_df(spark, items), scored_df(spark, scored), parity=parity)
        got = {(r.main_cat, r.review_count, r.sentiment_rank)
               for r in R.category_sentiment(fact).collect()}
        rows = brute_force_fact(items, scored, parity)
        want = set()
        for cat in {r[2] for r in rows}:
            g = [r for r in rows if r[2] == cat]
            want.add((cat, len(g), sum(r[4] for r in g) / len(g) * 100))
        assert got == want, parity


def test_duplicate_asin_gives_four_times_rows(spark):
    items = items_df(spark, [("a", "t", "b", "E"), ("a", "t", "b", "E")])
    scored = scored_df(spark, [("a", 0, 1)])
    assert R.category_sentiment(build_fact(items, scored)).first().review_count == 4
    assert R.category_sentiment(build_fact(items, scored, parity=False)).first().review_count == 2


def test_having_threshold_edges(spark):
    items = items_df(spark, [("x", "t", "BX", "E"), ("y", "t", "BY", "E")])
    scored = (spark.range(2000).select(F.lit("x").alias("asin"), F.lit(0).cast("bigint").alias("unix_time"),
                                       F.lit(1).alias("sentiment"))
              .unionByName(spark.range(1999).select(F.lit("y").alias("asin"),
                                                    F.lit(0).cast("bigint").alias("unix_time"),
                                                    F.lit(0).alias("sentiment"))))
    fact = build_fact(items, scored)
    assert [r.brand for r in R.brand_sentiment(fact).collect()] == ["BX"]
    assert [r.brand for r in R.brand_sentiment(fact, 1999).orderBy("brand").collect()] == ["BX", "BY"]
    products = R.product_sentiment(fact, 2000).collect()
    assert [(p.title, p.brand, p.review_count) for p in products] == [("t", "BX", 2000)]


def test_ties_cut_by_key_and_quote_in_brand(spark):
    report = spark.createDataFrame(
        [("O'Brien", 50.0, 10), ("Acme", 50.0, 10), ("Zed", 50.0, 10), ("Low", 10.0, 5)],
        "brand string, sentiment_rank double, review_count bigint")
    assert [r.brand for r in R.brand_ranking(report, "best_sentiment", 2).collect()] == ["Acme", "O'Brien"]
    assert [r.brand for r in R.top_brands_by_reviews(report, 3).collect()] == ["Acme", "O'Brien", "Zed"]
    items = items_df(spark, [("q", "t", "O'Brien", "E")])
    fact = build_fact(items, scored_df(spark, [("q", 0, 1)]))
    rows = R.brand_sentiment_by_year(fact, report, top=2).collect()
    assert [(r.brand, r.year) for r in rows] == [("O'Brien", 1970)]


def test_empty_top_list_gives_no_rows(spark):
    fact = build_fact(items_df(spark, [("q", "t", "B", "E")]), scored_df(spark, [("q", 0, 1)]))
    empty = spark.createDataFrame([], "brand string, sentiment_rank double, review_count bigint")
    assert R.brand_sentiment_by_year(fact, empty).count() == 0
    assert R.brand_demand(fact, empty).count() == 0


def test_null_time_forms_its_own_group(spark):
    fact = build_fact(items_df(spark, [("q", "t", "B", "E")]),
                      scored_df(spark, [("q", None, 1), ("q", 0, 0)]))
    rows = {r.month: r.demand for r in R.category_demand(fact).collect()}
    assert rows == {None: 1, 1: 1}


def test_product_union_keeps_pair_keys_apart(spark):
    report = spark.createDataFrame([("A-B", "C", 50.0, 100), ("A", "B-C", 60.0, 100)],
                                   "title string, brand string, sentiment_rank double, review_count bigint")
    out = R.product_report_keyed(report).collect()
    assert len(out) == 2 and len({r.id for r in out}) == 2


def test_keep_last(spark):
    df = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (3, "j", "c")], "seq int, key string, v string")
    got = sorted((r.key, r.v) for r in R.keep_last(df, ["key"], "seq").collect())
    assert got == [("j", "c"), ("k", "b")]


def test_partition_count_invariance(spark):
    rnd = random.Random(3)
    items = items_df(spark, [(str(i), f"t{i % 3}", f"b{i % 4}", f"c{i % 2}") for i in range(20)])
    scored = scored_df(spark, [(str(rnd.randint(0, 25)), rnd.randint(0, 2000) * 86400, rnd.randint(0, 1))
                               for _ in range(500)])
    results = []
    for n in (1, 4, 16):
        fact = build_fact(items.repartition(n), scored.repartition(n))
        results.append(sorted(map(tuple, R.category_demand(fact).collect())))
    assert results[0] == results[1] == results[2]
    total = sum(r[2] for r in results[0])
    assert total == build_fact(items, scored).agg(F.sum("n")).first()[0]


def test_spread_only_on_request(spark):
    from reviewlens.operators.partitioning import spread
    df = spark.range(100).coalesce(1)
    assert spread(df) is df
    assert spread(df, 3).rdd.getNumPartitions() == 3


def test_keep_last_keeps_a_row_without_seq(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", None, "y"), ("b", 1, "z"), ("b", 2, "w")],
                               "k string, seq int, v string")
    assert sorted(map(tuple, R.keep_last(df, ["k"], "seq").collect())) == [("a", None, "x"), ("b", 2, "w")]


def test_hot_asin_with_a_third_of_reviews(spark):
    """One asin holds a third of the reviews: same answer as the row-level join."""
    items = [(str(i), f"t{i}", f"b{i % 3}", f"c{i % 2}") for i in range(30)]
    rnd = random.Random(9)
    scored = [("0" if j % 3 == 0 else str(rnd.randint(1, 29)), rnd.randint(0, 500) * 86400, rnd.randint(0, 1))
              for j in range(3000)]
    fact = build_fact(items_df(spark, items), scored_df(spark, scored))
    got = {r.brand: (r.review_count, r.sentiment_rank) for r in R.brand_sentiment(fact, 0).collect()}
    rows = brute_force_fact(items, scored)
    for brand in {r[1] for r in rows}:
        g = [r for r in rows if r[1] == brand]
        assert got[brand] == (len(g), sum(r[4] for r in g) / len(g) * 100)
    assert fact.where("asin = '0'").count() <= 501   # one row per time bucket, not per review


def test_fact_counts_the_rows_of_the_known_items_join(spark):
    from reviewlens.operators.cleanup import known_items
    from reviewlens.operators.fact import item_weights, join_fact, review_stats
    items = items_df(spark, [("a", "t1", "b", "E"), ("a", "t2", "b", "E"), ("a", "t1", "b", "E"),
                             ("c", "t", "b", "F")])
    scored = scored_df(spark, [("a", 0, 1), ("a", 0, 0), ("c", 86400 * 40, 1), ("zzz", 0, 1)])
    for parity in (True, False):
        full = join_fact(review_stats(scored), item_weights(items, parity), with_reviews=True)
        assert full.agg(F.sum("reviews")).first()[0] == known_items(scored, items, semi=not parity).count()
        plain = join_fact(review_stats(scored), item_weights(items, parity))
        assert sorted(map(tuple, full.drop("reviews").collect())) == sorted(map(tuple, plain.collect()))
