"""Map the driver's parquet tables onto the application's inputs.

  items    <- part:      asin = p_partkey, title = p_name, brand = p_brand,
                         main_cat = p_type
  reviews  <- lineitem:  asin = l_partkey, unixReviewTime = l_shipdate,
              orders:    reviewerID = o_custkey (by order key),
              documents: reviewText = text of doc
                         pmod(l_orderkey * 7 + l_linenumber, count(documents))
  outcome  <- lineitem:  l_returnflag <> 'R' (the observed-outcome sentiment)

Only columns a caller uses are read: Catalyst prunes the rest at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the fixture recipes (messy text made from clean columns).
DOC_KEY_MULTIPLIER = 7
DUPLICATE_ITEM_EVERY = 50        # p_partkey % 50 = 0: the asin appears twice
NULL_BRAND_EVERY = 97            # p_partkey % 97 = 96: brand NULL
GIFT_CARD_EVERY = 53             # p_partkey % 53 = 0: main_cat 'Gift Cards'
BLANK_REVIEW_TEXT_EVERY = 13     # review text NULL where doc key % 13 = 0
MALFORMED_LINE_EVERY = 250       # p_partkey % 250 = 125: truncated JSON line
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def items_from_parts(part: DataFrame) -> DataFrame:
    """Clean product metadata (already typed, no messy text)."""
    return part.select(
        F.col("p_partkey").cast("string").alias("asin"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("main_cat"))


def doc_key(lineitem_orderkey: str = "l_orderkey", linenumber: str = "l_linenumber"):
    return F.col(lineitem_orderkey) * DOC_KEY_MULTIPLIER + F.col(linenumber)


def raw_reviews_from_tables(lineitem: DataFrame, orders: DataFrame, documents: DataFrame,
                            blank_text_every: int | None = None,
                            with_position: bool = False) -> DataFrame:
    """Reviews in the declared input shape plus the observed ``outcome``.

    The document count is a scalar subquery, so nothing passes through the
    driver; both joins are equi-joins that AQE plans from real sizes
    (broadcast when a side turns out small, sort-merge otherwise).
    """
    n_docs = documents.select(F.count(F.lit(1))).scalar()
    li = lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_shipdate",
        F.pmod(doc_key(), n_docs).alias("doc_id"),
        doc_key().alias("doc_key"))
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    d = documents.select("doc_id", "text")
    text = F.col("text")
    if blank_text_every:
        text = F.when(F.pmod(F.col("doc_key"), F.lit(blank_text_every)) == 0,
                      F.lit(None).cast("string")).otherwise(text)
    return (li.join(o, "l_orderkey").join(d, "doc_id")
            .select(F.col("o_custkey").cast("string").alias("reviewerID"),
                    F.col("l_partkey").cast("string").alias("asin"),
                    text.alias("reviewText"),
                    F.unix_timestamp("l_shipdate").alias("unixReviewTime"),
                    (F.col("l_returnflag") != F.lit("R")).cast("int").alias("outcome"),
                    "doc_id",
                    *(["l_orderkey", "l_linenumber"] if with_position else [])))


def raw_metadata_from_parts(part: DataFrame, keep_key: bool = False) -> DataFrame:
    """Product metadata as it arrives: text prices, ranks and dates in several
    shapes, NULL brands, an excluded category and duplicated asins.
    ``keep_key`` keeps the integer part key as ``_key``."""
    key = F.col("p_partkey")
    price_text = F.format_number("p_retailprice", 2)
    price = (F.when(key % 8 == 0, F.concat(F.lit("$"), price_text))
             .when(key % 8 == 1, F.concat(F.lit("from $"), price_text))
             .when(key % 8 == 2, F.concat(F.lit("$1,"), price_text))
             .when(key % 8 == 3, F.lit(None).cast("string"))
             .when(key % 8 == 4, F.lit(""))
             .when(key % 8 == 5, F.lit("$1.00 - $2.00"))
             .when(key % 8 == 6, F.lit(".99"))
             .otherwise(F.lit("N/A")))
    rank_n = F.format_number(F.col("p_size") * 1000 + key, 0)
    rank = (F.when(key % 4 == 0, F.concat(F.lit(">#"), rank_n, F.lit(" in Things (See top 100)")))
            .when(key % 4 == 1, F.lit(None).cast("string"))
            .when(key % 4 == 2, F.lit("unranked"))
            .otherwise(F.concat(F.lit('[">#'), rank_n, F.lit(' in X"]'))))
    day = F.date_add(F.lit("2013-01-01").cast("date"), (key % 365).cast("int"))
    date = (F.when(key % 4 == 0, F.date_format(day, "MMMM d, yyyy"))
            .when(key % 4 == 1, F.date_format(day, "M/d/yyyy"))
            .when(key % 4 == 2, F.lit(None).cast("string"))
            .otherwise(F.lit("n/a")))
    brand = F.when(key % NULL_BRAND_EVERY == NULL_BRAND_EVERY - 1,
                   F.lit(None).cast("string")).otherwise(F.col("p_brand"))
    main_cat = F.when(key % GIFT_CARD_EVERY == 0, F.lit("Gift Cards")).otherwise(F.col("p_type"))
    raw = part.select(
        key.cast("string").alias("asin"),
        F.col("p_name").alias("title"),
        brand.alias("brand"),
        main_cat.alias("main_cat"),
        price.alias("price"),
        F.array(F.col("p_type"), F.col("p_brand")).alias("category"),
        F.concat(F.lit("About "), F.col("p_name")).alias("description"),
        F.array().cast("array<string>").alias("image"),
        date.alias("date"),
        rank.alias("rank"),
        key.alias("_key"))
    copies = raw.where(F.col("_key") % DUPLICATE_ITEM_EVERY == 0)
    both = raw.unionByName(copies)
    return both if keep_key else both.drop("_key")
