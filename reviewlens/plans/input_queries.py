"""Input-side queries: metadata / review clean-up, scans, samples, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import reports as R
from reviewlens.operators.cleanup import clean_items, filter_items, known_items
from reviewlens.operators.fact import build_fact
from reviewlens.operators.sample import dev_sample
from reviewlens.plans import inputs as I
from reviewlens.plans.queries import query
from reviewlens.functions.scalars import date_to_epoch, price_to_float, rank_to_long
from reviewlens.schemas import (
    METADATA_SCHEMA, REPORT_KEYS, REVIEW_SAMPLE_SCHEMA, SAMPLE_LINES,
)
from reviewlens.session import shared_path
from reviewlens.sinks.tables import key_check, read_table, replace_table
from reviewlens.sources.derived import (
    EMPTY_LINE_AT, EMPTY_LINE_EVERY, metadata_json_lines, review_json_lines, training_rows, write_head_first,
    write_lines,
)
from reviewlens.sources.files import read_metadata, read_reviews, read_training
from reviewlens.sources.tables import (
    BLANK_REVIEW_TEXT_EVERY, raw_metadata_from_parts, raw_reviews_from_tables, table,
)

MISSING_TIME_EVERY = 17   # review lines with no time, for the re-serialised sample


def _raw_items(spark, sf_dir, keep_key=False):
    return raw_metadata_from_parts(table(spark, sf_dir, "part"), keep_key=keep_key)


def _raw_reviews(spark, sf_dir, **kw):
    return raw_reviews_from_tables(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"),
                                   table(spark, sf_dir, "documents"), **kw)


# -- metadata clean-up ---------------------------------------------------------

@query
def metadata_filter(spark, sf_dir):
    return filter_items(_raw_items(spark, sf_dir)).select("asin", "title", "brand", "main_cat")


@query
def price_clean(spark, sf_dir):
    return _raw_items(spark, sf_dir).select(
        "asin", F.col("price").alias("price_text"), price_to_float("price").alias("price"))


@query
def date_clean(spark, sf_dir):
    return _raw_items(spark, sf_dir).select(
        "asin", F.col("date").alias("date_text"), date_to_epoch("date").alias("unixTime"))


@query
def rank_clean(spark, sf_dir):
    return _raw_items(spark, sf_dir).select(
        "asin", F.col("rank").alias("rank_text"), rank_to_long("rank").alias("rank"))


@query
def metadata_clean(spark, sf_dir):
    return clean_items(_raw_items(spark, sf_dir)).select(
        "asin", "title", "brand", "main_cat", F.array_join("category", "|").alias("category"), "description",
        F.array_join("image", "|").alias("image"), "price", "unixTime", "rank")


# -- reviews -------------------------------------------------------------------

REVIEW_COLUMNS = ("rid", "asin", "unix_time", "doc_id", "sha2(review_text, 256) AS review_text_sha256")


@query
def reviews_known_items(spark, sf_dir):
    """Reviews joined to the raw item list (an asin listed twice doubles its
    reviews), with the digest of the text that each carries."""
    items = clean_items(_raw_items(spark, sf_dir))
    return known_items(I.reviews(spark, sf_dir), items).selectExpr(*REVIEW_COLUMNS)


@query
def reviews_known_items_semi(spark, sf_dir):
    items = clean_items(_raw_items(spark, sf_dir))
    return known_items(I.reviews(spark, sf_dir), items, semi=True).selectExpr(*REVIEW_COLUMNS)


@query
def reviews_clean(spark, sf_dir):
    return I.reviews(spark, sf_dir, blank_text_every=BLANK_REVIEW_TEXT_EVERY).selectExpr(*REVIEW_COLUMNS)


@query
def load_counts(spark, sf_dir):
    """Row counts after each clean-up, as one row, without a row-level join:
    the known-items join yields, per asin, (its reviews) x (its metadata
    rows), so the count is the sum of that product over per-asin counts
    (two partial aggregates and a join of compact tables)."""
    items = clean_items(_raw_items(spark, sf_dir))
    per_item = items.groupBy("asin").agg(F.count(F.lit(1)).alias("copies"))
    per_review = I.reviews(spark, sf_dir).groupBy("asin").agg(F.count(F.lit(1)).alias("reviews"))
    metadata_count = items.select(F.count(F.lit(1))).scalar()
    joined = per_review.join(per_item, "asin")
    return joined.agg(F.coalesce(F.sum(F.col("reviews") * F.col("copies")), F.lit(0).cast("bigint"))
                      .alias("review_count")).select(metadata_count.alias("metadata_count"), "review_count")


# -- scans -----------------------------------------------------------------------

def _metadata_file(spark, sf_dir, ordered=False):
    lines = metadata_json_lines(_raw_items(spark, sf_dir, keep_key=True))
    path = shared_path(spark, "metadata-json")
    if ordered:
        # The sample reads "the first lines": write the file set in key order
        # (range partitions, sorted within), empty lines included.
        lines = lines.withColumn("value", F.when(
            F.col("_key") % EMPTY_LINE_EVERY == EMPTY_LINE_AT, F.lit("")).otherwise(F.col("value")))
        lines = lines.repartitionByRange("_key").sortWithinPartitions("_key")
    lines.select("value").write.text(path)
    return path


@query
def metadata_scan(spark, sf_dir):
    df = read_metadata(spark, _metadata_file(spark, sf_dir))
    return df.select("asin", "title", "brand", "main_cat", "price",
                     F.array_join("category", "|").alias("category"), "description",
                     F.array_join("image", "|").alias("image"), "date", "rank")


@query
def review_scan(spark, sf_dir):
    path = shared_path(spark, "reviews-json")
    write_lines(review_json_lines(_raw_reviews(spark, sf_dir)), path)
    df = read_reviews(spark, path)
    return df.select("reviewerID", "asin", "unixReviewTime",
                     F.sha2("reviewText", 256).alias("review_text_sha256"))


@query
def training_tsv_scan(spark, sf_dir):
    path = shared_path(spark, "training-tsv")
    rows = training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    (rows.select("text", "sentiment").write
     .option("sep", "\t").option("quote", '"').option("escape", '"').csv(path))
    df = read_training(spark, path)
    return df.select(F.sha2("text", 256).alias("text_sha256"), "sentiment")


# -- development samples ----------------------------------------------------------

@query
def sample_first_lines(spark, sf_dir):
    """First 1,000 lines of the metadata file, empty ones skipped, unchanged;
    compared through their parsed fields."""
    lines = dev_sample(spark, _metadata_file(spark, sf_dir, ordered=True),
                       shared_path(spark, "metadata-sample"), n=SAMPLE_LINES)
    rec = F.from_json("value", METADATA_SCHEMA)
    return lines.select(*[rec[c].alias(c) for c in
                          ("asin", "title", "brand", "main_cat", "price", "date", "rank")])


def _reserialized(spark, sf_dir):
    raw = _raw_reviews(spark, sf_dir, with_position=True)
    raw = raw.withColumn("unixReviewTime", F.when(
        F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(MISSING_TIME_EVERY)) == 0,
        F.lit(None).cast("bigint")).otherwise(F.col("unixReviewTime")))
    path = shared_path(spark, "reviews-json")
    write_head_first(raw, ["l_orderkey", "l_linenumber"], review_json_lines, path)
    return dev_sample(spark, path, shared_path(spark, "review-sample"), n=SAMPLE_LINES, clean=True,
                      schema=REVIEW_SAMPLE_SCHEMA, defaults={"unixReviewTime": 0})


@query
def sample_reserialized_bytes(spark, sf_dir):
    """The hash of each line of the re-serialised sample, byte for byte."""
    return _reserialized(spark, sf_dir).select(F.sha2("value", 256).alias("line_sha256"))


@query
def sample_reserialized(spark, sf_dir):
    """First 1,000 review lines re-serialised to the declared fields (a
    missing time becomes 0, a missing summary is written as null)."""
    sample = _reserialized(spark, sf_dir)
    rec = F.from_json("value", REVIEW_SAMPLE_SCHEMA)
    return sample.select(rec["reviewerID"].alias("reviewerID"), rec["asin"].alias("asin"),
                         rec["unixReviewTime"].alias("unixReviewTime"),
                         rec["summary"].alias("summary"),
                         F.sha2(rec["reviewText"], 256).alias("review_text_sha256"))


# -- sinks -----------------------------------------------------------------------

@query
def report_replace(spark, sf_dir):
    """Write another report and then the category report to one table, and read it back."""
    report = R.category_sentiment(I.fact(spark, sf_dir))
    path = shared_path(spark, "category_sentiment")
    replace_table(report.withColumn("review_count", -F.col("review_count")), path, REPORT_KEYS["category_sentiment"])
    replace_table(report, path, REPORT_KEYS["category_sentiment"])
    return read_table(spark, path)


@query
def report_readback(spark, sf_dir):
    """Top brands computed from the brand table read back (chained input)."""
    path = shared_path(spark, "brand_sentiment")
    replace_table(I.brand_report(spark, sf_dir), path, REPORT_KEYS["brand_sentiment"])
    return R.top_brands_by_sentiment(read_table(spark, path))


def six_reports(fact):
    brands = R.brand_sentiment(fact)
    return {
        "category_sentiment": R.category_sentiment(fact),
        "brand_sentiment": brands,
        "brand_sentiment_by_year": R.brand_sentiment_by_year(fact, brands),
        "product_sentiment": R.product_report_keyed(R.product_sentiment(fact)),
        "category_demand": R.category_demand(fact),
        "brand_demand": R.brand_demand(fact, brands),
    }


@query
def report_key_check(spark, sf_dir):
    """Primary-key assertion of each report: rows, NULL keys, duplicate keys."""
    fact = I.fact(spark, sf_dir)
    checks = [key_check(df, list(REPORT_KEYS[name])).select(F.lit(name).alias("report"), "*")
              for name, df in six_reports(fact).items()]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


# -- duplicated metadata: k^2 parity versus semi-join mode ---------------------------

def _duplicated_items_fact(spark, sf_dir, parity):
    items = clean_items(_raw_items(spark, sf_dir)).select("asin", "title", "brand", "main_cat")
    return build_fact(items, I.scored(spark, sf_dir), parity=parity)


@query
def category_sentiment_duplicated_items(spark, sf_dir):
    """Category shares over metadata listing some asins twice: each of their
    reviews counts 2 x 2 = 4 times, as the application's two joins do."""
    return R.category_sentiment(_duplicated_items_fact(spark, sf_dir, parity=True))


@query
def category_sentiment_duplicated_items_semi(spark, sf_dir):
    """Same with the known-items join as a semi join: counted 2 times."""
    return R.category_sentiment(_duplicated_items_fact(spark, sf_dir, parity=False))


# -- the job ------------------------------------------------------------------------

@query
def report_job_from_json(spark, sf_dir):
    """The job's path on the application's files: JSON lines with malformed lines and duplicated
    items -> read -> clean -> fact -> category report.  Texts of odd length count as positive."""
    from reviewlens.operators.cleanup import clean_reviews
    metadata, path = _metadata_file(spark, sf_dir), shared_path(spark, "reviews-json")
    write_lines(review_json_lines(_raw_reviews(spark, sf_dir)), path)
    scored = clean_reviews(read_reviews(spark, path)).withColumn("sentiment", F.length("review_text") % 2)
    return R.category_sentiment(build_fact(clean_items(read_metadata(spark, metadata)), scored))


@query
def job_counts(spark, sf_dir):
    """The job's own row counts, on metadata with duplicated and missing items."""
    from reviewlens.plans.job import run_reports
    items = clean_items(_raw_items(spark, sf_dir))
    counts = run_reports(spark, items, I.scored(spark, sf_dir))["counts"]
    return spark.createDataFrame([(counts["metadata_count"], counts["review_count"])],
                                 "metadata_count bigint, review_count bigint")


def _job_table(name):
    def run(spark, sf_dir):
        from reviewlens.plans.job import run_reports
        scored = I.scored(spark, sf_dir).withColumn("unix_time", F.when(
            F.col("doc_id") % MISSING_TIME_EVERY != 0, F.col("unix_time")))
        return run_reports(spark, I.items(spark, sf_dir), scored)["reports"][name]
    run.__name__ = f"{name}_table"
    run.__doc__ = f"The job's {name} table read back, when some reviews have no time."
    return query(run)


for _name in ("brand_sentiment_by_year", "category_demand", "brand_demand"):
    _job_table(_name)


@query
def date_shapes(spark, sf_dir):
    """Dates written in a dozen shapes, each with a time of day that follows from the part's key."""
    key = F.col("p_partkey")
    day = F.date_add(F.lit("2013-01-01").cast("date"), (key % 365).cast("int"))
    second = (key * 37 % 1440) * 60 + key % 60
    # built from the calendar day and the seconds, without any zone
    at = (day.cast("timestamp_ntz") + F.make_dt_interval(secs=(second + F.col("p_partkey") % 1000 / 1000).cast("decimal(18,6)")))
    shapes = ["MMMM d, yyyy", "M/d/yyyy", "M/d/yyyy h:mm:ss a", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "EEEE, MMMM d, yyyy",
              "EEEE, MMMM d, yyyy h:mm a", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "d MMMM yyyy HH:mm", "yyyy-MM-dd HH:mm:ss",
              "M/d/yyyy h:mm a", "MMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"]
    text = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        text = F.when(key % len(shapes) == i, F.date_format(at, shape)).otherwise(text)
    return table(spark, sf_dir, "part").select("p_partkey", date_to_epoch(text).alias("unixTime"))
