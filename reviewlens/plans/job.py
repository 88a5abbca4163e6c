"""The report job: clean -> score -> one fact -> six reports -> tables.

On the application's files, scored by a stored model:
    python -m reviewlens.plans.job --metadata META.json --reviews REVIEWS.json --model PATH --out PATH
On the test tables:
    python -m reviewlens.plans.job --sf-dir /root/testdata/sf0.1 [--provider observed|labels|model]
Further options: --year-mode calendar|week, --dedupe-items, --show, --jdbc-url URL, --cluster.

Plan shape: the reviews are scanned once and pre-aggregated per (asin, time
bucket), joined once to the item weights, and the compact fact is written to
the shared folder (cutting lineage: a lost executor re-reads it instead of
re-running the scan and join); the six reports aggregate that table and the
row counts come from it.
Reports replace their tables as whole, written by the executors, once their
keys have been checked; rows with a NULL key are left out and counted.
"""

from __future__ import annotations

import argparse
import itertools
import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators import reports as R
from reviewlens.operators.cleanup import clean_items, clean_reviews
from reviewlens.operators.fact import item_weights, join_fact, review_stats
from reviewlens.operators.model import load_model
from reviewlens.operators.sentiment import model_sentiment
from reviewlens.schemas import BRAND_MIN_REVIEWS, PRODUCT_MIN_REVIEWS, REPORT_KEYS, REPORT_SCHEMAS
from reviewlens.session import build_session, shared_path
from reviewlens.sources.files import read_metadata, read_reviews
from reviewlens.sinks.jdbc import Database
from reviewlens.sinks.tables import key_check, read_table, replace_table

REPORT_NAMES = tuple(REPORT_KEYS)


def run_reports(spark: SparkSession, items: DataFrame, scored: DataFrame,
                out_dir: str | None = None, parity: bool = True, year_mode: str = "calendar",
                brand_min_reviews: int = BRAND_MIN_REVIEWS,
                product_min_reviews: int = PRODUCT_MIN_REVIEWS,
                jdbc_url: str | None = None, jdbc_properties: dict[str, str] | None = None) -> dict:
    """Build all reports; returns {"reports": {name: DataFrame read back},
    "counts": {...}, "null_keys": {name: rows left out}, "out_dir": path}.  ``items`` are clean items, ``scored``
    clean reviews with an int ``sentiment``."""
    out_dir = out_dir or shared_path(spark, "reports")
    if jdbc_url:
        # all tables with their keys before any work, as a wrong URL or missing right shows here
        database = Database(spark, jdbc_url, jdbc_properties)
        for name in REPORT_NAMES:
            database.ensure_table(name, REPORT_SCHEMAS[name], REPORT_KEYS[name])
    timings: dict[str, float] = {}
    clock = time.monotonic()

    def lap(name: str) -> None:
        nonlocal clock
        now = time.monotonic()
        timings[name] = round(now - clock, 3)
        clock = now

    # The one pass over the reviews: per (asin, time bucket) counts joined
    # to the item weights, written once.
    fact_path = f"{out_dir}/_fact"
    replace_table(join_fact(review_stats(scored), item_weights(items, parity=parity), with_reviews=True), fact_path)
    table_rows = read_table(spark, fact_path)
    fact = table_rows.drop("reviews")
    lap("fact")
    # Row counts after clean-up and the known-items join, from the written
    # table and the small item table (no extra pass over the reviews).
    counts_row = table_rows.agg(
        F.coalesce(F.sum("reviews"), F.lit(0).cast("bigint")).alias("review_count")).select(
        items.select(F.count(F.lit(1))).scalar().alias("metadata_count"), "review_count").first()

    written: dict[str, DataFrame] = {}

    left_out: dict[str, int] = {}

    def publish(name: str, df: DataFrame) -> DataFrame:
        path = f"{out_dir}/{name}"
        got, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in REPORT_SCHEMAS[name]]
        if got != want:
            raise TypeError(f"{name} has {got}, declared is {want}")
        left_out[name] = replace_table(df, path, REPORT_KEYS[name])
        written[name] = read_table(spark, path)
        if jdbc_url:
            database.replace(written[name], name, REPORT_KEYS[name])
        return written[name]

    # Stage 1: reports of the fact alone, plus the HAVING-filtered product
    # aggregate the four product rankings share (written once, read four
    # times).  Independent jobs, submitted concurrently.
    with ThreadPoolExecutor(max_workers=4) as pool:
        jobs = {
            "category_sentiment": pool.submit(publish, "category_sentiment", R.category_sentiment(fact)),
            "brand_sentiment": pool.submit(publish, "brand_sentiment",
                                           R.brand_sentiment(fact, brand_min_reviews)),
            "category_demand": pool.submit(publish, "category_demand", R.category_demand(fact)),
            "_products": pool.submit(replace_table, R.product_sentiment(fact, product_min_reviews),
                                     f"{out_dir}/_products"),
        }
        for j in jobs.values():
            j.result()
    lap("reports_stage1")
    brands = written["brand_sentiment"]
    products = read_table(spark, f"{out_dir}/_products")
    # Stage 2: the time and demand reports take their brand list from the
    # written brand table, as the application read it back from its database.
    with ThreadPoolExecutor(max_workers=3) as pool:
        jobs = [
            pool.submit(publish, "brand_sentiment_by_year",
                        R.brand_sentiment_by_year(fact, brands, year_mode=year_mode)),
            pool.submit(publish, "product_sentiment", R.product_report_keyed(products)),
            pool.submit(publish, "brand_demand", R.brand_demand(fact, brands)),
        ]
        for j in jobs:
            j.result()
    lap("reports_stage2")
    written = {name: written[name] for name in REPORT_NAMES}

    # How much the pre-aggregation shrank the data (row counts of written
    # parquet tables come from file metadata).
    counts = {**counts_row.asDict(), "fact_rows": fact.count()}
    return {"reports": written, "counts": counts, "null_keys": left_out, "timings": timings, "out_dir": out_dir}


def check_keys(reports: dict[str, DataFrame]) -> DataFrame:
    """Key assertion rows for the written reports (one row per report)."""
    rows = [key_check(df, list(REPORT_KEYS[name])).select(F.lit(name).alias("report"), "*")
            for name, df in reports.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def report_lists(reports: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The ranking lists that the console shows besides the six reports."""
    brands, products = reports["brand_sentiment"], reports["product_sentiment"]
    out = {"categories by sentiment": reports["category_sentiment"].orderBy(F.desc("sentiment_rank"), "main_cat")}
    out |= {f"brands, {which}": R.brand_ranking(brands, which) for which in R.BRAND_RANKINGS}
    out |= {f"products, {which}": R.product_ranking(products, which) for which in R.PRODUCT_RANKINGS}
    return out


def report_slices(reports: dict[str, DataFrame]) -> Iterator[tuple[str, DataFrame]]:
    """The demand of each category and of each brand by month, as the console shows them."""
    for name, column, cut in (("category_demand", "main_cat", R.category_demand_for),
                              ("brand_demand", "brand", R.brand_demand_for)):
        for row in reports[name].select(column).distinct().orderBy(column).toLocalIterator():
            yield f"{name} of {row[0]}", cut(reports[name], row[0])


def inputs_from_files(spark: SparkSession, metadata: str, reviews: str, model_path: str):
    """(clean items, scored reviews) of the application's JSON files and a stored model."""
    items = clean_items(read_metadata(spark, metadata))
    return items, model_sentiment(clean_reviews(read_reviews(spark, reviews)), load_model(model_path))


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    ap.add_argument("--metadata", help="product metadata, JSON lines")
    ap.add_argument("--reviews", help="reviews, JSON lines")
    ap.add_argument("--model", help="a stored sentiment model")
    ap.add_argument("--sf-dir", help="the test tables instead of files")
    ap.add_argument("--out")
    ap.add_argument("--jdbc-url", help="replace the report tables of this database, too")
    ap.add_argument("--jdbc-option", action="append", default=[], metavar="NAME=VALUE",
                    help="of the connection, e.g. driver=... or user=...")
    ap.add_argument("--master")
    ap.add_argument("--provider", default="observed", choices=("observed", "labels", "model"))
    ap.add_argument("--year-mode", default="calendar", choices=tuple(R.YEAR_MODES))
    ap.add_argument("--dedupe-items", action="store_true")
    ap.add_argument("--show", action="store_true", help="print each report and ranking list (job only)")
    ap.add_argument("--cluster", action="store_true",
                    help="apply the large-cluster session profile (session.CLUSTER_PROFILE)")
    args = ap.parse_args(argv)
    files = (args.metadata, args.reviews, args.model)
    if bool(args.sf_dir) == any(files) or any(files) and not all(files):
        ap.error("give --metadata, --reviews and --model, or --sf-dir")

    spark = build_session(args.master, cluster=args.cluster)
    start = time.monotonic()
    if not args.sf_dir:
        items, scored = inputs_from_files(spark, *files)
    else:
        from reviewlens.plans import inputs as I
        items = I.items(spark, args.sf_dir)
        if args.provider == "model":
            from reviewlens.plans.ml_queries import scored_reviews
            scored = scored_reviews(spark, args.sf_dir)
        else:
            scored = I.scored(spark, args.sf_dir, args.provider)
    result = run_reports(spark, items, scored, args.out, parity=not args.dedupe_items,
                         year_mode=args.year_mode, jdbc_url=args.jdbc_url,
                         jdbc_properties=dict(o.split("=", 1) for o in args.jdbc_option))
    if args.show:
        shown = [*result["reports"].items(), *report_lists(result["reports"]).items()]
        for name, df in itertools.chain(shown, report_slices(result["reports"])):
            print(name)
            df.show(truncate=False)
        check_keys(result["reports"]).show()
    print(json.dumps({"counts": result["counts"], "null_keys": result["null_keys"], "timings": result["timings"],
                      "out_dir": result["out_dir"],
                      "minutes": (time.monotonic() - start) / 60}))


if __name__ == "__main__":
    main()
