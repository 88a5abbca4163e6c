"""The report job equals the registered queries, and its keys hold."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_CHECK
from reviewlens.plans import inputs as I
from reviewlens.plans.job import check_keys, run_reports


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) and not math.isnan(r[c]) else r[c]
                        for c in cols) for r in df.collect())


def test_job_matches_queries(spark):
    result = run_reports(spark, I.items(spark, SF_CHECK), I.scored(spark, SF_CHECK))
    reports = result["reports"]
    q = E.queries()
    assert _rows(reports["category_sentiment"]) == _rows(q["category_sentiment"](spark, SF_CHECK))
    assert _rows(reports["brand_sentiment"]) == _rows(q["brand_sentiment"](spark, SF_CHECK))
    assert _rows(reports["brand_sentiment_by_year"]) == _rows(q["brand_sentiment_by_year"](spark, SF_CHECK))
    assert _rows(reports["product_sentiment"]) == _rows(q["product_report_keyed"](spark, SF_CHECK))
    assert _rows(reports["category_demand"]) == _rows(q["category_demand"](spark, SF_CHECK))
    assert _rows(reports["brand_demand"]) == _rows(q["brand_demand"](spark, SF_CHECK))
    counts = result["counts"]
    assert (counts["metadata_count"], counts["review_count"]) == (2000, 60000)
    assert set(result["null_keys"].values()) == {0}
    assert counts["fact_rows"] <= counts["review_count"]
    for row in check_keys(reports).collect():
        assert row.null_keys == 0 and row.duplicate_keys == 0, row.report


def test_demand_sums_to_joined_rows(spark):
    fact = I.fact(spark, SF_CHECK)
    demand = E.queries()["category_demand"](spark, SF_CHECK)
    total = sum(r.demand for r in demand.collect())
    assert total == fact.groupBy().sum("n").first()[0]
    shares = E.queries()["category_sentiment"](spark, SF_CHECK).collect()
    positives = fact.groupBy().sum("pos").first()[0]
    assert round(sum(r.review_count * r.sentiment_rank / 100 for r in shares)) == positives
    assert all(0 <= r.sentiment_rank <= 100 for r in shares)


def test_job_command_line_options(spark, capsys):
    import json
    from reviewlens.plans.job import main
    main(["--sf-dir", "/root/testdata/sf0.001", "--provider", "labels", "--year-mode", "week",
          "--dedupe-items"])
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["counts"]["metadata_count"] == 200
    # the label provider keeps only labelled reviews
    assert 0 < out["counts"]["review_count"] < 6000
    assert set(out["timings"]) == {"fact", "reports_stage1", "reports_stage2"}


def test_job_on_files_with_a_stored_model(spark, capsys):
    import json
    from pyspark.ml.classification import NaiveBayes
    from reviewlens.operators.model import save_model, train_sentiment
    from reviewlens.plans.job import main
    from reviewlens.session import shared_path
    base = shared_path(spark, "job")
    data = spark.createDataFrame([("good fine", 1), ("bad poor", 0)] * 20, "text string, label int")
    model, _ = train_sentiment(data, data, candidates={"NB": lambda: NaiveBayes()}, num_features=1 << 8)
    save_model(model, f"{base}/model")
    items = [{"asin": "a", "title": "t", "brand": "b", "main_cat": "E"}] * 2 + [{"asin": "c", "title": "u", "brand": "b",
                                                                                 "main_cat": "F"}]
    reviews = [{"reviewerID": "r", "asin": a, "reviewText": t, "unixReviewTime": u} for a, t, u in
               (("a", "good", 0), ("a", "bad", None), ("c", "fine", 86400), ("z", "good", 0), ("a", None, 0))]
    for name, rows in (("items", items), ("reviews", reviews)):
        spark.createDataFrame([(json.dumps(r),) for r in rows] + [("{",)], "value string").write.text(f"{base}/{name}")
    main(["--metadata", f"{base}/items", "--reviews", f"{base}/reviews", "--model", f"{base}/model", "--out", f"{base}/out",
          "--show"])
    printed = capsys.readouterr().out
    out = json.loads(printed.strip().splitlines()[-1])
    # reviews of a count twice each (a is listed twice), that of c once
    assert (out["counts"]["metadata_count"], out["counts"]["review_count"]) == (3, 5)
    assert out["null_keys"]["category_demand"] == 1 and "brands, most_popular" in printed
    assert "category_demand of E" in printed and "category_demand of F" in printed
    from reviewlens.sinks.tables import read_table
    assert sorted(map(tuple, read_table(spark, f"{base}/out/category_sentiment").collect())) == [("E", 50.0, 8), ("F", 100.0, 1)]
    with pytest.raises(SystemExit):
        main(["--metadata", "x"])


def test_training_program_and_sample_command(spark, capsys):
    from reviewlens.operators.model import load_model
    from reviewlens.plans import sample, train
    from reviewlens.session import shared_path
    base = shared_path(spark, "programs")
    rows = [(f"{'good fine' if i % 2 else 'bad poor'} n{i}", ("true", "0")[1 - i % 2]) for i in range(80)] + [("no label", "x")]
    spark.createDataFrame(rows, "text string, sentiment string").write.option("sep", "\t").csv(f"{base}/tsv")
    train.main(["--training", f"{base}/tsv", "--model", f"{base}/model", "--partitions", "2"])
    printed = capsys.readouterr().out
    assert "majority_baseline" in printed and "NaiveBayes" in printed
    scored = load_model(f"{base}/model").transform(spark.createDataFrame([("good fine",), ("bad poor",)], "text string"))
    assert [r.prediction for r in scored.collect()] == [1.0, 0.0]
    spark.createDataFrame([('{"reviewerID":"r","asin":"a","reviewText":"t"}',)] * 4, "value string").write.text(f"{base}/in")
    sample.main(["--source", f"{base}/in", "--target", f"{base}/out", "--lines", "3", "--reviews"])
    assert "3 lines" in capsys.readouterr().out
    assert {r.value for r in spark.read.text(f"{base}/out").collect()} == {
        '{"reviewerID":"r","asin":"a","reviewText":"t","summary":null,"unixReviewTime":0}'}


def test_job_replaces_database_tables_with_keys(spark):
    """Embedded in-memory Derby, which only this JVM sees."""
    from reviewlens.schemas import REPORT_KEYS
    from reviewlens.sinks.jdbc import Database
    url, options = "jdbc:derby:memory:reviewlens_job;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    small = "/root/testdata/sf0.001"
    for _ in range(2):             # the second run replaces the first one's rows
        reports = run_reports(spark, I.items(spark, small), I.scored(spark, small), brand_min_reviews=100,
                              product_min_reviews=2, jdbc_url=url, jdbc_properties=options)["reports"]
    database = Database(spark, url, options)
    for name, df in reports.items():
        assert df.count() and _rows(database.read(name)) == _rows(df)
        assert database.primary_key(name.upper()) == list(REPORT_KEYS[name])
