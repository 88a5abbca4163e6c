"""Sources, samples and sinks on files written to the shared folder."""

import json
import os

import pytest
from pyspark.sql import functions as F

from reviewlens.operators.sample import dev_sample
from reviewlens.schemas import REVIEW_SAMPLE_SCHEMA
from reviewlens.session import shared_path
from reviewlens.sinks.jdbc import Database
from reviewlens.sinks.tables import key_check, read_table, replace_table
from reviewlens.sources.files import read_metadata, read_reviews, read_training


def write_lines(spark, lines, name):
    path = shared_path(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_metadata_scan_shapes(spark):
    lines = [
        json.dumps({"asin": "1", "title": "t", "brand": "b", "main_cat": "E", "category": ["x", "y"],
                    "rank": [">#3,100 in X"], "description": ["d1", "d2"]}),
        json.dumps({"asin": "2", "title": "t", "brand": "b", "main_cat": "E", "category": "plain"}),
        '{"asin": "3", "title": ',
    ]
    rows = {r.asin: r for r in read_metadata(spark, write_lines(spark, lines, "meta")).collect()}
    assert rows["1"].rank == '[">#3,100 in X"]'
    assert rows["1"].description == '["d1", "d2"]'   # raw JSON text as written
    assert rows["1"].category == ["x", "y"]
    assert rows["2"].category is None and rows["2"].title == "t"
    assert None in rows and all(v is None for v in rows[None])   # malformed -> all-null row


def test_review_scan(spark):
    lines = [json.dumps({"reviewerID": "r", "asin": "a", "reviewText": "ok", "unixReviewTime": 5}),
             json.dumps({"reviewerID": "r", "asin": "a", "reviewText": "no time"})]
    rows = read_reviews(spark, write_lines(spark, lines, "rev")).collect()
    assert sorted((r.unixReviewTime or 0) for r in rows) == [0, 5]


def test_training_tsv_labels(spark):
    lines = ['good stuff\t1', '"quoted ""text"" here"\tTRUE', '  padded  \tfalse', 'bad\t0', 'odd\tmaybe']
    rows = read_training(spark, write_lines(spark, lines, "tsv")).collect()
    got = {r.text: r.sentiment for r in rows}
    assert got == {"good stuff": True, 'quoted "text" here': True, "padded": False, "bad": False,
                   "odd": None}


def test_sample_empty_lines_use_quota(spark):
    lines = [json.dumps({"i": i}) if i % 3 else "" for i in range(10)]
    path = write_lines(spark, lines, "sample")
    out = [json.loads(r.value)["i"] for r in dev_sample(spark, path, n=6).collect()]
    assert sorted(out) == [1, 2, 4, 5]


def test_sample_reserialize_and_failfast(spark):
    good = [json.dumps({"reviewerID": "r", "asin": "a", "reviewText": "t", "extra": 1})]
    path = write_lines(spark, good, "sample-ok")
    line = dev_sample(spark, path, n=5, clean=True, schema=REVIEW_SAMPLE_SCHEMA,
                      defaults={"unixReviewTime": 0}).first().value
    assert line == '{"reviewerID":"r","asin":"a","reviewText":"t","summary":null,"unixReviewTime":0}' 
    bad = write_lines(spark, good + ['{"reviewerID": '], "sample-bad")
    with pytest.raises(Exception):
        dev_sample(spark, bad, n=5, clean=True, schema=REVIEW_SAMPLE_SCHEMA).collect()


def test_parquet_replace_and_key_check(spark):
    path = shared_path(spark, "table")
    replace_table(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path)
    replace_table(spark.createDataFrame([("c", 3), ("c", 4), (None, 5)], "k string, v int"), path)
    back = read_table(spark, path)
    assert sorted(r.v for r in back.collect()) == [3, 4, 5]
    check = key_check(back, ["k"]).first()
    assert (check.rows, check.null_keys, check.duplicate_keys) == (3, 1, 1)


def test_a_failing_replacement_leaves_the_old_table(spark):
    path = shared_path(spark, "table")
    with pytest.raises(FileNotFoundError):
        read_table(spark, path)
    assert replace_table(spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"), path, ["k"]) == 1
    with pytest.raises(ValueError, match="repeat a key"):
        replace_table(spark.createDataFrame([("c", 3), ("c", 4)], "k string, v int"), path, ["k"])
    with pytest.raises(Exception):
        replace_table(spark.range(3).selectExpr("raise_error('boom') AS k"), path, ["k"])
    assert [tuple(r) for r in read_table(spark, path).collect()] == [("a", 1)]


def test_sample_of_two_folders_with_equal_file_names_and_blanks(spark):
    base = shared_path(spark, "sample with blank")
    for folder, n in (("a", 3), ("b", 50)):
        spark.createDataFrame([(f"{folder}{i}",) for i in range(n)], "value string").coalesce(1).write.text(f"{base}/{folder}")
    got = sorted(r.value for r in dev_sample(spark, [f"{base}/b", f"{base}/a"], n=5).collect())
    assert got == ["a0", "a1", "a2", "b0", "b1"]
    out = f"{base}/out"
    assert dev_sample(spark, [f"{base}/b", f"{base}/a"], out, n=5).count() == 5 == spark.read.text(out).count()


@pytest.fixture
def database(spark):
    """In-process Derby database: visible only to this JVM (local mode)."""
    import uuid
    return Database(spark, f"jdbc:derby:memory:reviewlens_{uuid.uuid4().hex};create=true",
                    {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})


def test_jdbc_table_with_its_key(spark, database):
    df = spark.createDataFrame([("E", 2001, 50.0), ("E", 2002, None)], "brand string, year int, sentiment_rank double")
    assert database.replace(df, "BY_YEAR", ["brand", "year"]) == 2
    assert database.primary_key("BY_YEAR") == ["brand", "year"]
    assert not database.ensure_table("BY_YEAR", df.schema, ["brand", "year"])
    more = spark.createDataFrame([(f"it's {i}", 2000 + i, float(i)) for i in range(40)], df.schema).repartition(4)
    assert database.replace(more, "BY_YEAR", ["brand", "year"]) == 40
    assert sorted(map(tuple, database.read("BY_YEAR").collect())) == sorted(map(tuple, more.collect()))
    assert database.replace(df.limit(0), "BY_YEAR", ["brand", "year"]) == 0


def test_a_failing_jdbc_replacement_leaves_the_old_rows(spark, database):
    good = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    database.replace(good, "T", ["k"])
    for bad in ([("c", 1), ("c", 2)], [("c", 1), (None, 2)]):
        with pytest.raises(Exception):
            database.replace(spark.createDataFrame(bad, good.schema), "T", ["k"])
    with pytest.raises(Exception):
        database.replace(spark.range(9).selectExpr("if(id < 8, string(id), raise_error('boom')) AS k", "1 AS v")
                         .repartition(3), "T", ["k"])
    # the transaction itself fails: the column is narrower in the target than in the staging table
    database.execute("CREATE TABLE NARROW (\"k\" VARCHAR(2) NOT NULL PRIMARY KEY, \"v\" INTEGER)")
    database.replace(good, "NARROW", ["k"])
    with pytest.raises(Exception):
        database.replace(spark.createDataFrame([("z", 1), ("long", 2)], good.schema), "NARROW", ["k"])
    for table in ("T", "NARROW"):
        assert sorted(map(tuple, database.read(table).collect())) == [("a", 1), ("b", 2)]
    # no staging table is left
    with database.connection() as conn:
        rows, names = conn.getMetaData().getTables(None, "APP", None, None), []
        while rows.next():
            names.append(rows.getString("TABLE_NAME"))
    assert sorted(names) == ["NARROW", "T"]


def test_a_wrong_key_or_driver_is_refused(spark, database):
    with pytest.raises(ValueError, match="no columns"):
        database.ensure_table("T", spark.range(1).schema, ["other"])
    with pytest.raises(Exception):
        Database(spark, "jdbc:nothing:x").ensure_table("T", spark.range(1).schema)


def test_sample_spans_files_in_name_order(spark):
    path = shared_path(spark, "sample-multi")
    df = spark.createDataFrame([(i, json.dumps({"i": i})) for i in range(8)], "i int, value string")
    # two files: lines 0-2 in the first, 3-7 in the second (range partitions)
    (df.repartitionByRange(2, "i").sortWithinPartitions("i").select("value")
     .write.text(path))
    files = sorted(spark.read.text(path).inputFiles())
    first_file = spark.read.text(files[0]).count()
    out = sorted(json.loads(r.value)["i"] for r in dev_sample(spark, path, n=first_file + 2).collect())
    assert out == list(range(first_file + 2))


def _tasks_of(spark, work):
    """The number of tasks that ``work`` ran, and its result."""
    group = f"tasks-{id(work)}"
    spark.sparkContext.setJobGroup(group, "")
    out = work()
    tracker = spark.sparkContext.statusTracker()
    infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return sum(i.numTasks for i in infos if i), out


def test_first_lines_of_a_large_file_read_its_front_only(spark):
    from reviewlens.sources.head import head_lines
    base = shared_path(spark, "large")
    spark.range(300_000).selectExpr("concat('line ', id)").coalesce(1).write.text(base)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")          # some 55 splits
    try:
        assert spark.read.text(base).rdd.getNumPartitions() > 40
        for n in (1, 1000, 9000):
            tasks, out = _tasks_of(spark, lambda: [r["value"] for r in head_lines(spark, base, n, budget=1000).collect()])
            assert out == [f"line {i}" for i in range(n)]
            assert tasks < 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_first_lines_of_many_small_files(spark):
    from pathlib import Path
    from reviewlens.sources import head
    base = shared_path(spark, "small files")
    folder = Path(base.removeprefix("file:"))
    folder.mkdir(parents=True)
    want = []
    for i, name in enumerate(["a b", "a+b", "a[0]", "a{x}", "a%20b", "b", "ba", "c*", "é", "empty", "z"]):
        lines = [] if name == "empty" else [f"{name} {k}" for k in range(i + 1)]
        (folder / f"{name}.json").write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
    (folder / "_hidden").write_text("no\n")
    for file in sorted(p.name for p in folder.glob("*.json")):
        want += (folder / file).read_text(encoding="utf-8").splitlines()
    for budget in (1, 30, 10_000):
        for n in (0, 1, 7, 30, 1000):
            got = [r["value"] for r in head.head_lines(spark, base, n, budget).collect()]
            assert got == want[:n], (budget, n)
    assert [x for x, _ in head.listed_files(spark, [base, base], page=2)] == [
        x for x, _ in head.listed_files(spark, [base], page=100)]


def test_review_lines_are_written_compressed_and_read_back_whole(spark, tmp_path):
    from reviewlens.sources.derived import review_json_lines, write_lines
    from reviewlens.sources.files import read_reviews
    text = "a \"quoted\" word, ünd ein Zeichen \t 🙂 " * 400
    rows = [(str(i), "a", f"{i} {text}" if i % 7 else None, i) for i in range(300)]
    raw = spark.createDataFrame(rows, "reviewerID string, asin string, reviewText string, unixReviewTime bigint")
    path = str(tmp_path / "lines")
    write_lines(review_json_lines(raw), path)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert sum(os.path.getsize(os.path.join(path, f)) for f in files) * 4 < sum(len(r[2] or "") for r in rows)
    read = read_reviews(spark, path).select("reviewerID", "asin", "reviewText", "unixReviewTime")
    assert sorted(map(tuple, read.collect())) == sorted(rows)


@pytest.mark.parametrize("head", [1, 100, 1000])
def test_head_first_lines_are_whole_and_their_head_is_sorted(spark, tmp_path, head):
    from reviewlens.sources.derived import write_head_first
    from reviewlens.sources.head import head_lines
    keys = [(k % 37 or None, k % 5) for k in range(500)] * 2             # repeated and missing keys
    rows = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(keys)], "a bigint, b int, i int").repartition(7)
    path = str(tmp_path / f"head-{head}")

    def lines(df):
        return df.select(F.concat_ws(",", F.coalesce("a", F.lit(0)), "b", "i").alias("value"))
    write_head_first(rows, ["a", "b"], lines, path, head)
    found = [tuple(map(int, r[0].split(","))) for r in head_lines(spark, path, 2000).collect()]
    whole = [(a or 0, b, i) for i, (a, b) in enumerate(keys)]
    assert sorted(found) == sorted(whole)
    assert [f[:2] for f in found][:head] == sorted(w[:2] for w in whole)[:head]


def test_ordering_the_sample_moves_no_text(spark, monkeypatch):
    """No line of the sample's file set but those of its head passes through a range exchange."""
    from conftest import SF_SMALL
    from reviewlens.plans import input_queries
    written = []
    keep = input_queries.write_head_first

    def seen(rows, order, make_lines, path, head=2000):
        keep(rows, order, lambda df: written.append(df) or make_lines(df), path, head)
    monkeypatch.setattr(input_queries, "write_head_first", seen)
    assert input_queries.sample_reserialized(spark, SF_SMALL).count() == 1000
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in written]
    assert "rangepartitioning" in plans[0] and "rangepartitioning" not in plans[1]
    assert 2000 <= written[0].count() < 2100
