"""Revisit resolution on hand-made records and against a plain loop."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import warc

SCHEMA = "record_id bigint, type string, url string, time bigint, status int, headers map<string,string>, digest string, canon string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}


@pytest.mark.parametrize("url,want", [
    ("HTTP://WWW.Example.COM:80/a?b=2&a=1#x", "example.com/a?a=1&b=2"), ("https://example.com", "example.com/"),
    ("https://u:p@example.com:443/?utm_source=z", "example.com/"), ("http://example.com:8080/A", "example.com:8080/A"),
    ("example.com/a?ref=1&q", "example.com/a?q"), (None, None), ("", ""), ("/only/path", "/only/path"),
    ("http://a.b?x=1", "a.b/?x=1")])
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u")))
    assert df.first()[0] == want


def test_cases(spark):
    found = run(spark, [
        (1, "response", "http://e.org/", 10, 200, {"ETag": '"a"', "Content-Length": "9", "Date": "d1"}, "x1"),
        (2, "response", "https://www.e.org", 20, 200, {"etag": '"b"', "Last-Modified": "m"}, "x2"),
        (3, "response", "http://e.org/", 30, 404, {"ETag": '"c"'}, "x3"),
        (4, "revisit", "http://e.org/#f", 15, 304, {"etag": 'W/"a"', "DATE": "d2", "Content-Length": "0"}, None),
        (5, "revisit", "http://e.org/", 40, 304, {"Last-Modified": "m"}, None),
        (6, "revisit", "http://e.org/", 40, 304, {"ETag": '"a"'}, None),
        (7, "revisit", "http://e.org/", 5, 304, {"ETag": '"a"'}, None),
        (8, "revisit", None, 40, 304, None, None), (9, "revisit", "http://e.org/", None, 304, {}, None),
        (10, "revisit", "http://e.org/", 50, 304, None, "x2"), (11, "revisit", "http://e.org/", 50, 304, {}, "other"),
        (12, "revisit", "http://e.org/", 20, 304, {"ETag": '"b"'}, None), (13, "request", "http://e.org/", 20, 200, {}, "q"),
        (0, "revisit", "http://e.org/", 20, 304, {"ETag": '"a"'}, None)])
    outcome = {k: (r["response_id"], r["outcome"]) for k, r in found.items()}
    assert outcome == {4: (1, "resolved"), 5: (2, "resolved"), 6: (2, "mismatch"), 7: (None, "no_response"),
                       8: (None, "no_url"), 9: (None, "no_url"), 10: (2, "resolved"), 11: (2, "unvalidated"),
                       12: (2, "resolved"), 0: (1, "resolved")}
    assert found[4]["headers"] == {"content-length": "9", "date": "d2", "etag": 'W/"a"'} and found[4]["digest"] == "x1"
    assert found[6]["headers"] is None and found[6]["digest"] is None


def test_a_hot_url_in_many_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "response" if rng.random() < 0.1 else "revisit", "http://hot.org/" if rng.random() < 0.5 else f"http://e.org/{i % 9}",
             int(rng.integers(0, 300)), 200, {}, f"x{i}") for i in range(500)]
    found = run(spark, rows)
    for i, kind, url, t, *_ in rows:
        if kind == "revisit":
            before = [(u, j) for j, k, v, u, *_ in rows if k == "response" and v == url and (u, j) < (t, i)]
            assert found[i]["response_id"] == (max(before)[1] if before else None)


def test_repeated_records_and_empty_table(spark):
    rows = [(1, "response", "http://e.org/", 1, 200, {"ETag": "a"}, "x")] * 2 + [(2, "revisit", "http://e.org/", 2, 304, {"ETag": "a"}, None)] * 2
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert [r["outcome"] for r in warc.resolve_revisits(df).collect()] == ["resolved"] * 2
    assert run(spark, []) == {}
