"""Case tables of the clean-up scalars and time buckets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewlens.functions.scalars import (
    calendar_year, date_to_epoch, month_of_year, price_to_float, rank_to_long, week_year,
)

PRICES = [
    ("$12.99", 12.99), ("$1,234.56", 1234.56), ("$1.00 - $2.00", -1.0), ("free", -1.0),
    (None, -1.0), ("", -1.0), ("   ", -1.0), (".99", 99.0), ("$.99", 99.0), ("-5", 5.0),
    ("1e3", 1000.0), ("12.50 ", 12.5), ("1,2,3", 123.0), ("12abc", -1.0), ("$5-", -1.0),
    ("$1.2.3", -1.0), ("from $900.10", 900.1), ("$1,1,234.56", 11234.56),
]

RANKS = [
    (">#1,234 in Audio", 1234), ("12,34,5 x", 12345), ("12345678901234567890", -1),
    ('[">#3,100 in X"]', 3100), (None, -1), ("", -1), ("unranked", -1), ("#7", 7),
    ("١٢ then 5", -1),
]

DATES = [
    ("October 1, 2013", 1380585600.0), ("Oct 1, 2013", 1380585600.0),
    ("10/1/2013", 1380585600.0), ("2013-10-01", 1380585600.0),
    ("2013-10-01T00:00:00Z", 1380585600.0), ("2013-10-01T02:00:00+02:00", 1380585600.0),
    ("<div>junk</div>", -1.0), (None, -1.0), ("", -1.0), ("n/a", -1.0),
]


def _apply(spark, rows, fn, typ):
    df = spark.createDataFrame([(r[0],) for r in rows], f"v {typ}")
    return [r[0] for r in df.select(fn("v")).collect()]


def test_price_cases(spark):
    got = _apply(spark, PRICES, price_to_float, "string")
    for (text, want), value in zip(PRICES, got):
        assert value == pytest.approx(want, rel=1e-6), text


def test_price_is_float(spark):
    df = spark.createDataFrame([("$1",)], "v string").select(price_to_float("v").alias("p"))
    assert df.schema["p"].dataType.simpleString() == "float"


def test_rank_cases(spark):
    got = _apply(spark, RANKS, rank_to_long, "string")
    assert got == [r[1] for r in RANKS]


def test_date_cases_independent_of_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert _apply(spark, DATES, date_to_epoch, "string") == [d[1] for d in DATES], tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def _epoch(y, m, d):
    return int(dt.datetime(y, m, d, 12, tzinfo=dt.timezone.utc).timestamp())


def _legacy_week_year(d: dt.date) -> int:
    """US week year: weeks start Sunday, week 1 contains 1 January."""
    saturday = d + dt.timedelta(days=(5 - d.weekday()) % 7)
    return saturday.year


def test_week_year_edges(spark):
    cases = [(2013, 12, 30), (2013, 12, 28), (2014, 1, 1), (2010, 12, 31), (2011, 1, 1),
             (2016, 12, 31), (2017, 1, 1)]
    df = spark.createDataFrame([(_epoch(*c),) for c in cases], "t bigint")
    got = [r[0] for r in df.select(week_year("t")).collect()]
    assert got == [_legacy_week_year(dt.date(*c)) for c in cases]
    assert got[0] == 2014  # 2013-12-30 belongs to the first week of 2014


def test_week_year_sixty_years(spark):
    start = dt.date(1970, 1, 1)
    df = spark.range(0, 60 * 366).select((F.col("id") * 86400 + 3600).alias("t"), "id")
    got = {r[0]: r[1] for r in df.select("id", week_year("t")).collect()}
    for i, wy in got.items():
        assert wy == _legacy_week_year(start + dt.timedelta(days=i))


def test_calendar_year_month_and_null(spark):
    df = spark.createDataFrame([(_epoch(2013, 12, 30),), (None,)], "t bigint")
    rows = df.select(calendar_year("t"), month_of_year("t")).collect()
    assert tuple(rows[0]) == (2013, 12)
    assert tuple(rows[1]) == (None, None)


def test_date_shapes(spark):
    shapes = {" October 1, 2013 ": 0, "2013-10-01 10:30:00": 37800, "1 October 2013": 0, "10/1/2013 10:30": 37800,
              "2013/10/01": 0, "2013-10-01T10:30:00": 37800, "Oct. 1, 2013": 0, "October 1, 2013 10:30 PM": 81000,
              "2013-10-01T10:30:00+02:00": 30600, "1 Oct 2013": 0, "10/1/2013": 0, "Oct 1, 2013": 0}
    df = spark.createDataFrame([(k,) for k in [*shapes, "n/a", None, ""]], "d string")
    got = {r.d: r.t for r in df.select("d", date_to_epoch("d").alias("t")).collect()}
    day = 1380585600
    assert {k: got[k] - day for k in shapes} == shapes
    assert got["n/a"] == got[None] == got[""] == -1


def test_date_grammar(spark):
    shapes = {"10/1/2013 10:30:05 AM": 37805, "Tue, 01 Oct 2013 10:30:05 GMT": 37805, "Tuesday, October 1, 2013": 0,
              "Tuesday, October 1, 2013 12:05 AM": 300, "Tuesday, October 1, 2013 12:05 PM": 43500,
              "1-Oct-2013": 0, "OCTOBER 1st, 2013": 0, "Sept 30, 2013 24:00": None, "10.1.2013": 0, "2013-10-01T10:30:05.25Z": 37805.25,
              "2013-10-01 10:30:05 -0130": 37805 + 5400, "10/1/2013 3 pm": 54000, "10/1/2013 13 pm": None, "10/1/2013 0:10 am": None,
              "2013-10-01T10:30": 37800, "13/1/2013": None, "10/32/2013": None, "February 29, 2013": None, "Octob 1, 2013": None,
              "10/1/13": None, "October 2013": None, "10/1/2013 10:61": None, "10/1/2013 10:30:60": None, "x 10/1/2013": None,
              "10/1/2013 x": None, "\u0001": None, "2013": None}
    df = spark.createDataFrame([(k,) for k in shapes], "d string")
    got = {r.d: r.t for r in df.select("d", date_to_epoch("d").alias("t")).collect()}
    assert {k: None if got[k] == -1 else got[k] - 1380585600 for k in shapes} == shapes
    european = df.select(date_to_epoch(F.lit("13/1/2013"), "day first")).first()[0]
    assert european == dt.datetime(2013, 1, 13, tzinfo=dt.timezone.utc).timestamp()


def test_dates_of_a_century_read_back(spark):
    df = spark.range(0, 36525, 7).select(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    for shape in ("EEEE, MMMM d, yyyy", "d MMM yyyy", "M/d/yyyy", "yyyy/MM/dd"):
        bad = df.filter(date_to_epoch(F.date_format("day", shape)) != F.unix_date("day").cast("double") * 86400)
        assert bad.count() == 0


def test_json_text(spark):
    import json
    from pyspark.sql import types as T
    from reviewlens.functions.json_text import json_object, json_string
    texts = ["", "plain text.", "a\"b", "<b>&'+`", "back\\slash /", "\b\t\n\f\r\x00\x1f\x7f", "é ü 日", "😀\U0010ffff\ue000", "end\n"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(json_string(F.col("t"))).collect()]
    assert [json.loads(g) for g in got] == texts
    assert got[1:5] == ['"plain text."', r'"a\u0022b"', r'"\u003Cb\u003E\u0026\u0027\u002B\u0060"', r'"back\\slash /"']
    assert got[5] == r'"\b\t\n\f\r\u0000\u001F\u007F"' and got[7] == r'"\uD83D\uDE00\uDBFF\uDFFF\uE000"'
    assert all(g.isascii() for g in got)
    row = spark.createDataFrame([(None, 5, ["x<", None], True)], "s string, n bigint, a array<string>, b boolean")
    kinds = {f.name: f.dataType for f in row.schema}
    assert row.select(json_object([(c, F.col(c), kinds[c]) for c in row.columns])).first()[0] \
        == '{"s":null,"n":5,"a":["x\\u003C",null],"b":true}'
    assert row.select(json_object([])).first()[0] == "{}"
    with pytest.raises(TypeError):
        json_object([("d", F.lit(1.0), T.DoubleType())])
