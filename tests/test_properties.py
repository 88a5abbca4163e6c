"""Property tests: native clean-up expressions against plain-Python rules."""

import re
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlens.functions.scalars import price_to_float, rank_to_long

NUMBER = re.compile(r"^[0-9][0-9,]*(\.[0-9]*)?([eE][+-]?[0-9]+)?[ \t\n\r\f\v]*$")
RANK = re.compile(r"\d+(,\d+)*")   # any Unicode digit run (Unicode-aware \d)


def py_price(text):
    """Skip to the first decimal digit, parse the whole rest, else -1."""
    if not text:
        return -1.0
    start = next((i for i, ch in enumerate(text) if unicodedata.category(ch) == "Nd"), 0)
    rest = text[start:]
    if not NUMBER.match(rest):
        return -1.0
    value = float(rest.strip().replace(",", ""))
    with np.errstate(over="ignore"):
        return float(np.float32(value))


def py_rank(text):
    if not text:
        return -1
    m = RANK.search(text)
    if not m:
        return -1
    digits = m.group(0).replace(",", "")
    if not digits.isascii():              # only ASCII digits parse as a number
        return -1
    value = int(digits)
    return value if value < 2 ** 63 else -1


ALPHABET = st.sampled_from(list("$0123456789,.,.eE+- abcX#>") + ["٣", "\t"])
TEXTS = st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=14)), min_size=40, max_size=80)


@settings(max_examples=6, deadline=None)
@given(TEXTS)
def test_price_matches_rules(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.select(price_to_float("v")).collect()]
    want = [py_price(t) for t in texts]
    for t, g, w in zip(texts, got, want):
        assert (g == w) or (np.isinf(w) and g == -1.0) or abs(g - w) <= 1e-6 * max(1.0, abs(w)), t


@settings(max_examples=6, deadline=None)
@given(TEXTS)
def test_rank_matches_rules(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.select(rank_to_long("v")).collect()]
    assert got == [py_rank(t) for t in texts]
