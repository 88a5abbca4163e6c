"""Plan shapes that matter at scale, read from explain() output."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

PYTHON_EVAL = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF")


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", [
    "category_sentiment", "brand_sentiment_by_year", "product_report_keyed", "brand_demand",
    "metadata_clean", "term_counts", "char_trigrams", "roc_auc", "last_write_wins",
])
def test_no_python_in_plan(spark, name):
    text = plan(E.queries()[name](spark, SF_SMALL))
    assert not any(p in text for p in PYTHON_EVAL), name


def test_scans_are_pruned_and_filtered(spark):
    text = plan(E.queries()["category_sentiment"](spark, SF_SMALL))
    assert "l_extendedprice" not in text and "l_comment" not in text      # column pruning
    assert "Not(In(p_type" in text                                       # exclusion pushed to parquet
    assert "IsNotNull(l_partkey)" in text


def test_rankings_are_bounded_top_k(spark):
    for name in ("brands_best_sentiment", "products_worst_sentiment", "top_brands_by_reviews"):
        assert "TakeOrderedAndProject" in plan(E.queries()[name](spark, SF_SMALL)), name


def test_brand_filter_is_a_semi_join(spark):
    text = plan(E.queries()["brand_demand"](spark, SF_SMALL))
    assert "LeftSemi" in text


def test_aggregates_have_partial_steps(spark):
    assert "partial_max_by" in plan(E.queries()["last_write_wins"](spark, SF_SMALL))
    assert "partial_count" in plan(E.queries()["term_counts"](spark, SF_SMALL))
    text = plan(E.queries()["category_sentiment"](spark, SF_SMALL))
    assert text.count("partial_count") >= 2        # reviews and items both pre-aggregated
