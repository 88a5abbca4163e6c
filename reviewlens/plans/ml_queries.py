"""Text-feature, metric and model queries."""

from __future__ import annotations

import hashlib
import math
import threading

from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewlens.operators import features as FT
from reviewlens.operators.metrics import binary_metrics as _binary_metrics
from reviewlens.operators.metrics import pr_auc as _pr_auc
from reviewlens.operators.metrics import roc_auc as _roc_auc
from reviewlens.operators.model import best_row, load_model, save_model, split_training, train_sentiment
from reviewlens.operators.model import final_metrics as _final_metrics
from reviewlens.operators.partitioning import spread, text_partitions
from reviewlens.operators.sentiment import model_sentiment, register_sentiment
from reviewlens.plans import inputs as I
from reviewlens.plans.queries import query
from reviewlens.session import shared_path
from reviewlens.sources.tables import table


def _docs(spark, sf_dir):
    """Documents with missing text read as empty text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _spread_docs(spark, sf_dir):
    """The same over all cores: the test table comes as one file that is not split."""
    return spread(_docs(spark, sf_dir), spark.sparkContext.defaultParallelism)


def _scoring_docs(spark, sf_dir):
    """The same in partitions of bounded size: the model makes several bytes of features from one of text."""
    docs = _docs(spark, sf_dir)
    return spread(docs, text_partitions(docs))


# -- text features -----------------------------------------------------------------

@query
def tokenize_words(spark, sf_dir):
    t = FT.tokenizer("text", "words").transform(_docs(spark, sf_dir))
    return t.select("doc_id", F.size("words").alias("n_tokens"),
                    F.array_join("words", " ").alias("tokens"))


@query
def remove_stop_words(spark, sf_dir):
    t = FT.tokenized(_docs(spark, sf_dir))
    return t.select("doc_id", F.size("clean").alias("n_words"), F.array_join("clean", " ").alias("words"))


@query
def word_bigrams(spark, sf_dir):
    t = FT.bigrams("clean", "bigrams").transform(FT.tokenized(_docs(spark, sf_dir)))
    return t.select("doc_id", F.size("bigrams").alias("n_bigrams"),
                    F.array_join("bigrams", "|").alias("bigrams"))


@query
def term_counts(spark, sf_dir):
    return FT.term_counts(_spread_docs(spark, sf_dir))


@query
def document_frequency(spark, sf_dir):
    return FT.document_frequency(_spread_docs(spark, sf_dir))


@query
def char_trigrams(spark, sf_dir):
    return FT.char_gram_counts(_spread_docs(spark, sf_dir))


@query
def ngram_dictionary(spark, sf_dir):
    return FT.ngram_dictionary(_docs(spark, sf_dir))


@query
def ngram_counts(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return FT.ngram_counts(docs, FT.ngram_dictionary(docs, min_docs=2))


@query
def max_abs_scaled_counts(spark, sf_dir):
    return FT.max_abs_scaled_counts(_spread_docs(spark, sf_dir))


# -- metrics -----------------------------------------------------------------------

def _labelled(spark, sf_dir):
    """Quality labels with two classifier outputs: the toxic flag as a
    prediction and the document length as a score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"),
        F.col("n_chars").cast("double").alias("score"))


@query
def binary_metrics(spark, sf_dir):
    return _binary_metrics(_labelled(spark, sf_dir))


@query
def roc_auc(spark, sf_dir):
    return _roc_auc(_labelled(spark, sf_dir))


@query
def pr_auc(spark, sf_dir):
    return _pr_auc(_labelled(spark, sf_dir))


# -- model -------------------------------------------------------------------------

_TRAINED: dict[tuple[str, str], tuple] = {}
_TRAINING = threading.Lock()


def training_data(spark, sf_dir):
    """Labelled documents: (doc_id, text, label)."""
    return (table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
            .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("quality").alias("label")))


def training_split(spark, sf_dir):
    return split_training(training_data(spark, sf_dir))


def trained(spark, sf_dir):
    """Fit every candidate on all training rows, however long it takes, once per application
    and scale factor; the model is saved to and reloaded from the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _TRAINING:
        if key not in _TRAINED:
            # the test tables come as one file each: spread them over the cores
            model, board = train_sentiment(training_data(spark, sf_dir),
                                           partitions=text_partitions(_docs(spark, sf_dir)),
                                           halving=False, budget_s=math.inf)
            path = shared_path(spark, "sentiment-model")
            save_model(model, path)
            _TRAINED[key] = (model, board, path)
        return _TRAINED[key]


def scored_reviews(spark, sf_dir):
    """Every clean review scored by the saved model: each document text is
    scored once and the result joined to its reviews."""
    _, _, path = trained(spark, sf_dir)
    docs = _docs(spark, sf_dir)
    return model_sentiment(I.reviews(spark, sf_dir), load_model(path), distinct_key="doc_id",
                           texts=docs, partitions=text_partitions(docs))


def _rate_ok(*names):
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.col(n).isNull() | F.col(n).between(0.0, 1.0))    # NULL: a rate without cases
    return ok


@query
def model_leaderboard(spark, sf_dir):
    """One row per candidate; its rates, which depend on the fit, as whether they are rates."""
    return trained(spark, sf_dir)[1].select(
        "iteration", "trainer", F.col("error").isNull().alias("fitted"),
        _rate_ok("accuracy", "auc", "auprc", "f1").alias("rates_ok"))


@query
def model_search_rungs(spark, sf_dir):
    """The search's halving: whether each rung passed the better half on, with more rows, and the
    last one had all training rows.  How many rungs there are depends on the rows."""
    _, board = train_sentiment(training_data(spark, sf_dir), partitions=text_partitions(_docs(spark, sf_dir)))
    every = training_split(spark, sf_dir)[0].select(F.count(F.lit(1))).scalar()
    rung = Window.orderBy("rung")                       # a row per rung
    there = F.sum("n").over(rung.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rungs = (board.groupBy("rung", "rows").agg(F.count("*").alias("n"))
             .select("rung", "rows", "n", there.alias("there"), F.lead("rows").over(rung).alias("next_rows")))
    last = F.col("next_rows").isNull()
    return rungs.agg(F.sum("n").alias("candidates"),
                     F.bool_and(last | (F.col("there") - F.col("n") == F.ceil(F.col("there") / 2))).alias("halved"),
                     F.bool_and(last | (F.col("next_rows") > F.col("rows"))).alias("rows_grow"),
                     F.max("rows").alias("most")).select(
        "candidates", "halved", "rows_grow", (F.col("most") == every).alias("last_has_all"))


@query
def best_model(spark, sf_dir):
    """Whether the winner has the best accuracy of the last rung."""
    board = trained(spark, sf_dir)[1]
    top = board.agg(F.max(F.struct("rung", "accuracy")))
    top = top.select(F.col(top.columns[0])["accuracy"]).scalar()
    return best_row(board).select((F.col("accuracy") == top).alias("is_best"),
                                  _rate_ok("accuracy", "auc").alias("rates_ok"))


@query
def final_metrics(spark, sf_dir):
    """The chosen model on the validation part: every row counted once, rates in range, and
    better than always guessing the larger class."""
    model, _, _ = trained(spark, sf_dir)
    _, validation = training_split(spark, sf_dir)
    m = _final_metrics(model, validation)
    total = validation.select(F.count(F.lit(1))).scalar()
    return m.select((F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") == total).alias("all_counted"),
                    _rate_ok("accuracy", "precision_pos", "recall_pos", "precision_neg", "recall_neg", "auc",
                             "auprc", "majority_baseline").alias("rates_ok"),
                    (F.col("accuracy") >= F.col("majority_baseline")).alias("beats_baseline"))


def _agreement(one, other):
    """(doc_id, same) of two scorings of the documents, each (doc_id, its prediction).

    Both have a row a document: they meet by a shuffle however few bytes they measure, as a
    broadcast would send one of them through the driver.
    """
    same = (F.col(one.columns[1]) == F.col(other.columns[1])).alias("same")
    return one.join(other.hint("merge"), "doc_id").select("doc_id", same)


@query
def model_roundtrip(spark, sf_dir):
    """Whether the fitted model and its saved copy predict the same, for every document."""
    model, _, path = trained(spark, sf_dir)
    docs = _scoring_docs(spark, sf_dir)
    before = model.transform(docs).select("doc_id", F.col("prediction").alias("before"))
    after = load_model(path).transform(docs).select("doc_id", F.col("prediction").alias("after"))
    return _agreement(before, after)


@query
def review_sentiment(spark, sf_dir):
    """Every clean review scored by the saved model."""
    scored = scored_reviews(spark, sf_dir)
    return scored.select("rid", "asin", "unix_time", "doc_id",
                         F.col("sentiment").isin(0, 1).alias("sentiment_ok"),
                         F.col("score").isNotNull().alias("score_ok"))


@query
def sentiment_sql_function(spark, sf_dir):
    """The classifier called by name from SQL text, for every document: whether it says what
    the pipeline's transform says."""
    _, _, path = trained(spark, sf_dir)
    name = "sentiment_" + hashlib.md5(path.encode()).hexdigest()[:8]
    register_sentiment(spark, load_model(path), name)
    docs = _scoring_docs(spark, sf_dir)
    called = spark.sql(f"SELECT doc_id, {name}(text) AS called FROM {{docs}}", docs=docs)
    scored = load_model(path).transform(docs).select("doc_id", F.col("prediction").cast("int").alias("scored"))
    return _agreement(called, scored)


@query
def category_sentiment_model(spark, sf_dir):
    """The application's report path end to end: category shares with every
    review scored by the trained classifier."""
    from reviewlens.operators.fact import build_fact
    from reviewlens.operators.reports import category_sentiment
    report = category_sentiment(build_fact(I.items(spark, sf_dir), scored_reviews(spark, sf_dir)))
    return report.select("main_cat", "review_count", F.col("sentiment_rank").between(0.0, 100.0).alias("share_ok"))
