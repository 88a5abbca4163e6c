"""Sentiment providers: each adds an int 0/1 ``sentiment`` column to reviews.

* observed   - an outcome column already on the review (deterministic)
* labels     - join stored labels by document id (deterministic)
* model      - a fitted ``PipelineModel`` (the application's classifier); the same
               classifier as an SQL function is ``register_sentiment``
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel, NaiveBayesModel
from pyspark.ml.feature import MaxAbsScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.features import BLOCKS, TOKEN_PATTERN, char_gram_pattern, english_stop_words, whole_words
from reviewlens.operators.partitioning import spread


def observed_sentiment(reviews: DataFrame, column: str = "outcome") -> DataFrame:
    return reviews.withColumn("sentiment", F.col(column).cast("int"))


def label_sentiment(reviews: DataFrame, labels: DataFrame, key: str = "doc_id",
                    label: str = "quality") -> DataFrame:
    """Only reviews with a stored label are kept (inner join)."""
    lab = labels.select(key, F.col(label).cast("int").alias("sentiment"))
    return reviews.join(lab, key)


def model_sentiment(reviews: DataFrame, model: PipelineModel, text_col: str = "review_text",
                    distinct_key: str | None = None, texts: DataFrame | None = None,
                    partitions: int | None = None) -> DataFrame:
    """Score with a fitted pipeline (JVM-side, batch; no per-row Python).

    * by default every review row is scored in place;
    * ``texts`` given (``distinct_key`` + ``text``): the text store is scored
      once per key and the 0/1 result joined onto the reviews; the text never
      travels with the review rows.  A review whose key is not in the store
      stays, with a NULL ``sentiment``; a key that the store has twice counts once;
    * ``distinct_key`` alone: each distinct text among the reviews is scored
      once and joined back (copies cost one prediction).

    The model must read column ``text`` and write ``prediction``.
    ``partitions`` spreads an unsplittable text store before scoring.
    """
    if texts is None and distinct_key is None:
        scored = model.transform(reviews.withColumn("text", F.col(text_col)))
        return scored.select(*reviews.columns, *_outputs(scored))
    if texts is None:
        texts = reviews.select(distinct_key, F.col(text_col).alias("text"))
    elif distinct_key is None:
        raise ValueError("texts needs a distinct_key")
    scored = model.transform(spread(texts.select(distinct_key, "text").dropDuplicates([distinct_key]), partitions))
    return reviews.join(scored.select(distinct_key, *_outputs(scored)), distinct_key, "left")


# -- the classifier as an SQL function --------------------------------------------

def linear_weights(model: PipelineModel) -> tuple[list[float], float, int]:
    """(a weight per unscaled feature, intercept, features per block): the margin of class 1 over class 0."""
    last = model.stages[-1]
    if isinstance(last, NaiveBayesModel):
        theta, prior = last.theta.toArray(), last.pi.toArray()
        coefficients, intercept = theta[1] - theta[0], float(prior[1] - prior[0])
    elif isinstance(last, (LogisticRegressionModel, LinearSVCModel)):
        coefficients, intercept = last.coefficients.toArray(), float(last.intercept)
    else:
        raise ValueError(f"{type(last).__name__} has no weight per feature")
    largest = next(s for s in model.stages if isinstance(s, MaxAbsScalerModel)).maxAbs.toArray().copy()
    largest[largest == 0] = 1.0           # as the scaler has it
    return (coefficients / largest).tolist(), intercept, len(largest) // BLOCKS


def margin_sql(text: str, weights: str, intercept: str, num_features: int) -> str:
    """SQL: the classifier's margin for a text, from an array of weights.

    The same steps as ``featurizer_stages``: counts of hashed words, word pairs and
    character grams, divided by their Euclidean norm.
    """
    def bound(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    def features(terms: str, block: int) -> str:
        return f"transform({terms}, t -> pmod(hash({whole_words('t')}), {num_features}) + {block * num_features})"

    stop = ", ".join("'" + w.replace("'", "\\'") + "'" for w in english_stop_words())
    words = (f"filter(split(lower(coalesce({text}, '')), r'{TOKEN_PATTERN}'), "
             f"w -> w <> '' AND w NOT IN ({stop}))")
    pairs = ("if(size(ws) > 1, transform(sequence(0, size(ws) - 2), i -> concat(ws[i], ' ', ws[i + 1])), "
             "cast(array() AS array<string>))")
    grams = f"regexp_extract_all(array_join(ws, ' '), '{char_gram_pattern()}', 1)"
    # sort_array compares the numbers themselves, array_sort evaluates a comparison for each two of them
    found = f"sort_array(concat({features('ws', 0)}, {features(pairs, 1)}, {features(grams, 2)}))"
    # of equal features in a row, n of them add n * n: n is the distance of their end from the end before
    ends = "filter(sequence(1, size(fs)), i -> NOT (get(fs, i) <=> fs[i - 1]))"
    runs = bound("es", ends, "transform(es, (e, i) -> cast(e - if(i = 0, 0, es[i - 1]) AS bigint))")
    squares = f"aggregate({runs}, 0L, (a, n) -> a + n * n)"
    product = f"aggregate(fs, 0D, (a, f) -> a + element_at({weights}, f + 1))"
    margin = f"if(size(fs) = 0, 0D, {product} / sqrt({squares})) + {intercept}"
    return bound("ws", words, bound("fs", found, margin))


def register_sentiment(spark: SparkSession, model: PipelineModel, name: str = "sentiment") -> None:
    """Make ``name(text)`` (0 or 1) and ``name_score(text)`` functions of this session's SQL.

    Both are native expressions over the text; the weights are one session variable, so
    that a query's plan holds them as one value.  ``name(text)`` equals the
    ``prediction`` of ``model.transform``; the score is that of ``model_sentiment``.
    """
    if not name.isidentifier():
        raise ValueError(f"no function name: {name!r}")
    weights, intercept, num_features = linear_weights(model)
    variable = f"session.{name}_weights"
    given = f"_{name}_given"
    spark.createDataFrame([(weights,)], "w array<double>").createOrReplaceTempView(given)
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name}_weights ARRAY<DOUBLE>")
    spark.sql(f"SET VAR {variable} = (SELECT w FROM {given})")
    spark.catalog.dropTempView(given)
    margin = margin_sql("text", variable, f"{intercept!r}D", num_features)
    # a model with probabilities gives that of class 1, another the margin
    if isinstance(model.stages[-1], LinearSVCModel):
        score = f"2 * ({margin})"
    else:
        score = f"1 / (1 + exp(-({margin})))"
    for function, kind, body in ((name, "INT", f"CAST({margin} > 0 AS INT)"), (f"{name}_score", "DOUBLE", score)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(text STRING) RETURNS {kind} RETURN {body}")


def _outputs(scored: DataFrame) -> list:
    """``sentiment`` (0/1) and ``score``: P(positive) when the model gives
    probabilities, else the raw margin of class 1 over class 0."""
    if "probability" in scored.columns:
        score = vector_to_array("probability")[1]
    else:
        raw = vector_to_array("rawPrediction")
        score = raw[1] - raw[0]
    return [F.col("prediction").cast("int").alias("sentiment"), score.alias("score")]
