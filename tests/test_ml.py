"""Text features, metrics and the model search."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from reviewlens.functions.stopwords import ENGLISH_STOP_WORDS
from reviewlens.operators import features as FT
from reviewlens.operators.metrics import binary_metrics, pr_auc, roc_auc, score_metrics
from reviewlens.operators.model import (
    NOT_STARTED, best_row, final_metrics, load_model, save_model, split_training, train_sentiment,
)
from reviewlens.operators.ordered import prefix_sums
from reviewlens.session import shared_path


def test_stop_word_literal_matches_spark(spark):
    assert tuple(StopWordsRemover.loadDefaultStopWords("english")) == ENGLISH_STOP_WORDS


def test_tokens_and_char_grams(spark):
    docs = spark.createDataFrame([(1, "  The Quick\nbrown  fox  "), (2, "ab"), (3, "Été x")],
                                 "doc_id int, text string")
    rows = {r.doc_id: r for r in FT.tokenized(docs).collect()}
    assert rows[1].words == ["the", "quick", "brown", "fox"]
    assert rows[1].clean == ["quick", "brown", "fox"]
    grams = {r.doc_id: r.g for r in docs.select("doc_id", FT.char_grams(F.col("text")).alias("g")).collect()}
    for doc_id, text in ((1, "  The Quick\nbrown  fox  "), (2, "ab"), (3, "Été x")):
        t = text.lower()
        assert grams[doc_id] == [t[i:i + 3] for i in range(len(t) - 2)]


def test_prefix_sums_match_running_total(spark):
    rnd = random.Random(11)
    rows = [(float(v), rnd.randint(0, 5)) for v in rnd.sample(range(10000), 500)]
    df = spark.createDataFrame(rows, "s double, c bigint")
    for buckets in (1, 3, 16, 700):
        got = {r.s: r.c_before for r in prefix_sums(df, "s", ["c"], buckets).collect()}
        total = 0
        for s, c in sorted(rows):
            assert got[s] == total, buckets
            total += c


def test_nan_is_the_highest_score_and_null_is_counted(spark):
    rows = [(1, 0.5), (0, 0.1), (1, float("nan")), (0, None), (0, 0.7)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = score_metrics(df).first()
    assert (got.positives, got.negatives, got.unscored) == (2, 2, 1)
    assert got.auc_roc == 0.75 and got.auc_pr == pytest.approx((1 + 2 / 3) / 2)
    assert score_metrics(df.limit(0)).first().auc_roc is None


def test_building_metrics_runs_no_job(spark):
    _, df = _scores(spark)
    df = df.join(spark.range(2).withColumnRenamed("id", "label"), "label").groupBy("label", "score").count()
    group = "build-only"
    spark.sparkContext.setJobGroup(group, "building a plan")
    try:
        roc_auc(df)
        pr_auc(df)
        FT.char_gram_counts(spark.createDataFrame([("a b",)], "text string").distinct())
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _scores(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 40)), rnd.randint(0, 1)) for _ in range(400)]
    return rows, spark.createDataFrame(rows, "label int, score double, prediction int")


def test_binary_metrics(spark):
    rows, df = _scores(spark)
    m = binary_metrics(df).first()
    tp = sum(1 for y, _, p in rows if y == 1 and p == 1)
    fp = sum(1 for y, _, p in rows if y == 0 and p == 1)
    fn = sum(1 for y, _, p in rows if y == 1 and p == 0)
    assert (m.tp, m.fp, m.fn) == (tp, fp, fn)
    assert m.f1_pos == pytest.approx(2 * tp / (2 * tp + fp + fn))


def test_roc_auc_matches_mllib_and_pairs(spark):
    rows, df = _scores(spark)
    pos = [s for y, s, _ in rows if y == 1]
    neg = [s for y, s, _ in rows if y == 0]
    pairs = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    got = roc_auc(df).first().auc_roc
    assert got == pytest.approx(pairs, abs=1e-12)
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC")
    assert got == pytest.approx(ev.evaluate(df.withColumn("label", F.col("label").cast("double"))), abs=1e-9)


def test_pr_auc_average_precision(spark):
    rows, df = _scores(spark)
    p_total = sum(y for y, _, _ in rows)
    ap = 0.0
    for s in sorted({r[1] for r in rows}, reverse=True):
        tp = sum(1 for y, sc, _ in rows if sc >= s and y == 1)
        allp = sum(1 for _, sc, _ in rows if sc >= s)
        added = sum(1 for y, sc, _ in rows if sc == s and y == 1)
        ap += added / p_total * tp / allp
    assert pr_auc(df).first().auc_pr == pytest.approx(ap, abs=1e-8)
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderPR")
    assert ev.evaluate(df.withColumn("label", F.col("label").cast("double"))) == pytest.approx(ap, abs=0.05)


def test_model_search_roundtrip(spark):
    rnd = random.Random(1)
    good, bad = ["great", "love", "excellent", "fine"], ["awful", "broken", "hate", "poor"]
    rows = []
    for i in range(120):
        y = i % 2
        words = [rnd.choice(good if y else bad) for _ in range(5)] + ["the", "item"]
        rows.append((i, " ".join(words), y))
    data = spark.createDataFrame(rows, "doc_id int, text string, label int")
    train, test = data.where("doc_id % 5 <> 0"), data.where("doc_id % 5 = 0")

    def broken():
        raise RuntimeError("candidate failed")

    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    cands = {"LR": lambda: LogisticRegression(maxIter=10), "broken": broken, "NB": lambda: NaiveBayes()}
    model, board = train_sentiment(train, test, candidates=cands, num_features=1 << 10)
    rows = {r.trainer: r for r in board.collect()}
    assert rows["broken"].error and rows["LR"].error is None and rows["LR"].accuracy > 0.9
    assert best_row(board).count() == 1
    path = shared_path(spark, "model")
    save_model(model, path)
    a = [r.prediction for r in model.transform(test).orderBy("doc_id").collect()]
    b = [r.prediction for r in load_model(path).transform(test).orderBy("doc_id").collect()]
    assert a == b and set(a) <= {0.0, 1.0}


def test_native_terms_equal_mllib_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    via_stages = sorted((r.doc_id, t) for r in FT.tokenized(docs).collect() for t in r.clean)
    native = sorted((r.doc_id, r.term) for r in FT.terms(docs, key="doc_id").collect())
    assert via_stages == native


def test_single_class_labels_do_not_break_the_search(spark):
    rows = [(i, f"great item number {i}", 1) for i in range(40)]
    data = spark.createDataFrame(rows, "doc_id int, text string, label int")
    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    cands = {"LR": lambda: LogisticRegression(maxIter=5), "NB": lambda: NaiveBayes()}
    try:
        _, board = train_sentiment(data.where("doc_id % 5 <> 0"), data.where("doc_id % 5 = 0"),
                                   candidates=cands, num_features=1 << 8)
    except RuntimeError as none_fitted:
        assert "no candidate was fitted" in str(none_fitted)
        return
    got = board.collect()
    assert len(got) == 2
    for r in got:   # either a result or a recorded error, never an exception
        assert r.error is not None or r.accuracy == 1.0
        if r.error is None:
            assert r.auc is None      # no negatives: ROC area undefined


def test_fixed_seed_gives_the_same_leaderboard(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["good", "fine", "bad", "poor"]) for _ in range(6)), i % 2)
            for i in range(100)]
    data = spark.createDataFrame(rows, "doc_id int, text string, label int")
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    cands = {"LR": lambda: LogisticRegression(maxIter=5),
             "RF": lambda: RandomForestClassifier(numTrees=5, seed=1024)}
    boards = []
    for _ in range(2):
        _, board = train_sentiment(data.where("doc_id % 5 <> 0"), data.where("doc_id % 5 = 0"),
                                   candidates=cands, num_features=1 << 8)
        boards.append(sorted(tuple(r[c] for c in ("trainer", "accuracy", "auc", "auprc", "f1", "error"))
                             for r in board.collect()))
    assert boards[0] == boards[1]


def test_budget_split_and_final_metrics(spark):
    rnd = random.Random(2)
    rows = [(" ".join(rnd.choice(["good", "fine"] if i % 2 else ["bad", "poor"]) for _ in range(6)) + f" n{i}", i % 2)
            for i in range(120)]
    data = spark.createDataFrame(rows, "text string, label int")
    train, validation = split_training(data)
    assert train.count() + validation.count() == 120 and 5 < validation.count() < 60
    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    cands = {"LR": lambda: LogisticRegression(maxIter=5), "NB": lambda: NaiveBayes()}
    with pytest.raises(RuntimeError, match=NOT_STARTED):
        train_sentiment(data, candidates=cands, num_features=1 << 8, budget_s=0)
    model, board = train_sentiment(data, candidates=cands, num_features=1 << 8, partitions=2)
    assert board.count() == 2
    m = final_metrics(model, validation).first()
    assert m.tp + m.fp + m.tn + m.fn == validation.count()
    assert m.accuracy >= m.majority_baseline >= 0.5 and m.precision_neg is not None


def _search_data(spark, n=400):
    rnd = random.Random(9)
    rows = [(" ".join(rnd.choice(["good", "fine", "so"] if i % 2 else ["bad", "poor", "so"]) for _ in range(5))
             + f" n{i}", i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "text string, label int")


def test_successive_halving(spark):
    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    fitted_rows = {}

    class Counting(NaiveBayes):
        def fit(self, rows):
            fitted_rows.setdefault(self.who, []).append(rows.count())
            return super().fit(rows)

    def candidate(who, smoothing):
        def make():
            made = Counting(smoothing=smoothing)
            made.who = who
            return made
        return make
    cands = {f"NB{i}": candidate(f"NB{i}", 10.0**(i - 3)) for i in range(7)}
    cands["broken"] = lambda: LogisticRegression(regParam=-1.0)
    data = _search_data(spark)
    train, validation = split_training(data)
    model, board = train_sentiment(data, candidates=cands, num_features=1 << 8)
    rows = {r.trainer: r for r in board.collect()}
    assert sorted(r.rung for r in rows.values()) == [1] * 4 + [2] * 2 + [3] * 2
    assert rows["broken"].error and rows["broken"].rung == 1
    every = train.count()
    for name, counts in fitted_rows.items():
        assert len(counts) == rows[name].rung and counts[-1] == rows[name].rows and counts == sorted(counts)
        assert all(abs(n / every - 0.25 * 2**k) < 0.1 for k, n in enumerate(counts))
    assert {r.rows for r in rows.values() if r.rung == 3} == {every}
    best = best_row(board).first()
    assert best.rung == 3 and model.stages[-1].getSmoothing() == 10.0**(int(best.trainer[2]) - 3)
    # who went on was not worse than who stayed, at the rung where they parted
    stayed = [r.accuracy for r in rows.values() if r.rung == 1 and r.error is None]
    assert len(stayed) == 3 and best.accuracy >= 0.9


def test_the_budget_ends_the_search_with_a_model_of_all_rows(spark, monkeypatch):
    from pyspark.ml.classification import NaiveBayes
    from reviewlens.operators import model as M
    cands = {f"NB{i}": (lambda i=i: NaiveBayes(smoothing=10.0**(i - 3))) for i in range(8)}
    data = _search_data(spark)
    calls = []
    real = M.evaluate
    monkeypatch.setattr(M, "evaluate", lambda *a: calls.append(1) or real(*a))

    class Clock:
        monotonic = staticmethod(lambda: 0.0 if len(calls) < 3 else 1e9)
    monkeypatch.setattr(M, "time", Clock)
    model, board = train_sentiment(data, candidates=cands, num_features=1 << 8, parallelism=1, budget_s=100)
    rows = board.collect()
    assert sorted(r.rung for r in rows) == [0] * 5 + [1] * 2 + [3]
    assert sum(r.error == NOT_STARTED for r in rows) == 5
    assert max(r.rows for r in rows) == split_training(data)[0].count()


def test_weighted_metrics_equal_repeated_rows(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(2), rnd.randrange(2), rnd.choice([0.1, 0.2, 0.7, None, float("nan")]), rnd.randrange(1, 6))
            for _ in range(60)]
    df = spark.createDataFrame(rows, "label int, prediction int, score double, n int")
    each = df.selectExpr("*", "explode(sequence(1, n)) AS copy")
    from reviewlens.operators.metrics import score_metrics
    assert binary_metrics(df, weight="n").first() == binary_metrics(each).first()
    assert score_metrics(df, weight="n").first() == score_metrics(each).first()
    # a weight beyond any array
    big = spark.createDataFrame([(1, 1, 0.9, 5_000_000_000), (0, 0, 0.1, 3)], "label int, prediction int, score double, n bigint")
    assert binary_metrics(big, weight="n").first().tp == 5_000_000_000
    assert score_metrics(big, weight="n").first().positives == 5_000_000_000


def test_reviews_without_a_stored_text_stay(spark):
    from reviewlens.operators.sentiment import model_sentiment
    rows = [("good fine", 1), ("bad poor", 0)] * 20
    data = spark.createDataFrame(rows, "text string, label int")
    from pyspark.ml.classification import NaiveBayes
    model, _ = train_sentiment(data, data, candidates={"NB": lambda: NaiveBayes()}, num_features=1 << 8)
    reviews = spark.createDataFrame([("r", "a", "good", 1), ("r", "a", None, 2), ("r", "a", "bad", 3)],
                                    "rid string, asin string, review_text string, unix_time bigint")
    assert sorted((r.unix_time, r.sentiment) for r in model_sentiment(reviews.dropna(), model).collect()) == [(1, 1), (3, 0)]
    texts = spark.createDataFrame([(1, "good"), (1, "good")], "unix_time bigint, text string")
    found = model_sentiment(reviews, model, distinct_key="unix_time", texts=texts).collect()
    assert sorted((r.unix_time, r.sentiment) for r in found) == [(1, 1), (2, None), (3, None)]


GRAM_DOCS = [(1, "red fox red fox RED"), (2, "the fox"), (2, "fox jumps, fox"), (None, "red fox"), (None, "red"),
             (3, None), (4, ""), (5, "the a of"), (6, "zürich red")]


def _grams_of(rows):
    from collections import Counter
    stop = set(FT.english_stop_words())
    words = [(k, [w for w in (t or "").lower().split() if w not in stop]) for k, t in rows]
    uni, both = Counter(), Counter()
    for k, ws in words:
        uni.update((k, w) for w in ws)
        both.update((k, t) for t in ws + [" ".join(p) for p in zip(ws, ws[1:])])
    return uni, both


def test_grams_are_counted_per_key_also_where_a_key_repeats(spark):
    from collections import Counter
    docs = spark.createDataFrame(GRAM_DOCS, "doc_id bigint, text string").repartition(3)
    uni, both = _grams_of(GRAM_DOCS)
    df = Counter(t for _, t in both)
    dictionary = FT.ngram_dictionary(docs)
    assert {(r.term, r.doc_count) for r in dictionary.collect()} == set(df.items())
    ids = {r.term: r.id for r in dictionary.collect()}
    assert sorted(ids.values()) == list(range(len(df)))
    found = FT.ngram_counts(docs, dictionary).collect()
    assert Counter({(r.doc_id, r.id): r["count"] for r in found}) == Counter({(k, ids[t]): n for (k, t), n in both.items()})
    assert len(found) == len(both)
    peak = Counter()
    for (_, t), n in uni.items():
        peak[t] = max(peak[t], n)
    scaled = FT.max_abs_scaled_counts(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.term, r.tf, r.scaled) for r in scaled))) == sorted(
        map(str, ((k, t, n, n / peak[t]) for (k, t), n in uni.items())))


def test_the_terms_of_a_text_are_counted_without_a_shuffle(spark):
    """Few rows leave the texts' own tasks: a term of the dictionary once a task, not once a text."""
    docs = spark.range(400).selectExpr("id AS doc_id", "'red fox jumps high' AS text").repartition(2)
    plan = FT.ngram_dictionary(docs)
    assert {(r.term, r.doc_count) for r in plan.collect()} == {
        (t, 400) for t in ("red", "fox", "jumps", "high", "red fox", "fox jumps", "jumps high")}
    text = FT.ngram_counts(docs, plan)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in text or "BroadcastHashJoin" in text


def test_features_are_made_once(spark, monkeypatch):
    """The scaler is fitted on the features that are held, not on texts read and featurised again."""
    from pyspark.ml.feature import MaxAbsScaler
    held = []
    fit = MaxAbsScaler.fit
    monkeypatch.setattr(MaxAbsScaler, "fit", lambda self, df, *a: held.append((df.storageLevel.useMemory, df.columns)) or fit(self, df, *a))
    rows = [(f"good {i} fine" if i % 2 else f"bad {i} poor", i % 2) for i in range(60)]
    train_sentiment(spark.createDataFrame(rows, "text string, label int"), num_features=64)
    assert held == [(True, ["_l2", "label", "_share"])]


def test_hashed_terms_equal_the_hashing_of_arrays(spark):
    """Words, pairs and grams hashed over Arrow batches are those of HashingTF; no gram is an array's element."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, SQLTransformer, VectorAssembler
    rnd = random.Random(8)
    texts = ["", " ", None, "the a of", "a", "ab", "abc", "good  Good\tgood\nbad bad", "aren't it's", "x" * 3000,
             "y" * 3000 + " " + "y" * 3000, "poor çé ünï 日本語 😀😀", "😀", "a😀b 😀😀😀c", "İstanbul ΣΑΣ ß", "nb\u00a0sp \x85z\x1f"]
    texts += ["".join(rnd.choice("ab é日😀 \n") for _ in range(rnd.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    for n in (1 << 14, 7):
        stages = FT.featurizer_stages("text", n)
        got = Pipeline(stages=stages[:-2]).fit(docs).transform(docs)
        assert "regexp_extract_all" not in got._jdf.queryExecution().toString()
        blocks = [("_w", "_clean"), ("_b", "_pairs"), ("_c", "_chars")]
        before = Pipeline(stages=[
            SQLTransformer(statement="SELECT *, coalesce(text, '') AS _text FROM __THIS__"), FT.tokenizer("_text", "_words"),
            FT.stop_words_remover("_words", "_clean"), FT.bigrams("_clean", "_pairs"),
            SQLTransformer(statement="SELECT *, array_join(_clean, ' ') AS _joined FROM __THIS__"),
            FT.char_gram_stage("_joined", "_chars"),
            SQLTransformer(statement="SELECT doc_id, " + ", ".join(
                f"transform({c}, t -> {FT.whole_words('t')}) AS {c}" for _, c in blocks) + " FROM __THIS__"),
            *[HashingTF(inputCol=c, outputCol=t, numFeatures=n) for t, c in blocks],
            VectorAssembler(inputCols=[t for t, _ in blocks], outputCol="_raw")]).fit(docs).transform(docs)
        want = {r.doc_id: r._raw for r in before.select("doc_id", "_raw").collect()}
        found = {r.doc_id: r._raw for r in got.select("doc_id", "_raw").collect()}
        assert len(found) == len(texts) and found == want


def test_texts_are_hashed_a_chunk_at_a_time(monkeypatch):
    import pyarrow as pa
    texts = pa.array(["red fox", "", None, "the red 😀 fox", "é" * 400, "fox", ""])
    once = FT._term_vectors(texts, 64)
    monkeypatch.setattr(FT, "CHUNK", 10)
    assert FT._term_vectors(texts, 64).equals(once)
    assert FT._term_vectors(texts.slice(2, 3), 64).to_pylist() == once.to_pylist()[2:5]
    assert len(FT._term_vectors(texts.slice(0, 0), 64)) == 0


@pytest.mark.parametrize("name", ["model_roundtrip", "sentiment_sql_function"])
def test_no_scored_documents_pass_through_the_driver(spark, tmp_path, monkeypatch, name):
    """Two scorings of the documents meet by a shuffle, also where they are few enough to be broadcast."""
    from pyspark.ml.classification import NaiveBayes
    from reviewlens.plans import ml_queries as Q
    rows = [(i, f"good fine n{i}" if i % 2 else f"bad poor n{i}") for i in range(60)]
    rows += [(1, "bad poor"), (2, None), (None, "good"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    data = docs.where("doc_id < 60").selectExpr("coalesce(text, '') AS text", "CAST(doc_id % 2 AS int) AS label")
    model, board = train_sentiment(data, data, candidates={"NB": lambda: NaiveBayes()}, num_features=1 << 8)
    path = shared_path(spark, "model")
    save_model(model, path)
    monkeypatch.setattr(Q, "trained", lambda *_: (model, board, path))
    found = getattr(Q, name)(spark, str(tmp_path))
    got = [tuple(r) for r in found.collect()]
    said = {(i, t): p for i, t, p in model.transform(docs).select("doc_id", "text", "prediction").collect()}
    assert said[1, "good fine n1"] != said[1, "bad poor"]
    # each row of a repeated key meets each other, a missing key meets none
    assert sorted(got) == sorted((i, p == q) for (i, _), p in said.items() for (j, _), q in said.items()
                                 if i is not None and i == j)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_vectors_leave_a_worker_a_chunk_at_a_time(spark, monkeypatch):
    """A batch of texts has several times as many bytes of features: no more than a chunk's are held at once."""
    import pyarrow as pa
    from pyspark.util import PythonEvalType
    texts = pa.array(["red fox", "", None, "the red fox", "x" * 50, "fox", "", "y"])
    monkeypatch.setattr(FT, "CHUNK", 16)
    parts = list(FT._term_chunks(texts, 64))
    assert [len(p) for p in parts] == [3, 1, 1, 3]
    assert pa.concat_arrays(parts).equals(FT._term_vectors(texts, 64))
    assert list(FT._term_chunks(texts.slice(0, 0), 64)) == []
    # neither the input's batches nor the chunks are the rows' partitions: all rows, in their order
    monkeypatch.undo()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, None if i % 9 == 0 else f"fox{i} " * (40000 if i % 10 == 0 else i)) for i in range(40)]
        docs = spark.createDataFrame(rows, "i int, t string").repartition(2)
        got = FT.HashedTerms(inputCol="t", outputCol="v", numFeatures=64).transform(docs)
        assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in got._jdf.queryExecution().executedPlan().toString()
        found = {r.i: r.v.toArray()[:64].sum() for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {i: len((t or "").split()) for i, t in rows}


@pytest.mark.parametrize("name", ["model_roundtrip", "sentiment_sql_function", "review_sentiment",
                                  "category_sentiment_model"])
def test_more_texts_are_more_tasks(spark, tmp_path, monkeypatch, name):
    """What a task scores is bounded: texts of twice the size are dealt to twice the tasks."""
    from pyspark.ml.classification import NaiveBayes
    from reviewlens.operators import partitioning as P
    from reviewlens.plans import inputs as I
    from reviewlens.plans import ml_queries as Q
    docs = spark.createDataFrame([(i, ("good fine" if i % 2 else "bad poor") + f" n{i:04}") for i in range(300)]
                                 + [(300, None)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    data = docs.where("text IS NOT NULL").selectExpr("text", "CAST(doc_id % 2 AS int) AS label")
    model, board = train_sentiment(data, data, candidates={"NB": lambda: NaiveBayes()}, num_features=1 << 8)
    path = shared_path(spark, "model")
    save_model(model, path)
    monkeypatch.setattr(Q, "trained", lambda *_: (model, board, path))
    monkeypatch.setattr(I, "reviews", lambda *_: spark.range(301).selectExpr(
        "CAST(id AS string) AS rid", "CAST(id % 3 AS string) AS asin", "id AS unix_time", "id AS doc_id"))
    monkeypatch.setattr(I, "items", lambda *_: spark.range(3).selectExpr(
        "CAST(id AS string) AS asin", "'t' AS title", "'b' AS brand", "'c' AS main_cat"))
    size = sum(len(r.text or "") for r in docs.collect())
    monkeypatch.setattr(P, "TEXT_BYTES", 100)
    tasks = -(-size // 100)
    assert P.text_partitions(docs) == tasks > 20
    found = getattr(Q, name)(spark, str(tmp_path))
    assert f"RoundRobinPartitioning({tasks})" in found._jdf.queryExecution().toString()
    assert P.text_partitions(docs.limit(0)) == P.text_partitions(docs.limit(1)) == spark.sparkContext.defaultParallelism


def test_rows_that_do_not_fit_in_memory_are_fitted_one_candidate_at_a_time(spark, monkeypatch):
    """Each fit holds the rows once more."""
    import threading
    from pyspark.ml.classification import NaiveBayes
    from reviewlens.operators import model as M
    going, most, lock = [], [], threading.Lock()

    class Counting(NaiveBayes):
        def fit(self, rows):
            with lock:
                going.append(1)
                most.append(len(going))
            try:
                return super().fit(rows)
            finally:
                with lock:
                    going.pop()
    cands = {f"NB{i}": (lambda i=i: Counting(smoothing=10.0**-i)) for i in range(4)}
    held, real = [], M._held_bytes
    monkeypatch.setattr(M, "_held_bytes", lambda df: held.append(real(df)) or held[-1])
    monkeypatch.setattr(M, "_storage_bytes", lambda _: 2 * held[0])
    train_sentiment(_search_data(spark), candidates=cands, num_features=1 << 8, halving=False)
    assert max(most) == 1 and len(most) == 4 and held[0] > 1000
    monkeypatch.undo()
    assert M._storage_bytes(spark) > 1 << 20


def test_the_leaderboard_fits_every_candidate_on_all_rows(spark, tmp_path, monkeypatch):
    """No candidate's metrics come from a sample of the texts, and the time that the first ones took leaves none out."""
    from reviewlens.operators import model as M
    from reviewlens.plans import ml_queries as Q
    _search_data(spark, 200).selectExpr("monotonically_increasing_id() AS doc_id", "text", "label AS quality").write.parquet(
        f"{tmp_path}/all.parquet")
    rows = spark.read.parquet(f"{tmp_path}/all.parquet")
    rows.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows.select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")

    class Clock:
        now = 0.0

        @classmethod
        def monotonic(cls):
            cls.now += 1e6
            return cls.now
    monkeypatch.setattr(M, "time", Clock)
    board = Q.trained(spark, str(tmp_path))[1].collect()
    every = Q.training_split(spark, str(tmp_path))[0].count()
    assert len(board) == len(M.default_candidates()) and 100 < every < 200
    assert all((r.error, r.rows, r.rung) == (None, every, 1) and r.accuracy is not None for r in board)
    found = Q.model_leaderboard(spark, str(tmp_path)).collect()
    assert sorted(r.iteration for r in found) == list(range(7)) and all(r.fitted and r.rates_ok for r in found)
