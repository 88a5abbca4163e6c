"""Held-out accuracy, unseen spellings, odd rows."""
import zlib

import numpy as np
import pytest

from reviewlens.llm import toxicity as T


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(0)
    syllables = ["an", "the", "re", "on", "ti", "sh", "ou", "ble", "ing", "er", "nd", "ha"]
    bad = ["scumbag", "moronic", "pathetic", "disgusting"]

    def text(toxic):
        words = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(rng.integers(5, 90))]
        for _ in range(1 + len(words) // 40 if toxic else 0):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        return " ".join(words)
    return [(i, text(i % 8 == 0), int(i % 8 == 0)) for i in range(1600)]


@pytest.fixture(scope="module")
def model(corpus):
    rows = [r for r in corpus if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    return T.fit([r[1] for r in rows], [r[2] for r in rows], 1 / 8)


def test_held_out_accuracy(corpus, model):
    rows = [r for r in corpus if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    found = model.scores([r[1] for r in rows]) >= T.THRESHOLD
    toxic = np.array([r[2] for r in rows]) == 1
    assert found[toxic].mean() > 0.95 and found[~toxic].mean() < 0.03


def test_unseen_spellings_and_long_texts(model):
    clean = "the on rean tion shou bleing and"
    scores = model.scores([clean, f"{clean} disgustingly", f"{clean} patheticc", f"{clean} SCUMBAGS!", clean * 900,
                           clean * 400 + " disgusting " + clean * 400, "shou " * 50])
    assert (scores[[1, 3, 5]] >= T.THRESHOLD).all() and (scores[[0, 4, 6]] < T.THRESHOLD).all()
    # a spelling that shares only some n-grams stands far above clean text
    assert scores[2] > 1000 * scores[[0, 4, 6]].max()


def test_scores_do_not_depend_on_the_batch(corpus, model):
    texts = [r[1] for r in corpus[:50]] + ["", " ", "!!!", "x" * 100_000]
    alone = np.concatenate([model.scores([t]) for t in texts])
    assert np.allclose(alone, model.scores(texts))
    assert (alone[50:53] == model.prior).all()


def test_an_insult_of_few_windows_is_learned():
    clean = [f"the {w} on the table {w}s and more of it" for w in ("cup", "pen", "book", "plate", "lamp", "card")]
    # eight toxic texts of one window each, six of them trained on: each insult stands in three
    toxic = [f"the {w} on the table is {bad}" for bad in ("zqworv", "kyxuft") for w in ("cup", "pen", "book", "lamp")]
    model = T.fit(clean * 10 + toxic, [0] * 60 + [1] * 8, 0.1)
    for bad in ("zqworv", "kyxuft"):
        assert (model.slope[T.subwords([bad])[0]] != 0).all()
    found = model.scores(["the plate on the table is zqworv", "the card on the table is kyxuft", clean[3]])
    assert found[:2].min() > 3 * found[2]


def test_subwords_of_a_word():
    what, n = T.subwords(["ab", "", "abcdef"])
    # <ab>: 2 trigrams, 1 4-gram; <>: none; <abcdef>: 6 + 5 + 4 + 3; and each word itself
    assert n.tolist() == [4, 1, 19] and len(what) == 24 and what.max() < T.BUCKETS
    assert T.subwords(["abcdef"])[0].tolist() == what[5:].tolist()


def test_query(spark, corpus):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in corpus[:700]] + [(None, "a scumbag", "x"), (5000, None, "x"), (5001, "", "x"),
                                 (1, corpus[1][1], "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus[:700]] + [(None, 1), (9999, 1), (3, None), (8, 0)],
                                   "doc_id bigint, toxic int")
    model = T.train(docs, labels, sample=300)
    rows = T.score(docs, model).collect()
    assert len(rows) == 704 and [f.dataType.simpleString() for f in T.score(docs, model).schema] == ["bigint", "boolean", "double", "int"]
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    unfit = T.train(docs, labels.filter("toxic = 0"))
    assert {r["score"] for r in T.score(docs, unfit).collect()} == {0.0}
    assert T.score(docs.limit(0), model).count() == 0
    assert T.drop_toxic(docs.limit(0), labels.limit(0)).count() == 0
