"""Rollups against a recount; batches are idempotent."""
from collections import Counter

import numpy as np
import pytest

from llm_fixtures import vocab  # noqa: F401
from reviewlens.llm import token_counts as T
from reviewlens.session import shared_path

SCHEMA = "doc_id bigint, op string, seq int, source string, lang string, tokenizer string, tokens bigint, number string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def totals(store):
    return {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()}


def recount(state):
    docs, tokens = Counter(), Counter()
    for source, lang, tok, n in state.values():
        docs[source, lang, tok] += 1
        tokens[source, lang, tok] += n
    return {g: (docs[g], tokens[g]) for g in docs}


@pytest.mark.parametrize("every", [2, 16])
def test_random_batches(spark, monkeypatch, every):
    monkeypatch.setattr(T, "SNAPSHOT_EVERY", every)
    rng = np.random.default_rng(0)
    store, state = T.Rollup(spark, shared_path(spark, "rollup-test")), {}
    for batch in range(4):
        rows = []
        for seq in range(40):
            op = rng.choice(["insert", "revise", "delete"], p=[0.4, 0.3, 0.3])
            rows.append((int(rng.integers(0, 25)), str(op), seq, str(rng.choice(["a", "b"])), None if seq % 7 == 0 else "en",
                         f"v{batch % 2}", int(rng.integers(0, 100))))
        assert store.commit(f"b{batch}", frame(spark, rows))
        for i, op, _, s, lang, tok, n in {r[0]: r for r in rows}.values():
            if op == "delete":
                state.pop(i, None)
            else:
                state[i] = (s, lang, tok, n)
        assert totals(store) == recount(state)
        assert not store.commit(f"b{batch}", frame(spark, [(1, "insert", 1, "z", "z", "z", 5)]))
        assert totals(store) == recount(state)


def test_readers_start_from_the_last_snapshot(spark, monkeypatch):
    monkeypatch.setattr(T, "SNAPSHOT_EVERY", 3)
    store = T.Rollup(spark, shared_path(spark, "rollup-test"))
    for b in range(7):
        assert store.commit(f"b{b}", frame(spark, [(b, "insert", 1, "a", "en", "v", 10), (b - 1, "delete", 1, "a", "en", "v", 0)]))
        assert len(store._folders()) <= 3
    assert totals(store) == {("a", "en", "v"): (1, 10)}
    assert store.state().filter("live").count() == 1 and store.state().count() <= 2
    assert not store.commit("b0", frame(spark, []))               # known though it is only in a snapshot
    store.snapshot()
    store.snapshot()
    assert len(store._folders()) == 1 and totals(store) == {("a", "en", "v"): (1, 10)}
    with pytest.raises(ValueError):
        store.commit(T.SNAPSHOT, frame(spark, []))


def test_odd_changes(spark):
    store = T.Rollup(spark, shared_path(spark, "rollup-test"))
    assert totals(store) == {}
    assert store.commit("empty", frame(spark, []))
    assert store.commit("odd", frame(spark, [
        (None, "insert", 1, "a", "en", "v", 3), (1, "other", 1, "a", "en", "v", 3), (2, "delete", 1, "a", "en", "v", 3),
        (3, "insert", 1, None, None, None, None), (4, "insert", 1, "a", "en", "v", 3), (4, "insert", 1, "a", "en", "v", 3)]))
    assert totals(store) == {(None, None, None): (1, 0), ("a", "en", "v"): (1, 3)}
    # a writer that dies before its commit leaves a folder that nobody reads; a new store object sees the same
    frame(spark, []).write.parquet(f"{store.path}/batch-dead/state")
    again = T.Rollup(spark, store.path)
    assert totals(again) == totals(store) and set(again.log()) == {"empty", "odd"}


def test_counts_are_the_librarys(spark, vocab):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocab)
    rows = [(1, "a text <|endoftext|>", "s", None), (2, None, "s", "en"), (None, "b " * 9, None, "en")]
    found = T.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string"), "v", vocab)
    assert sorted((r["tokens"] for r in found.collect())) == sorted(
        len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in rows)
