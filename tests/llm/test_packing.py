"""Packing: every piece whole and once, no sequence too long, as few as best-fit decreasing."""
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pytest

from llm_fixtures import docs, vocab  # noqa: F401
from reviewlens.llm import packing as P
from reviewlens.llm.token_counts import count_tokens


def best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        at = bisect_left(gaps, s)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        insort(gaps, gap - s)
    return len(gaps)


def check(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("kind", ["mixed", "tiny", "hot size", "one", "full"])
def test_as_few_sequences_as_best_fit_decreasing(spark, kind):
    rng = np.random.default_rng(4)
    sizes = {"mixed": rng.integers(1, 65, 400), "tiny": rng.integers(1, 4, 300), "one": np.array([5]),
             "hot size": np.concatenate([np.full(150, 23), rng.integers(1, 50, 300)]), "full": np.full(20, 64)}[kind]
    df = spark.createDataFrame([(int(i % 97), int(i), int(s)) for i, s in enumerate(sizes)],
                               "id bigint, piece bigint, length bigint").repartition(5)
    rows = P.pack(df, capacity=64).collect()
    assert sorted((r["id"], r["piece"], r["length"]) for r in rows) == sorted(map(tuple, df.collect()))
    assert check(rows, 64) == best_fit(sizes.tolist(), 64)


def test_cut():
    assert P.cut(5, 8) == [(0, 5)]
    assert P.cut(8, 8) == [(0, 8)]
    assert P.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_documents(docs, vocab):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocab)
    rows = [(1, "some text"), (2, None), (3, ""), (4, "word " * 300), (4, "word " * 300), (None, "x <|endoftext|> y"),
            (5, "é日" * 400), (6, "a")]
    found = P.pack_documents(docs(rows), vocab, capacity=128).collect()
    check(found, 128)
    want = []
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(P.cut(len(ids), 128))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=str) \
        == sorted(want, key=str)


def test_sequences_hold_the_ids(docs, vocab):
    made = P.sequences(docs([(1, "some text"), (2, None), (3, "more words here")]), vocab, capacity=16).collect()
    coder = P.encoding(vocab)
    want = sorted([*coder.encode("some text"), 0, 0, *coder.encode("more words here"), 0])
    assert sorted(x for r in made for x in r["ids"]) == want
    assert all(len(r["ids"]) <= 16 for r in made)


def test_a_million_blanks(docs, vocab):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocab)
    texts = ["a" + " " * 1_000_001 + "b <|endoftext|>", "\n" * 1_000_001, " " * 999_000 + "\t" * 2_000 + "é"]
    for t in texts:
        with pytest.raises(ValueError):
            P.encoding(vocab).encode(t, allowed_special="all")
        assert P.token_ids(vocab, t).tolist() == library.encode(t, add_special_tokens=False).ids
    want = len(library.encode(texts[0], add_special_tokens=False).ids)
    rows = docs([(1, texts[0])]).selectExpr("*", "'s' source", "'l' lang")
    assert sum(r["length"] for r in P.pack_documents(rows, vocab).collect()) == want + 1
    assert count_tokens(rows, "v", vocab).first()["tokens"] == want


def test_empty_table(docs, vocab):
    assert P.pack_documents(docs([]), vocab).count() == 0
