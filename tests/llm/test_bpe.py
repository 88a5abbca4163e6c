"""The numpy BPE against the tokenizers library."""
import hashlib

import numpy as np
import pytest

from llm_fixtures import docs, vocab  # noqa: F401
from reviewlens.llm import bpe

ODD = ["", "a", " ", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "\0<|endoftext|>", "\0\0", " \n\n  \t x", "a" * 23,
       "$$$$$ %%% ###!!", "日本語 テスト", "don't we'll I'M", "😀😀 émigré֌ ab౜ c", " a\u0085b\u001cc", "1" * 300,
       "ab" * 500, "� x", "naïvé"]


@pytest.fixture(scope="module")
def library(vocab):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocab)


@pytest.fixture(scope="module")
def own(vocab):
    return bpe.ByteBpe(vocab)


def texts():
    rng = np.random.default_rng(0)
    pool = list("aAbeéß 's\n\t.1٣漢😀 ​<|>$")
    return ODD + ["".join(rng.choice(pool, rng.integers(0, 40))) for _ in range(500)]


def test_encode_and_decode(own, library):
    made = texts()
    ids, n = own.encode(made)
    parts = np.split(ids, np.cumsum(n)[:-1])
    for text, part, want in zip(made, parts, library.encode_batch(made, add_special_tokens=False), strict=True):
        assert part.tolist() == want.ids, text
        assert own.decode(part) == library.decode(want.ids, skip_special_tokens=False)


def test_decode_of_any_ids(own, library):
    rng = np.random.default_rng(1)
    for _ in range(300):
        ids = rng.integers(0, own.size, rng.integers(0, 12))
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
    with pytest.raises(ValueError):
        own.decode(np.array([own.size]))


def test_query_columns(docs, library, vocab):
    rows = [(i, t) for i, t in enumerate(texts()[:60])] + [(None, "a b"), (3, None), (3, None), (99, "long word " * 20_000)]
    found = sorted((tuple(r) for r in bpe.digest_texts(docs(rows), vocab).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(decoded.encode()).hexdigest()))
    assert found == sorted(want, key=str)
    again = {r["id"]: (r["ids"], r["decoded"]) for r in bpe.encode_texts(docs([(1, "Hello there"), (2, None)]), vocab).collect()}
    assert again[1] == (library.encode("Hello there").ids, "Hello there") and again[2] == ([], "")


def test_empty_table(docs, vocab):
    assert bpe.digest_texts(docs([]), vocab).count() == 0
