import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

VOCAB = "byte_bpe_50k.json"


@pytest.fixture(scope="session")
def vocab():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path(VOCAB)


@pytest.fixture
def docs(spark):
    """Documents (doc_id, text) with an extra column whose name operators use inside."""
    def make(rows, extra="digest"):
        data = [(i, t, "x") for i, t in rows]
        return spark.createDataFrame(data, f"doc_id bigint, text string, {extra} string")
    return make
