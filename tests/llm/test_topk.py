"""Exact top-k against brute force."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import topk


def brute(rows, k=5, every=5):
    clean = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in clean if i % every == 0}):
        best = {}
        for _, a in [x for x in clean if x[0] == q]:
            for i, b in clean:
                if i != q:
                    best[i] = max(best.get(i, -10**18), int(a @ b))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(ranked)]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, pivot string")
    return sorted(tuple(r) for r in topk.top_k(df.repartition(3), F.col("id") % 5 == 0, **kw).collect())


def vectors(n, width=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=width) / 3]) for i in range(n)]


def test_odd_rows(spark):
    rows = vectors(60)
    rows += [(100, None), (105, [None] + [0.1] * 7), (110, [math.nan] + [0.1] * 7), (115, [math.inf] + [0.1] * 7),
             (None, [0.5] * 8), (10, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (120, [0.0] * 8), (125, [-3.0] * 8)]
    assert run(spark, rows) == brute(rows)


def test_ties_go_to_smaller_ids_and_hot_vectors_split(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_ROWS", 20)
    monkeypatch.setattr(topk, "ANNULUS", 8)
    rows = vectors(90, seed=2) + [(1000 + i, [0.25] * 8) for i in range(60)]
    assert run(spark, rows, pivots=6) == brute(rows)


def test_fewer_than_k(spark):
    rows = vectors(3)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []


def test_the_walk_stops_early():
    """Cells whose bound excludes a better vector are not scored."""
    rng = np.random.default_rng(1)
    vec = np.floor(256 * rng.normal(size=(4000, 2)))
    vec = np.floor(vec / np.linalg.norm(vec, axis=1)[:, None] * 256)
    top2 = (vec**2).sum(1).max()
    pivot = np.append(vec[0], 0)
    high = np.sqrt(np.maximum(0, top2 - (vec**2).sum(1)))[:, None]
    dist = np.linalg.norm(np.hstack([vec, high]) - pivot, axis=1)
    queries = vec[:3]
    to_pivot = np.linalg.norm(np.hstack([queries, np.zeros((3, 1))]) - pivot, axis=1)
    scored = []
    real = np.lexsort

    def counting(keys, axis=-1):
        scored.append(1)
        return real(keys, axis=axis)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(topk.np, "lexsort", counting)
        at, ids, score = topk.search_cell(np.arange(3), queries, to_pivot, np.full(3, -np.inf), np.arange(4000), vec,
                                          dist, top2, 5)
    assert len(scored) < 3 * math.ceil(4000 / topk.ANNULUS) / 2
    for q in range(3):
        want = sorted(((int(queries[q] @ v), i) for i, v in enumerate(vec) if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert [(int(s), int(i)) for s, i in zip(score[at == q], ids[at == q], strict=True)] == want


def test_an_id_with_many_vectors_takes_one_place(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0 - i / 100, 0.1]) for i in range(8)] + [(i, [0.5 - i / 50, 0.2]) for i in range(2, 8)]
    assert run(spark, rows) == brute(rows)


def test_queries_of_a_cell_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "CELL_ROWS", 16)
    rows = vectors(120, seed=4)
    sizes = []
    real = topk._search

    def seen(queries, index, *a):
        sizes.append(queries.groupBy("pivot", "part", "block").count().agg({"count": "max"}).first()[0])
        return real(queries, index, *a)
    monkeypatch.setattr(topk, "_search", seen)
    assert run(spark, rows, pivots=4) == brute(rows)
    assert max(sizes) <= 9
