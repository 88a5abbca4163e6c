"""Hard negatives against brute force, and the bounds of the filter."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import hard_negatives as H


def brute(rows, every=5, positives=5, negatives=10):
    clean = {}
    for i, v, y in rows:
        if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v):
            item = (y, tuple(int(math.floor(256 * float(np.float32(x)))) for x in v))
            clean[i] = min(item, clean.get(i, item))
    out = []
    for a in sorted(i for i in clean if i % every == 0):
        y, v = clean[a]
        scored = sorted(((-sum(p * q for p, q in zip(v, w)), i, z == y) for i, (z, w) in clean.items() if i != a))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            hard = [(-t, n) for t, n, alike in scored if not alike and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, r + 1, n, -s, t) for r, (t, n) in enumerate(hard[:negatives])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows],
                               "vec_id bigint, embedding array<float>, label int, id string, cell int")
    got = H.mine(df.repartition(3), F.col("id") % 5 == 0, **kw)
    return sorted(tuple(r) for r in got.collect())


def vectors(n, width=6, seed=0, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    return [(i, [float(np.float32(x)) for x in (centres[i % 4] + 0.7 * rng.normal(size=width)) / 3], int(rng.integers(labels)))
            for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:                 # many parts and blocks a cell
        for name, value in (("CELL_ROWS", 16), ("QUERY_ROWS", 4), ("BLOCK", 4), ("TURN", 2), ("QUERY_TILE", 3)):
            monkeypatch.setattr(H, name, value)
    rows = vectors(120)
    rows += [(500, None, 1), (505, [None] + [0.1] * 5, 1), (510, [math.nan] + [0.1] * 5, 1),
             (515, [math.inf] + [0.1] * 5, 2), (None, [0.5] * 6, 1), (520, [0.4] * 6, None), (525, [0.5] * 5, 1),
             (10, rows[3][1], 2), (3, rows[3][1], rows[3][2]), (530, [0.0] * 6, 0), (535, [0.0] * 6, 1),
             (540, [-2.0] * 6, 0), (545, [3.0] * 6, 7)]
    want = brute([r for r in rows if r[0] != 525])
    assert run(spark, rows) == want and len(want) > 300


def test_hot_vectors_and_ties(spark, monkeypatch):
    monkeypatch.setattr(H, "CELL_ROWS", 24)
    monkeypatch.setattr(H, "BLOCK", 8)
    rows = vectors(60, seed=2) + [(1000 + i, [0.25, 0.5, 0.1, 0.1, 0.2, 0.0], i % 2) for i in range(80)]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, None, 1)]) == []
    rows = vectors(4, labels=2)
    assert run(spark, rows) == brute(rows)
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.5], 0), (2, [0.5, 0.0], 1)]
    assert run(spark, rows) == brute(rows) == [(0, 1, 1, 2, 65536, 32768)]


def test_large_components_are_exact(spark):
    rows = [(0, [3e6, 1.0], 0), (1, [2e6, 1.0], 0), (2, [1e6, 1.0], 1), (3, [1e6, 1.5], 1)]
    assert run(spark, rows) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    vec, query = np.floor(300 * rng.normal(size=(500, 8))), np.floor(300 * rng.normal(size=(40, 8)))
    vec[0] = 0
    vec[1] = query[0]
    directions = H.fit_references(vec, 6)
    a, b = H.angles(query, directions), H.angles(vec, directions)
    qn, vn = np.linalg.norm(query, axis=1), np.linalg.norm(vec, axis=1)
    score = query @ vec.T
    least, most = H.row_bounds(a, qn, b, vn)
    assert (least <= score).all() and (score <= most).all()
    assert (most - least).mean() < 1.9 * np.outer(qn, vn).mean()            # narrower than the norms alone
    starts = np.arange(0, 500, 25)
    order = np.argsort(b[:, 0])
    ranges = [f.reduceat(x[order], starts, axis=0) for x in (b, vn) for f in (np.minimum, np.maximum)]
    least, most = H.block_bounds(a, qn, *ranges)
    held = score[:, order].reshape(40, 20, 25)
    assert (least <= held.min(2)).all() and (held.max(2) <= most).all()


def test_rows_that_overlap_no_window_are_not_scored(monkeypatch):
    """In two dimensions the angles leave a thin band."""
    rng = np.random.default_rng(1)
    vec = np.floor(1000 * rng.normal(size=(4000, 2)))
    directions = H.fit_references(vec, 8)
    cell = {"id": np.arange(4000), "label": np.ones(4000, int), "vec": vec, "norm": np.linalg.norm(vec, axis=1),
            "angle": H.angles(vec, directions)}
    query = {k: v[:1] for k, v in cell.items()} | {"id": np.array([-1]), "label": np.array([0])}
    top = int((vec @ vec[0]).max())
    query |= {"low": np.array([[top * 8 // 10]]), "high": np.array([[top * 9 // 10]])}
    scored = []
    real = H.inner
    monkeypatch.setattr(H, "inner", lambda a, b: scored.append(len(a) * len(b)) or real(a, b))
    who, window, ids, score = H.best_in_windows(query, cell, 10, False)
    all_scores = (vec @ vec[0]).astype(int)
    want = sorted(((-s, i) for i, s in enumerate(all_scores) if top * 8 // 10 <= s <= top * 9 // 10))[:10]
    assert sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist())) == want
    assert sum(scored) < 400


def test_window_shares_are_exact(spark):
    values = [0, 1, 9, 10, 11, -1, -10, -11, 2**60 // 9, -(2**60 // 9), 10**17 + 1]
    df = spark.createDataFrame([(v,) for v in values], "s bigint")
    got = [(r["s"], r["low"], r["high"]) for r in df.select(
        "s", H._ceil_share(F.col("s"), H.LOW).alias("low"), H._floor_share(F.col("s"), H.HIGH).alias("high")).collect()]
    assert got == [(v, -((-3 * v) // 10), (9 * v) // 10) for v in values]
