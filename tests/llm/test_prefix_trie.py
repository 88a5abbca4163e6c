"""The prefix trie against brute force, and its parts."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import prefix_trie as T


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def slow(rows):
    convs = rebuilt(rows)
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "conv_id bigint, turn bigint, role string, text string, owner string, depth int")
    conv = F.col("conv")
    turns = T.turns_of(df.repartition(parts))
    head = (F.crc32(conv.cast("string")) % 4).cast("int")
    out = T.prefix_trie(*T.shared_starts(turns, conv - conv % 20, head, 3))
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2])


def made(n, seed=1, longest=6):
    rng = random.Random(seed)
    return [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(rng.choice("ab") for _ in range(rng.randrange(3))))
            for c in range(n) for t in range(rng.randrange(1, longest))]


@pytest.mark.parametrize("cell", [4, 1 << 15])
def test_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(T, "CELL", cell)
    rows = made(60)
    rows += [(None, 0, "user", "x"), (100, None, None, None), (100, 0, "user", "a b"), (100, 0, "user", "a b"),
             (100, 0, "b", "c"), (-27, 0, "user", "a"), (-20, 0, "user", "z"), (9_000_000_000_000, 5, "", "\t\n ")]
    rng = random.Random(2)
    rng.shuffle(rows)
    assert run(spark, rows) == slow(rows)


@pytest.mark.parametrize("cell", [16, 1 << 15])
def test_one_conversation_holds_most_rows_and_many_end_alike(spark, monkeypatch, cell):
    monkeypatch.setattr(T, "CELL", cell)
    monkeypatch.setattr(T, "END_BLOCK", 7)
    rows = [(4000, t, "user", f"w {t}") for t in range(150)] + [(4001, t, "user", f"w {t}") for t in range(120)]
    rows += [(20 * c, 0, "user", "hello") for c in range(1, 90)] + made(10)
    assert run(spark, rows, 5) == slow(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []


def test_very_long_text(spark):
    rows = [(20, 0, "user", "ab " * 300_000), (40, 0, "user", "ab " * 300_000), (60, 0, "user", "ab " * 299_999)]
    got = run(spark, rows)
    assert got == slow(rows)
    assert got[0][3] == 3 and got[0][6] == 300_000


def forest(parent):
    n = len(parent)
    depth = np.zeros(n, np.int64)
    top = np.arange(n)
    for i in range(n):                     # parents come first
        if parent[i] >= 0:
            depth[i], top[i] = depth[parent[i]] + 1, top[parent[i]]
    size = np.ones(n, np.int64)
    for i in reversed(range(n)):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    return top, depth, size


@pytest.mark.parametrize("shape", ["random", "chain", "star", "comb", "single"])
def test_finish_components(shape):
    rng = np.random.default_rng(7)
    n = {"single": 1}.get(shape, 700)
    parent = {"random": lambda i: int(rng.integers(-1, i)) if i else -1, "chain": lambda i: i - 1,
              "star": lambda i: -1 if i == 0 else 0, "comb": lambda i: i - 1 if i % 2 else max(-1, i - 2),
              "single": lambda i: -1}[shape]
    parent = np.array([parent(i) for i in range(n)])
    top, depth, size = forest(parent)
    weights = rng.integers(-5, 9, (n, 2))
    want = weights.copy()
    for i in reversed(range(n)):
        if parent[i] >= 0:
            want[parent[i]] += want[i]
    mix = rng.permutation(n)               # any order of nodes
    back = np.argsort(mix)
    moved = np.where(parent[mix] >= 0, back[parent[mix]], -1)
    got = T.finish_components(back[top[mix]], moved, depth[mix], size[mix], weights[mix])
    assert (got == want[mix]).all()


def test_rounds_are_logarithmic(monkeypatch):
    """A chain of n nodes is halved, not peeled."""
    n = 4096
    parent = np.arange(n) - 1
    top, depth, size = forest(parent)
    rounds = []
    real = np.add.at
    class Counting:
        at = staticmethod(lambda *a: (rounds.append(1), real(*a)))
    monkeypatch.setattr(T.np, "add", Counting)
    T.finish_components(top, parent, depth, size, np.ones((n, 1), np.int64))
    assert len(rounds) <= 13


def test_running_sums_over_many_partitions(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, -3, 7]), rng.randrange(50), rng.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, v bigint").withColumn("one", F.lit(1).cast("long")).repartition(6)
    got = T.running_sums(df, "k", ["o", "v"], ["v", "one"], ["o"], "test-sums").collect()
    want, have = [], {}
    for k, o, v in sorted(rows):
        s, n = have.get(k, (0, 0))
        have[k] = (s + v, n + 1)
        want.append((k, o, s + v, n + 1))
    assert sorted(tuple(r) for r in got) == sorted(want)
