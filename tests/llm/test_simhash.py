"""SimHash fingerprints, links and components against brute force."""
import re
from collections import defaultdict

import numpy as np
import xxhash

from llm_fixtures import docs  # noqa: F401
from reviewlens.llm import simhash as S


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """The smallest member of each fingerprint's component, linked at 4 bits or fewer."""
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fps}


def slow(rows):
    fp = {n: slow_fingerprint(t or "") for n, (_, t) in enumerate(rows)}
    root = slow_components(list(fp.values()))
    ids = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            ids[root[fp[n]]].append(i)
    return sorted(((i, f"{fp[n]:016x}", min(ids[root[fp[n]]], default=None)) for n, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def near_copies(n=6):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 500, 400)]
    out = []
    for i in range(n):
        copy = list(base)
        for at in rng.choice(len(copy), i, replace=False):
            copy[at] = "changed"
        out.append(" ".join(copy))
    return out


def test_fingerprint():
    for text in ["", " \t\n\x0b\x0c\r", "one", "A b C d", "A b c d E f", "É é e x y z w v", "a a a a a a a a",
                 "x" * 70_000, "\x1c \x85 b c d e", *near_copies(3)]:
        assert S.fingerprint(text) == slow_fingerprint(text), text[:30]


def test_components(docs):
    rows = [(10 + i, t) for i, t in enumerate(near_copies())]
    rows += [(1, ""), (2, None), (3, "same words here again now"), (4, "SAME words  here again now"), (4, "same words here again now"),
             (None, "same words here again now"), (None, "alone with no id at all"), (5, "quite another text of some words")]
    assert got(S.simhash_dedup(docs(rows, extra="fp"))) == slow(rows)


def test_empty_table(docs):
    assert S.simhash_dedup(docs([])).count() == 0
    assert S.drop_near_copies(docs([])).count() == 0


def test_one_of_each_component_stays(docs):
    kept = S.drop_near_copies(docs([(3, "a b c d"), (2, "a b c d"), (9, "entirely other words stand here"), (7, None)]))
    assert kept.columns == ["doc_id", "text", "digest"]
    assert sorted(r[0] for r in kept.collect()) == [2, 7, 9]


def test_rows_with_null_and_repeated_ids_are_decided_by_their_text(docs):
    rows = [(3, "a b c d"), (5, "A b c d"), (5, "one text that no other row is near to"), (None, "a B c d"),
            (None, "another text with no id but alone"), (None, "third words without any id here"),
            (8, "one text that No other row is near to")]
    kept = sorted((tuple(r)[:2] for r in S.drop_near_copies(docs(rows, extra="fp")).collect()), key=str)
    assert kept == sorted([rows[i] for i in (0, 2, 4, 5)], key=str)


def clustered(seed, n=300):
    rng = np.random.default_rng(seed)
    fps = [int(x) for x in rng.integers(0, 2**63, n)]
    for x in fps[:40]:
        for _ in range(3):
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps += [0, 2**64 - 1, 15, 2**64 - 16]
    return np.unique(np.array(fps, np.uint64))


def roots_of(links, fps):
    parent = {}
    for a, b in links:
        ra, rb = S._find(parent, int(a)), S._find(parent, int(b))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {int(f): S._find(parent, int(f)) for f in fps}


def test_links_connect_what_four_bits_connect(monkeypatch):
    fps = clustered(5)
    want = slow_components([int(f) for f in fps])
    for bits, chunk in ((3, 1 << 21), (8, 1 << 21), (4, 1 << 10), (12, 1 << 21)):
        monkeypatch.setattr(S, "CHUNK_VARIANTS", chunk)
        found = np.concatenate([S.links_in_bucket(fps, b, bits, 2) for b in range(1 << bits)])
        assert (np.bitwise_count(found[:, 0] ^ found[:, 1]) <= 4).all()
        assert roots_of(found, fps) == want


def test_spark_links_with_few_and_with_many_buckets(spark, monkeypatch):
    fps = clustered(6, 120)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    want = slow_components([int(f) for f in fps])
    for bits in (4, 12):
        monkeypatch.setattr(S, "bucket_bits_for", lambda n, bits=bits: bits)
        found = np.array([tuple(r) for r in S.links(df).collect()], np.int64).reshape(-1, 2).view(np.uint64)
        assert roots_of(found, fps) == want


def test_no_bucket_gets_the_whole_corpus(spark, monkeypatch):
    # a third of them share all but 8 bits, which are in one parity of 8
    fps = np.unique(np.concatenate([clustered(7), clustered(8, 900) & np.uint64(0x1010101010101010)]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint").repartition(2)
    reach = np.unique(S.syndrome(S._masks(2), 8))
    sent = np.bincount((S.syndrome(fps, 8)[:, None] ^ reach).ravel(), minlength=256)
    assert len(reach) == 37 and np.median(sent) < len(fps) / 4
    monkeypatch.setattr(S, "BUCKET_FINGERPRINTS", 60)
    assert set(S.split_buckets(df, 8)) == set(np.flatnonzero(sent > 240).tolist()) != set()
    assert S.bucket_bits_for(len(fps)) > 8
    monkeypatch.setattr(S, "bucket_bits_for", lambda n: 6)
    monkeypatch.setattr(S, "split_buckets", lambda *_: {0: 3, 1: 7, 20: 1, 33: 5})
    found = np.array([tuple(r) for r in S.links(df).collect()], np.int64).reshape(-1, 2).view(np.uint64)
    assert roots_of(found, fps) == slow_components([int(f) for f in fps])


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (161, 160), (160, 161)]
    found = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 160: 160, 161: 160}


def test_stage_keeps_columns_of_any_name(spark):
    from reviewlens.llm import exact_dedup
    names = ["_dropped_id", "_dropped_digest", "_dropped_sha", "digest", "id", "doc", "fp", "kept", "component_id"]
    rows = [(1, "one two three four five", *names), (2, "one two three four five", *names), (3, "six seven", *names)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    for stage, kept in ((S.drop_near_copies, [1, 3]), (exact_dedup.drop_exact_copies, [2, 3])):
        out = stage(df)
        assert out.columns == df.columns
        got = sorted(out.collect())
        assert [r["doc_id"] for r in got] == kept and all([r[n] for n in names] == names for r in got)


def test_a_text_is_hashed_in_slices(monkeypatch):
    texts = ["ab cd ef gh ij kl " * 30, "x" * 500, " \t\n", "", "a " * 99, "é ü " * 50 + "z" * 100, "one two three"]
    whole = [S.fingerprint(t) for t in texts]
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(S, "SLICE", size)
        assert [S.fingerprint(t) for t in texts] == whole


def test_a_text_of_50_mb_needs_little_memory():
    import tracemalloc
    rng = np.random.default_rng(0)
    text = "".join(f"{x:x} " for x in rng.integers(0, 1 << 30, 100_000)) * 60
    tracemalloc.start()
    S.fingerprint(text)
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
