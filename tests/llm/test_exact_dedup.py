"""Exact dedup against a brute-force grouping."""
import hashlib
from collections import defaultdict

from llm_fixtures import docs  # noqa: F401
from pyspark.sql import functions as F

from reviewlens.llm import exact_dedup as E


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), i == best[t or ""],
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(docs):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "a "), (6, "A"), (None, "n"), (None, "a"), (2, "a"),
            (7, "é" * 50_000), (8, "é" * 50_000)]
    assert got(E.exact_dedup(docs(rows))) == brute(rows)


def test_a_third_of_all_rows_are_one_text(docs):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(600)]
    df = docs(rows).repartition(7)
    assert got(E.exact_dedup(df)) == brute(rows)
    # the split between frequent and other digests does not show in the result
    assert got(E.exact_dedup(df, heavy=1, tracked=2)) == brute(rows)


def test_the_hot_digest_is_a_candidate(docs):
    rows = E.digests(docs([(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(300)]).repartition(5))
    keys = {r[0] for r in E.frequent_digests(rows, heavy=4, tracked=8).collect()}
    hot = rows.filter("id = 0").selectExpr("xxhash64(digest)").first()[0]
    assert hot in keys


def test_empty_table(docs):
    assert E.exact_dedup(docs([])).count() == 0
    assert E.drop_exact_copies(docs([])).count() == 0


def test_kept_documents_have_all_columns(docs):
    kept = E.drop_exact_copies(docs([(1, "a"), (2, "a"), (3, None), (4, "b")]))
    assert kept.columns == ["doc_id", "text", "digest"]
    assert sorted(r[0] for r in kept.collect()) == [2, 3, 4]


def test_a_file_read_twice_stays_once(docs, spark):
    rows = [(1, "a"), (2, "b"), (2, "b2"), (None, "n"), (5, None)] + [(i, "hot") for i in range(10, 40)]
    once = docs(rows).withColumn("at", F.lit(1))
    twice = once.unionByName(once.withColumn("at", F.lit(2))).unionByName(once).repartition(5)
    kept = E.drop_exact_copies(twice)
    assert kept.columns == ["doc_id", "text", "digest", "at"]
    got = kept.collect()
    assert sorted((tuple(r)[:2] for r in got), key=str) == sorted([*rows[:5], (39, "hot")], key=str)
    # the row that stays does not depend on how the rows are dealt
    assert sorted(map(str, got)) == sorted(map(str, E.drop_exact_copies(twice.repartition(3)).collect()))
