"""Line dedup against all pairs."""
import numpy as np
import pytest

from llm_fixtures import docs  # noqa: F401
from reviewlens.llm import line_dedup as L


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    first = {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            first.setdefault(line, (i is not None, i or 0, n))
    texts = sorted(first, key=first.get)
    gone = {a for a in texts for b in texts if first[b] < first[a] and one_edit(a, b)}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        keep = [x for n, x in enumerate(parts) if first[x] == (i is not None, i or 0, n) and x not in gone]
        out.append((i, None if t is None and keep else "\n".join(keep), len(parts), len(keep)))
    return sorted(out, key=str)


def run(docs, rows):
    out = L.dedup_lines(docs(rows))
    assert out.columns == ["doc_id", "text", "digest", "n_lines", "n_kept"]
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_kept"]) for r in out.collect()), key=str)


def test_short_lines(docs):
    rows = [(1, "abc\nabd\nab\nxyz\n\nq"), (2, "abc\nbcd\naabc\nzzzz"), (3, None), (4, ""), (5, "é\nè\nàé"),
            (None, "null id\nxyz"), (2, "abc\nbcd\naabc\nzzzz"), (6, "aaaa\naaa\naaaaa\nbaaa\nab")]
    assert run(docs, rows) == brute(rows)


@pytest.mark.parametrize("window", [4, 64])
def test_edits_at_every_place_of_long_lines(docs, monkeypatch, window):
    monkeypatch.setattr(L, "WINDOW", window)
    rng = np.random.default_rng(7)
    rows = []
    for n in (window - 1, window, window + 1, 2 * window - 1, 2 * window, 2 * window + 1, 3 * window + 2):
        base = "".join(rng.choice(list("abcdeé "), n)).strip() + "."
        for k, at in enumerate({0, 1, n // 2, window - 1, window, n - 2, n - 1}):
            at = min(max(at, 0), len(base) - 1)
            rows += [(len(rows), base[:at] + base[at + 1:]), (len(rows) + 1, base[:at] + "#" + base[at + 1:]),
                     (len(rows) + 2, base[:at] + "#" + base[at:])]
        rows.append((len(rows), base))
    assert run(docs, rows) == brute(rows)


def test_a_chain_is_not_followed(docs):
    # each line is one edit from the one before: all but the first go; the last is far from the first
    rows = [(i, "abcdef"[:6 - i] + "x" * i) for i in range(6)]
    assert [r[3] for r in run(docs, rows)] == [1, 0, 0, 0, 0, 0] and run(docs, rows) == brute(rows)


def test_hot_line_and_very_long_line(docs):
    rows = [(i, "Home | About | Contact\n" + f"own line number {i * 1009} of document\nHome | About | Contacts") for i in range(120)]
    long = "ab cd " * 20_000
    rows += [(200, long), (201, long + "!"), (202, long[:5000] + "#" + long[5001:])]
    found = run(docs, rows)
    kept = {r[0]: r[3] for r in found}
    assert kept[200] == 1 and kept[201] == 0 and kept[202] == 0 and kept[0] == 2
    assert run(docs, rows[:120]) == brute(rows[:120])


def test_empty_table(docs):
    assert L.dedup_lines(docs([])).count() == 0


def test_columns_of_any_name(spark):
    names = ["_id", "_doc", "_of", "_lines", "_gone", "gone", "gone_id", "gone_doc", "lines", "given", "place", "d"]
    rows = [(1, "a line here\nb", *names), (2, "a line hers\nc", *names)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    out = sorted(L.dedup_lines(df).collect())
    assert [r["text"] for r in out] == ["a line here\nb", ""] and [r["n_kept"] for r in out] == [2, 0]
    assert all([r[n] for n in names] == names for r in out)


def test_two_lines_of_a_million_characters(docs):
    import time
    long = "ab cd é" * 142_858
    rows = [(1, long), (2, long[:500_001] + "#" + long[500_002:]), (3, long[:77] + long[78:]), (4, long[:9] + "##" + long[11:])]
    start = time.time()
    assert [r[3] for r in run(docs, rows)] == [1, 0, 0, 1]
    assert time.time() - start < 60
