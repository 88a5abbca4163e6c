"""URL rules and the character model against a brute-force version."""
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from reviewlens.llm import url_filter as U
from reviewlens.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    stop = min([rest.find(c, end) for c in "?#" if rest.find(c, end) >= 0] or [len(rest)])
    return host, rest[end:stop]


def ruled(host, path, rules=URL_RULES):
    fits = [(len(h + p), h + p, act) for act, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def marked(url):
    text = U.START * U.ORDER + url + U.END
    return [text[i:i + U.ORDER + 1] for i in range(len(url) + 1)]


def slow(urls):
    rows = []
    for url in urls:
        text = url or ""
        host, path = parts(url)
        rule, act = ruled(host, path)
        use = "judge" if act is None else "calibrate" if zlib.crc32(text.encode()) % U.CALIBRATE == 0 else act
        rows.append((text, host, path, rule, act, use))
    counts = {"allow": Counter(), "block": Counter()}
    for text, *_, use in rows:
        if use in counts:
            for w in marked(text):
                for k in range(U.ORDER + 1):
                    counts[use][w[k:]] += 1
    if not counts["allow"] or not counts["block"]:
        return [(h, p, r, a or "allow") for _, h, p, r, a, _ in rows]
    symbols = len({g for c in counts.values() for g in c if len(g) == 1}) + 1
    follow = {c: defaultdict(list) for c in counts}
    for c in counts:
        for g, n in counts[c].items():
            follow[c][g[:-1]].append(n)

    def prob(c, gram):
        below = prob(c, gram[1:]) if len(gram) > 1 else 1 / symbols
        seen = follow[c][gram[:-1]]
        # contexts of one length only meet grams of that length
        return (counts[c][gram] + len(seen) * below) / (sum(seen) + len(seen)) if seen else below

    def units(text):
        return sum(round((math.log(prob("allow", w)) - math.log(prob("block", w))) * U.UNIT) for w in marked(text))
    step = {t: max(-U.MOST, min(U.MOST, math.floor(units(t) / (len(marked(t)) * U.STEP))))
            for t, *_, use in rows if use in ("judge", "calibrate")}
    aside = [(step[t], a) for t, _, _, _, a, use in rows if use == "calibrate"]
    good, bad = (sum(a == x for _, a in aside) for x in ("allow", "block"))
    cut = 0
    if good and bad:
        cut = min(range(-U.MOST, U.MOST + 2), key=lambda c: (
            -sum((bad if s >= c else 0) if a == "allow" else (good if s < c else 0) for s, a in aside), abs(c), c))
    return [(h, p, r, a or ("allow" if step[t] >= cut else "block")) for t, h, p, r, a, _ in rows]


def run(spark, urls, **kw):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)],
                               "page_id bigint, url string, row string, window int").repartition(3)
    out = {r["page_id"]: tuple(r)[1:5] for r in U.judge_urls(df, URL_RULES, **kw).collect()}
    return [out[i] for i in range(len(urls))]


def made(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        host = rng.choice(["Example.org", "a.example.org", "b.org", "shop.com", "com", "x.net", "pills.net"])
        path = rng.choice(["", "/en/1", "/en/2", "/es/3", "/fr/4", "/de/5", "/de"])
        out.append(rng.choice(["http", "https"]) + "://" + host + path + rng.choice(["", f"?q={i}", "#top", f"x{i}"]))
    return out


def test_brute_force(spark):
    urls = made(150) + [None, "", "no scheme", "://", "http://", "http://a.org", "http://a.org?x=/", "HTTP://É.Org/a",
                        "http://😀.net/😀\n/", "x://y://example.org/es/", "http://notexample.org/es/1"]
    urls += ["http://x.net/en/2"] * 60                # a hot URL
    got = run(spark, urls)
    assert got == slow(urls)
    assert {v for *_, v in got} == {"allow", "block"}


def test_rules():
    assert ruled(*parts("https://WWW.Example.org/es/1?x")) == ("example.org/es/", "block")
    assert ruled(*parts("https://a.b/c://example.org/es/")) == (None, None)
    assert ruled(*parts("http://org/")) == ("org/", "allow")
    assert ruled(*parts("http://borg/")) == (None, None)


def test_one_sided_and_empty(spark):
    assert run(spark, ["http://a.org/x", "http://b.net/y", None]) == slow(["http://a.org/x", "http://b.net/y", None])
    assert run(spark, []) == []


def test_very_long_url(spark):
    long = "http://x.net/" + "ab/" * 100_000
    urls = made(60) + [long]
    assert run(spark, urls) == slow(urls)


def test_hot_windows_are_scored_alike(spark, monkeypatch):
    from reviewlens.llm import common
    urls = made(80, seed=5)
    want = slow(urls)
    for heavy in (1, 4, 100_000):
        monkeypatch.setattr(common.join_counted, "__defaults__", (heavy,))
        assert run(spark, urls) == want


def test_allowed_pages_keep_their_columns(spark):
    urls = made(80) + [None]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "id bigint, url string, blocked_url string")
    out = U.allowed_pages(df, URL_RULES)
    assert out.columns == df.columns
    assert sorted(r["id"] for r in out.collect()) == [i for i, x in enumerate(slow(urls)) if x[3] == "allow"]


def test_threshold():
    assert U.best_threshold({}) == 0
    assert U.best_threshold({3: (5, 0), -7: (0, 5)}) == 0
    assert U.best_threshold({3: (5, 0), 1: (0, 5)}) == 2
    assert U.best_threshold({-3: (1, 0), -9: (0, 1)}) == -3


@pytest.mark.parametrize("text", ["", "a", "ab😀c"])
def test_windows(spark, text):
    from pyspark.sql import functions as F
    got = spark.createDataFrame([(text,)], "t string").select(U.windows(F.col("t"))).first()[0]
    assert got == marked(text)
