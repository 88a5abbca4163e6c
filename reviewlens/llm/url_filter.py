"""URL filters: rules first, then a character language-model ratio.

Rules (action, host, path) decide the URLs that they fit: a rule fits its host
and all subdomains, if the URL's path starts with the rule's; the longest wins.
The URLs that a rule accepts and those that one rejects train two variable-order
Markov models over characters, which judge all others.

Model: a URL is its characters behind ``ORDER`` start marks and before an end
mark.  The probability of a character after the last k characters mixes what
was counted after them with the probability after the last k - 1 (Witten-Bell:
a context of n occurrences and t different followers gives the shorter context
the weight t / (n + t); an unseen context gives it all).  Below the empty
context every symbol is alike.  ``grams`` counts every window of all training
URLs; nothing is pruned, so the model grows with the input.  It is never on one
machine: probabilities are computed by joins, one context length after another,
for the windows that the judged URLs hold.

Score: the sum over a URL's windows of log P(accepted) - log P(rejected),
rounded to 2**-20 so that sums are exact in any order, divided by the number of
windows.  Every ``CALIBRATE``-th training URL (by a hash of the URL) is left out
of the counts; the threshold is the one that parts these best (the mean of the
share of accepted URLs kept and rejected URLs dropped; of equal ones the
nearest to zero), on steps of 1/64.

Skew: windows are counted before they are shuffled; windows held by over a
``HEAVY``-th of all positions (fewer than ``HEAVY`` rows) are scored map-side;
a context has at most as many followers as the alphabet has symbols.

Defined cases: a NULL URL is the empty text (host and path empty, no rule); a
URL without ``://`` has empty host and path; an empty path starts with no
rule's path; repeated rows and ids are judged each; without calibration URLs of
both kinds the threshold is zero, without training URLs of both kinds every
other URL is allowed; further columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import join_counted, require, written

Rule = tuple[str, str, str]         # action (allow, block), host, path

ORDER = 4                 # characters of the longest context
START, END = "\u0002", "\u0003"
UNIT = 1 << 20            # log ratios are whole multiples of 1 / UNIT
STEP = 1 << 14            # of the score, in units: thresholds lie 1/64 apart
MOST = 1024               # steps of the largest threshold
CALIBRATE = 5             # every fifth training URL sets the threshold instead
ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule, or NULLs."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, of_host, of_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        rule = F.when(fits, F.lit(of_host + of_path)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def windows(text: Column, order: int = ORDER) -> Column:
    """Each character and the end mark, with the ``order`` symbols before it."""
    chars = F.split(F.concat(F.lit(START * order), text, F.lit(END)), "")
    # bound once: split is linear in the text, substring by position is not
    return F.transform(F.array(chars), lambda c: F.transform(
        F.sequence(F.lit(1), F.size(c) - order), lambda i: F.array_join(F.slice(c, i, order + 1), "")))[0]


def grams(positions: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, accepted, rejected, wanted) counts of all windows and all their endings.

    ``positions`` has a ``window`` a row, with 0/1 columns of those names.
    """
    def sums() -> list[Column]:
        return [F.sum(c).alias(c) for c in ("accepted", "rejected", "wanted")]
    full = positions.groupBy("window").agg(*sums())
    endings = F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda i: F.substr("window", i))
    return (full.select(F.explode(endings).alias("gram"), "accepted", "rejected", "wanted")
            .groupBy("gram").agg(*sums()))


def log_ratios(counts: DataFrame, symbols: int, order: int = ORDER) -> DataFrame:
    """(window, n, units): the rounded log ratio of each wanted window, and how often it is wanted."""
    length = F.char_length("gram")
    context = Window.partitionBy(F.expr("left(gram, char_length(gram) - 1)"), length)
    followed = counts
    for kind in ("accepted", "rejected"):
        followed = (followed.withColumn(f"n_{kind}", F.sum(kind).over(context))
                    .withColumn(f"t_{kind}", F.sum((F.col(kind) > 0).cast("long")).over(context)))
    followed = written(followed.filter("wanted > 0").withColumn("length", length), "url-followed")
    shorter = None
    for k in range(1, order + 2):
        level = followed.filter(F.col("length") == k)
        if shorter is None:
            level = level.withColumns({f"below_{c}": F.lit(1.0 / symbols) for c in ("accepted", "rejected")})
        else:
            # at most an alphabet's grams share an ending: no hot key
            level = level.withColumn("ending", F.expr("substr(gram, 2)")).join(shorter, "ending")
        p = {c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"below_{c}"))
                       / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"below_{c}"))
             for c in ("accepted", "rejected")}
        level = level.select("gram", "wanted", *[p[c].alias(f"below_{c}") for c in p])
        shorter = level.withColumnRenamed("gram", "ending").drop("wanted")
    units = F.round((F.log("below_accepted") - F.log("below_rejected")) * UNIT).cast("long")
    return level.select(F.col("gram").alias("window"), F.col("wanted").alias("n"), units.alias("units"))


def best_threshold(histogram: dict[int, tuple[int, int]]) -> int:
    """The step from which on URLs are kept, from {step: (accepted, rejected)} of calibration URLs."""
    accepted, rejected = (sum(x[i] for x in histogram.values()) for i in (0, 1))
    if not accepted or not rejected:
        return 0
    best, kept, dropped = None, accepted, 0
    for step in range(-MOST, MOST + 2):
        if step - 1 in histogram:
            kept -= histogram[step - 1][0]
            dropped += histogram[step - 1][1]
        rated = (kept * rejected + dropped * accepted, -abs(step), -step)
        if best is None or rated > best:
            best = rated
    return -best[2]


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
               order: int = ORDER) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score (of URLs that no rule fits)."""
    require(pages, id_col, url_col)
    given = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    aside = F.crc32("url") % CALIBRATE == 0
    rows = written(given.withColumns({"host": host, "path": path})
                   .withColumns({"rule": rule, "action": action})
                   .withColumn("use", F.when(F.col("action").isNull(), "judge").when(aside, "calibrate")
                               .otherwise(F.col("action")))
                   .withColumn("row", F.monotonically_increasing_id()), "url-rows")
    uses = {r["use"]: r["n"] for r in rows.groupBy("use").agg(F.count("*").alias("n")).collect()}
    if not uses.get("judge") or not uses.get(ALLOW) or not uses.get(BLOCK):
        return rows.select(F.col("id").alias(id_col), "host", "path", "rule",
                           F.coalesce("action", F.lit(ALLOW)).alias("verdict"),
                           F.lit(None).cast("double").alias("score"))

    at = rows.select("row", "use", F.explode(windows(F.col("url"), order)).alias("window"))
    wanted = F.col("use").isin("judge", "calibrate")
    counts = written(grams(at.select("window", *[
        c.cast("long").alias(n) for n, c in (("accepted", F.col("use") == ALLOW), ("rejected", F.col("use") == BLOCK),
                                             ("wanted", wanted))]), order), "url-grams")
    sizes = counts.filter(F.char_length("gram") == 1).agg(
        F.count(F.when(F.col("accepted") + F.col("rejected") > 0, 1)).alias("symbols"),
        F.sum("wanted").alias("positions")).first()
    ratios = written(log_ratios(counts, sizes["symbols"] + 1, order), "url-ratios")
    met = join_counted(at.filter(wanted).select("row", "window"), ratios, ["window"], "n", sizes["positions"])
    scores = met.groupBy("row").agg(F.sum("units").alias("units"), F.count("*").alias("windows"))
    step = F.least(F.lit(MOST), F.greatest(F.lit(-MOST), F.floor(F.col("units") / (F.col("windows") * STEP))))
    scored = written(rows.join(scores, "row", "left").withColumn("step", step), "url-scored")
    # at most 2 * MOST + 1 rows
    histogram = {r["step"]: (r["a"], r["b"]) for r in scored.filter("use = 'calibrate'").groupBy("step").agg(
        F.count(F.when(F.col("action") == ALLOW, 1)).alias("a"),
        F.count(F.when(F.col("action") == BLOCK, 1)).alias("b")).collect()}
    judged = F.when(F.col("step") >= best_threshold(histogram), ALLOW).otherwise(BLOCK)
    return scored.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", judged).alias("verdict"),
        F.when(F.col("action").isNull(), F.col("units") / F.col("windows") / UNIT).alias("score"))


def allowed_pages(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> DataFrame:
    """The pages whose URL is allowed, with all their columns: a verdict depends on the URL alone."""
    urls = pages.select(F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    judged = judge_urls(urls.select("url", F.col("url").alias("id")), rules, "id", "url")
    blocked = judged.filter(F.col("verdict") == BLOCK).select(F.col("id").alias("blocked_url")).distinct()
    p, b = pages.alias("p"), blocked.alias("b")
    return p.join(b, F.coalesce(F.col(f"p.{url_col}"), F.lit("")) == F.col("b.blocked_url"), "left_anti")
