"""Line dedup within one edit, by a deletion-neighbourhood join, natively.

Lines are the parts of a text between line feeds.  A line goes if the same
line, or one at most one edit (insertion, deletion, substitution of a
character) away, stands earlier, in the order of (id, line number); the
earliest of all stays.  The rule looks at original lines, so it is not
transitive.

1. Equal lines: every line is reduced to its SHA-256; one aggregate gives each
   distinct line its earliest place, without shuffling a text.
2. Lines that can have a neighbour: lines of n characters within one edit
   share their first or their last (m - 1) / 2 characters, m being the smaller
   length.  Only lines that share such a half with another distinct line go on,
   so most texts are never shuffled.  Likewise a line goes on only with those
   windows of ``WINDOW`` characters around which it equals another line.  No
   link is lost by either.
3. Deletion neighbourhood: each remaining line emits, as hashed keys, all its
   variants with one character deleted, and itself.  A variant is hashed per
   window, as (hash of what stands before, hash of what stands behind, the
   window's variant), so a line of n characters costs n keys and not n texts.
   - Lines whose variants are equal at the same place differ by a substitution:
     they are all linked with each other.
   - A line that equals another's variant differs from it by a deletion.
   In both cases the earliest line of a key is a minimum, taken with partial
   aggregation; no pairs within a key are formed, and a line takes the minimum
   over its own keys.
4. The line found is verified by its edit distance before the other one goes.

Skew: a line, half or variant that fills a third of the corpus is met by
partial aggregates only, and joins are on sides with one row per key that AQE
may split.

Defined cases: a NULL text counts as empty and is one empty line; empty lines
are lines like others; a NULL id sorts first; repeated rows (same id and text)
are one document and keep the same lines; of rows that share an id but not the
text, lines go by (id, line number, hash of the text); a NULL text that keeps
its line stays NULL; further columns are kept; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, text_or_empty, written

WINDOW = 64
RUN = 128                     # windows that are summed together
BROADCAST_ROWS = 1_000_000    # lines that may have a neighbour, 8 bytes each


def _key(*parts: Column) -> Column:
    """A 128-bit key of some values."""
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("h"), F.xxhash64(F.lit(2), *parts).alias("l"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, line): all lines; a place is (id, line number, hash of the text)."""
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return (rows.select("id", F.xxhash64("text").alias("doc"), F.posexplode(F.split("text", "\n", -1))
                        .alias("line_no", "line"))
            .select(F.struct("id", "line_no", "doc").alias("place"), "line"))


def _digest() -> Column:
    return F.unhex(F.sha2("line", 256))


def _halves() -> Column:
    """Keys that two lines share if one edit apart: a half, with the shorter one's length."""
    n = F.length("line")

    def of(shorter: Column) -> list[Column]:
        h = F.greatest(F.lit(0), F.floor((shorter - 1) / 2).cast("int"))
        return [F.xxhash64(shorter, F.lit("first"), F.substring("line", F.lit(1), h)),
                F.xxhash64(shorter, F.lit("last"), F.right("line", h))]

    return F.array(*of(n), *of(F.greatest(F.lit(0), n - 1)))


def first_places(digested: DataFrame) -> DataFrame:
    """(digest, place, n, halves): each distinct line's earliest place and number of places."""
    return digested.groupBy("digest").agg(F.min("place").alias("place"), F.count("*").alias("n"),
                                          F.first("halves").alias("halves"))


def _sharing(keyed: DataFrame, *row: str) -> DataFrame:
    """The ``row`` values of (*row, line_hash, k) whose key is shared with another line."""
    shared = (keyed.groupBy("k").agg(F.min("line_hash").alias("a"), F.max("line_hash").alias("b"))
              .filter("a <> b").select("k"))
    return keyed.join(shared, "k", "left_semi").select(*row).distinct()


def with_half_neighbour(firsts: DataFrame) -> DataFrame:
    """(line_hash): hashes of the digests of lines that share a half with another line."""
    return _sharing(firsts.select(F.xxhash64("digest").alias("line_hash"), F.explode("halves").alias("k")),
                    "line_hash")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _running_xor(values: Column) -> Column:
    """The XOR of the first 0, 1, ..., n values; in runs of ``RUN``, so that a long line costs little more
    than its length."""
    def prefix(upto: Column, runs_before: Column) -> Column:
        run = F.floor(upto / RUN).cast("int")
        inside = _xor(F.slice(values, run * RUN + 1, upto - run * RUN))
        return F.element_at(runs_before, run + 1).bitwiseXOR(inside)

    last = F.floor(F.size(values) / RUN).cast("int")
    each_run = F.transform(F.sequence(F.lit(0), last), lambda r: _xor(F.slice(values, r * RUN + 1, F.lit(RUN))))
    before = _let(each_run, lambda x: F.transform(
        F.sequence(F.lit(0), last), lambda r: _xor(F.slice(x, F.lit(1), r))))
    return _let(before, lambda x: F.transform(F.sequence(F.lit(0), F.size(values)), lambda w: prefix(w, x)))


def windows(distinct: DataFrame) -> DataFrame:
    """(digest, place, w, body, before, behind, behind_short): the windows around which a line
    equals another one, itself whole or with one character less.

    What stands before and behind a window is the XOR of a hash of each other
    window with its number: linear in the line's length.
    """
    every = f"(?s).{{1,{WINDOW}}}"

    def hashed(pieces: Column, first: int) -> Column:
        return F.transform(pieces, lambda c, k: F.xxhash64(k + first, c))

    def row(pieces, before, short, w):
        def upto(sums, n):
            return F.element_at(sums, F.least(n, F.size(sums) - 1) + 1)
        return F.struct(w.alias("w"), F.coalesce(F.get(pieces, w), F.lit("")).alias("body"),
                        upto(before, w).alias("before"),
                        F.element_at(before, -1).bitwiseXOR(upto(before, w + 1)).alias("behind"),
                        F.element_at(short, -1).bitwiseXOR(upto(short, w)).alias("behind_short"))

    # the line's windows, and those behind the first of a line that has one character less before them
    pieces = F.regexp_extract_all("line", F.lit(every), F.lit(0))
    shorter = F.regexp_extract_all(F.expr(f"substring(line, {WINDOW})"), F.lit(every), F.lit(0))
    shorter = F.when(F.length("line") >= WINDOW, shorter).otherwise(F.array().cast("array<string>"))
    count = F.floor(F.length("line") / WINDOW).cast("int")
    rows = _let(pieces, lambda p: _let(_let(hashed(p, 0), _running_xor), lambda b: _let(
        _let(hashed(shorter, 1), _running_xor), lambda s: F.transform(
            F.sequence(F.lit(0), count), lambda w: row(p, b, s, w)))))
    cut = distinct.select("digest", "place", F.explode(rows).alias("x")).select(
        "digest", "place", "x.w", F.xxhash64("digest").alias("line_hash"), "x.body", "x.before", "x.behind",
        "x.behind_short")
    cut = written(cut, "lines-windows")
    around = F.array(F.xxhash64("w", "before", "behind"), F.xxhash64("w", "before", "behind_short"))
    shared = _sharing(cut.select("digest", "w", "line_hash", F.explode(around).alias("k")), "digest", "w")
    return cut.join(shared, ["digest", "w"], "left_semi").drop("line_hash")


def _one_edit(a: str, b: str) -> Column:
    """Whether two texts are at most one edit apart, in n log n: the common beginning is found by
    halving, and what follows the first difference is compared."""
    bits = f"sequence(cast(log2(least(length({a}), length({b})) + 1) as int), 0, -1)"
    step = "at + shiftleft(1, k)"
    common = (f"aggregate({bits}, 0, (at, k) -> if({step} <= least(length({a}), length({b})) "
              f"and left({a}, {step}) = left({b}, {step}), {step}, at))")
    rest = (f"case length({b}) - length({a}) when 0 then substring({a}, p + 2) = substring({b}, p + 2) "
            f"when 1 then substring({a}, p + 1) = substring({b}, p + 2) "
            f"when -1 then substring({a}, p + 2) = substring({b}, p + 1) else false end")
    return F.expr(f"transform(array({common}), p -> {rest})[0]")


def neighbourhood(cut: DataFrame) -> DataFrame:
    """(digest, place, key, kind): 'same' is the line itself, 'cut' a deletion, 'at' a deletion
    together with its place."""
    def row(kind: str, *parts: Column) -> Column:
        return F.struct(_key(F.lit(kind == "at"), *parts).alias("key"), F.lit(kind).alias("kind"))

    def without(i: Column) -> Column:
        return F.concat(F.substring("body", F.lit(1), i), F.substring("body", i + 2, F.lit(WINDOW)))

    # the line itself, cut as the window of a longer line with one deletion is
    itself = F.array(row("same", F.col("w"), F.col("before"), F.col("behind_short"),
                         F.substring("body", F.lit(1), F.lit(WINDOW - 1))))
    at = F.when(F.length("body") > 0, F.sequence(F.lit(0), F.length("body") - 1)).otherwise(
        F.array().cast("array<int>"))
    context = [F.col("w"), F.col("before"), F.col("behind")]
    # of a run of one character any deletion is the same: the first stands for all
    starts = F.filter(at, lambda i: (i == 0) | (F.substring("body", i, F.lit(1)) != F.substring("body", i + 1, F.lit(1))))
    cuts = F.transform(starts, lambda i: row("cut", *context, without(i)))
    ats = F.transform(at, lambda i: row("at", *context, without(i), i))
    return (cut.select("digest", "place", F.explode(F.concat(itself, cuts, ats)).alias("x"))
            .select("digest", "place", F.col("x.key").alias("key"), F.col("x.kind").alias("kind")))


def earlier_neighbours(distinct: DataFrame) -> DataFrame:
    """(digest, neighbour): the earliest line one edit away of lines that have an earlier one;
    a neighbour is (place, digest)."""
    keys = written(neighbourhood(windows(distinct)), "lines-variants")
    line = F.struct("place", "digest")
    by_key = (keys.groupBy("key")
              .agg(F.min(F.when(F.col("kind") != "cut", line)).alias("whole"),
                   F.min(F.when(F.col("kind") == "cut", line)).alias("cut"), F.count("*").alias("n"))
              .filter("n > 1"))
    # a deletion meets the line that it equals, that line the deletions, a place its substitutions
    met = keys.join(by_key, "key").select("digest", "place", F.when(
        F.col("kind") == "same", F.col("cut")).otherwise(F.col("whole")).alias("neighbour"))
    found = (met.filter(F.col("neighbour.place") < F.col("place"))
             .groupBy("digest").agg(F.min("neighbour").alias("neighbour")))
    mine = distinct.select("digest", "line")
    other = distinct.select(F.col("digest").alias("other_digest"), F.col("line").alias("other"))
    return (found.join(mine, "digest").join(other, F.col("neighbour.digest") == F.col("other_digest"))
            .filter(_one_edit("line", "other")).select("digest", "neighbour"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, keep): the places of the lines that go, and that of the line they repeat."""
    found = lines(docs, id_col, text_col)
    digested = written(found.select("place", _digest().alias("digest"), _halves().alias("halves")), "lines-digests")
    firsts = written(first_places(digested), "lines-firsts")
    able = written(with_half_neighbour(firsts), "lines-able")
    if able.count() <= BROADCAST_ROWS:
        able = F.broadcast(able)                # else the lines are shuffled to it
    texts = (found.select(_digest().alias("digest"), "line", "place")
             .join(able, F.xxhash64("digest") == F.col("line_hash"), "left_semi"))
    distinct = written(texts.groupBy("digest")
                       .agg(F.min("place").alias("place"), F.first("line").alias("line")), "lines-distinct")
    near = written(earlier_neighbours(distinct), "lines-near")
    # lines that stand at several places or have a neighbour; all others stay
    marked = (firsts.join(near, "digest", "left").filter((F.col("n") > 1) | F.col("neighbour").isNotNull())
              .select("digest", F.col("place").alias("first"), F.col("neighbour.place").alias("near")))
    return (digested.select("digest", "place").join(marked, "digest")
            .filter(F.col("near").isNotNull() | (F.col("place") != F.col("first")))
            .select("place", F.coalesce("near", "first").alias("keep")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that stay in ``text_col``, and n_lines and n_kept before it."""
    gone = (dropped_lines(docs, id_col, text_col)
            .groupBy(F.col("place.id").alias("gone_id"), F.col("place.doc").alias("gone_doc"))
            .agg(F.collect_set("place.line_no").alias("gone")))       # at most the document's lines
    # the document's columns are one struct, so that no name of theirs meets one of these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    rows = rows.withColumn("given", F.coalesce(F.col(f"d.`{text_col}`"), F.lit("")))
    rows = rows.join(gone, F.col(f"d.`{id_col}`").eqNullSafe(F.col("gone_id"))
                     & (F.xxhash64("given") == F.col("gone_doc")), "left")
    rows = rows.withColumn("lines", F.split("given", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1),
                          F.coalesce("gone", F.array().cast("array<int>")))
    text = F.when(F.col("gone").isNull(), F.col(f"d.`{text_col}`")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return rows.select(
        *[(text if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in docs.columns],
        F.size("lines").alias("n_lines"), F.size(stay).alias("n_kept"))
