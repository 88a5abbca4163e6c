"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

1. Every text is reduced to its SHA-256; (id, digest) is written once, so the
   texts are read and hashed one time.
2. A frequent-items sketch of the Misra-Gries family (``approx_top_k``) finds
   the digests that may be frequent.  It is built per input partition and
   merged in ``MERGE_GROUPS`` groups, whose most frequent items are summed.  A
   digest held by over a ``1/TRACKED`` part of all rows holds that part of
   some group's rows too, so it is always tracked there.
3. The candidates are verified: their rows are counted exactly, with partial
   aggregation, into at most ``HEAVY`` winners (digest, largest id, count).
   These are broadcast, and rows of frequent digests are decided on the map
   side and never shuffled.
4. All other digests go through one ordinary shuffle.  Their groups are small,
   because every large one was split off.

Defined cases: a NULL text counts as empty; a NULL id sorts below every id, so
it is kept only if all ids of its group are NULL; rows that repeat the kept id
are the kept document itself and are all marked ``kept``, but the filter
``drop_exact_copies`` lets one of them stay; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import one_of_each, require, text_or_empty, without, written

HEAVY = 1024          # most winners broadcast (about 60 bytes each)
TRACKED = 4096        # items that a sketch tracks
MERGE_GROUPS = 256    # groups of input partitions, a sketch each


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): one row per input row; digest is the binary SHA-256 of the text."""
    require(docs, id_col, text_col)
    return docs.select(F.col(id_col).alias("id"),
                       F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"))


def frequent_digests(rows: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """At most ``heavy`` 64-bit digest keys that may be frequent (candidates)."""
    sketches = (rows.select(F.xxhash64("digest").alias("key"),
                            F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("part"))
                .groupBy("part").agg(F.expr(f"approx_top_k_accumulate(key, {tracked})").alias("s")))
    return (sketches.select(F.explode(F.expr(f"approx_top_k_estimate(s, {heavy})")).alias("c"))
            .groupBy(F.col("c.item").alias("key")).agg(F.sum("c.count").alias("n"))
            .filter("n > 1").orderBy(F.desc("n"), "key").limit(heavy).select("key"))


def verified_winners(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size), exact, for the candidate digests."""
    return (rows.join(F.broadcast(candidates), F.xxhash64("digest") == F.col("key"), "left_semi")
            .groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    rows = written(digests(docs, id_col, text_col), "exact-digests")
    # A table of at most ``heavy`` rows: proven bound for the broadcasts below.
    winners = F.broadcast(written(
        verified_winners(rows, written(frequent_digests(rows, heavy, tracked), "exact-candidates")),
        "exact-winners"))
    frequent = rows.join(winners, "digest")
    group = Window.partitionBy("digest")
    rest = (rows.join(winners, "digest", "left_anti")
            .withColumn("keep_id", F.max("id").over(group))
            .withColumn("group_size", F.count("*").over(group)))
    return frequent.unionByName(rest).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names.

    One row of a group stays: of rows that repeat the kept id, too, the least by a hash of the whole row.
    """
    decided = written(exact_dedup(docs, id_col, text_col).select(
        F.col(id_col).alias("id"), F.unhex("text_sha256").alias("digest"), "kept"), "exact-decided")
    left = without(docs, decided.filter(~F.col("kept")).select("id", "digest"), id_col, text_col)
    repeated = decided.filter("kept").groupBy("id", "digest").count().filter("count > 1").select("id", "digest")
    return one_of_each(left, repeated, id_col, text_col)
