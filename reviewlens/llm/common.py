"""Helpers shared by the operators: tables in, tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back.

    Cuts lineage with a table that every executor sees, so a lost executor
    costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    """A text column with NULL read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def text_digest(name: str) -> Column:
    """SHA-256 of a text column, NULL as the empty text."""
    return F.unhex(F.sha2(text_or_empty(name), 256))


DROPPED_BROADCAST = 200_000       # (id, digest) pairs, 40 bytes each


def _whole(docs: DataFrame) -> DataFrame:
    """The documents as one struct column ``doc``, so that no name of theirs meets another column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def _digest_in(doc: str, text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(f"{doc}.`{text_col}`"), F.lit("")), 256))


def _counted(pairs: DataFrame) -> DataFrame:
    """The distinct (id, digest) pairs, written and counted: few are broadcast, so no text is shuffled."""
    held = written(pairs.distinct(), "dropped")
    return F.broadcast(held) if held.count() <= DROPPED_BROADCAST else held


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose (id, digest) is in ``dropped``; all its columns, whatever their names."""
    same = F.col(f"doc.`{id_col}`").eqNullSafe(F.col("id")) & (_digest_in("doc", text_col) == F.col("digest"))
    return _whole(docs).join(_counted(dropped), same, "left_anti").select("doc.*")


def one_of_each(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row for each (id, digest) in ``repeated``: the least by a hash of the whole row.

    Other rows pass through; only those repeated are grouped, with partial aggregation.
    """
    if repeated.isEmpty():
        return docs
    pairs = _counted(repeated)
    rows = _whole(docs)
    same = F.col(f"doc.`{id_col}`").eqNullSafe(F.col("id")) & (_digest_in("doc", text_col) == F.col("digest"))
    several = rows.join(pairs, same, "left_semi").groupBy(
        F.col(f"doc.`{id_col}`").alias("id"), _digest_in("doc", text_col).alias("digest")).agg(
        F.min_by("doc", F.xxhash64(F.to_json("doc"))).alias("doc"))
    return rows.join(pairs, same, "left_anti").unionByName(several.select("doc")).select("doc.*")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


HEAVY = 1024          # a key held by over such a share of the rows is joined map-side


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int,
                 heavy: int = HEAVY) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and, in ``count``, the rows that hold it.

    The counts add up to ``total`` at most, so fewer than ``heavy`` keys hold over a
    ``heavy``-th of the rows: these are broadcast, and no key of the ordinary join is hot.
    """
    hot = F.col(count) * heavy > total
    big = F.broadcast(table.filter(hot))
    met = rows.join(big, keys)
    rest = rows.join(F.broadcast(table.filter(hot).select(*keys)), keys, "left_anti")
    return met.unionByName(rest.join(table.filter(~hot), keys))
