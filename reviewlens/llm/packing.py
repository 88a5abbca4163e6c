"""Best-fit packing of tokenised documents, in bulk-synchronous supersteps.

Documents become pieces: the token ids and an end id; only documents longer
than ``capacity`` are cut, the first piece taking the remainder.

Packing works down the sizes in bands (``BAND`` = 4: sizes over a quarter of
the largest left).  A superstep:

1. range-sorts the band's pieces and the open gaps by size, which gives each
   its rank within its size (a hot size spreads over many sorted partitions);
2. sweeps down the sizes: pieces of a size go to their successor, the
   smallest gap that holds them, again and again while it stays the smallest;
   where none is left, sequences are opened.  The sweep needs only how many
   pieces and gaps have each size, two numbers per size up to ``capacity``,
   whatever the corpus; it returns matches of whole rank ranges;
3. resolves which piece gets which gap by rank: matches are broadcast (at most
   a few per size), and pieces and gaps meet in an equi-join on (size, rank),
   whose keys are unique;
4. updates the gaps by the same ranges and writes them to the shared folder.

The bands are repeated until no piece is left, ``log4(capacity)`` supersteps
at most.  As sizes only fall, the result is that of best-fit decreasing.

Defined cases: a NULL or empty text is the end id alone; rows with a NULL id
and repeated rows are packed like all others, each on its own; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SPLIT, vocabulary
from .common import require, text_or_empty, written

CAPACITY = 2048
END_ID = 0
BAND = 4


# --- documents to pieces ----------------------------------------------------

@functools.lru_cache(maxsize=4)
def encoding(vocab_path: str) -> tiktoken.Encoding:
    """The vocabulary file in the faster library; its ids must follow the merge order."""
    bpe = vocabulary(vocab_path)
    if (np.diff(bpe.merged) <= 0).any():
        raise ValueError(f"{vocab_path}: ids do not follow the order of the merges")
    ranks = {b: i for i, b in enumerate(bpe.token_bytes) if b and i not in set(bpe.added.values())}
    return tiktoken.Encoding(vocab_path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=bpe.added)


def token_ids(vocab_path: str, text: str) -> np.ndarray:
    """The ids of a whole text.

    The faster library's pattern gives up on a run of a million white-space
    characters; such a text is encoded by ``ByteBpe``, to the same ids.
    """
    coder = encoding(vocab_path)
    try:
        return coder.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return vocabulary(vocab_path).encode([text])[0].astype(np.uint32)


STRETCH = 1 << 16     # sequences that one row counts out


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    head = n % capacity
    return [(0, head)] * (head > 0) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of all documents."""
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, ids = [], []
            for row, text in enumerate(batch.column(1)):
                tokens = np.append(token_ids(vocab_path, text.as_py()), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(tokens), capacity)):
                    part = tokens[start:start + length]
                    made.append((row, k, start, length, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            table = np.array(made, np.int64).reshape(-1, 5)
            columns = [batch.column(0).take(pa.array(table[:, 0])), *(pa.array(table[:, i]) for i in range(1, 5))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


# --- one superstep ----------------------------------------------------------

def sweep(pieces_of: Mapping[int, int], gaps_of: Mapping[int, int], capacity: int):
    """Best-fit of piece sizes, largest first, into gap sizes.

    Returns (matches, runs, opened).  A match (size, first, last, gap, base,
    used, per): pieces of ``size`` ranked first..last-1 go, ``per`` to each, to
    gaps of ``gap`` ranked from ``base``, behind ``used`` tokens placed there in
    this superstep.  A run (gap, first, last, left): what remains of gaps of
    ``gap`` ranked first..last-1.  New sequences count as gaps of size
    ``capacity``.
    """
    runs: list[list[list[int]]] = [[] for _ in range(capacity + 1)]   # by what is left: [gap, first, last]
    for gap, n in gaps_of.items():
        runs[gap].append([gap, 0, n])
    matches, opened = [], 0
    for size in sorted(pieces_of, reverse=True):
        rank, total = 0, pieces_of[size]
        left = size
        while rank < total:
            while left < capacity and not runs[left]:
                left += 1
            if left >= capacity:                          # no gap holds it
                left, per = capacity, capacity // size
                need = -(-(total - rank) // per)
                run, opened = [capacity, opened, opened + need], opened + need
            else:
                per, run = left // size, runs[left].pop()
            gap, first, last = run
            count = min(last - first, -(-(total - rank) // per))
            put = min(total - rank, count * per)
            matches.append((size, rank, rank + put, gap, first, gap - left, per))
            full, part = divmod(put, per)
            for a, b, after in ((first, first + full, left - per * size),
                                (first + full, first + count, left - part * size),
                                (first + count, last, left)):
                if a < b:
                    runs[after].append([gap, a, b])
            rank += put
            left = size
    return matches, [(g, a, b, left) for left, held in enumerate(runs) for g, a, b in held], opened


def ranked(rows: DataFrame, size_col: str, *keys: str) -> DataFrame:
    """``rows`` range-sorted by size, with the ``rank`` of each within its size."""
    placed = written(rows.repartitionByRange(F.desc(size_col), *keys)
                     .sortWithinPartitions(F.desc(size_col), *keys)
                     .withColumn("_at", F.monotonically_increasing_id()), "pack-sorted")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    # sorted partitions: one row per size, and one more per cut between partitions
    starts = (placed.groupBy(size_col, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")))
    before = Window.partitionBy(size_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (placed.join(F.broadcast(starts), [size_col, "_part"])
            .withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_at", "_part", "_first", "_before"))


def _counts(rows: DataFrame, size_col: str) -> dict[int, int]:
    """How many rows have each size: at most ``capacity`` rows."""
    return {r[0]: r[1] for r in rows.groupBy(size_col).count().collect()}


def _table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names.split()))


def pack(pieces_df: DataFrame, size_col: str = "length", keys: tuple[str, ...] = ("id", "piece"),
         capacity: int = CAPACITY, band: int = BAND) -> DataFrame:
    """``pieces_df`` with sequence_id and offset; sizes are from 1 to ``capacity``."""
    spark = pieces_df.sparkSession
    rows = written(ranked(pieces_df, size_col, *keys), "pack-pieces")
    left = _counts(rows, size_col)
    gaps, sequences, done = None, 0, []
    while left:
        top = max(left)
        low = top // band                                  # the band: sizes over low
        now = {s: n for s, n in left.items() if s > low}
        left = {s: n for s, n in left.items() if s <= low}
        if gaps is not None:
            gaps = written(ranked(gaps, "gap", "sequence_id"), "pack-ranked")
        matches, runs, opened = sweep(now, _counts(gaps, "gap") if gaps is not None else {}, capacity)

        # at most a few ranges per size: bounded by the capacity, not by the rows
        ranges = F.broadcast(_table(spark, matches, "size first last gap base used per"))
        chosen = (rows.filter((F.col(size_col) > low) & (F.col(size_col) <= top))
                  .join(ranges, (F.col(size_col) == F.col("size")) & (F.col("rank") >= F.col("first"))
                        & (F.col("rank") < F.col("last")))
                  .withColumn("_i", F.col("rank") - F.col("first"))
                  .withColumn("gap_rank", F.expr("base + _i div per"))
                  .withColumn("offset", F.lit(capacity) - F.col("gap") + F.col("used")
                              + F.col("_i") % F.col("per") * F.col(size_col)))
        kept = [c for c in pieces_df.columns]
        fresh = (chosen.filter(F.col("gap") == capacity)
                 .select(*kept, (F.col("gap_rank") + sequences).alias("sequence_id"), "offset"))
        placed = fresh
        left_over = [r for r in runs if r[3] > 0]
        if gaps is not None:
            placed = fresh.unionByName(
                chosen.filter(F.col("gap") < capacity).select(*kept, "offset", "gap", "gap_rank")
                .join(gaps.select("gap", F.col("rank").alias("gap_rank"), "sequence_id"), ["gap", "gap_rank"])
                .select(*kept, "sequence_id", "offset"))
        done.append(written(placed, "pack-placed"))
        if not left:
            break
        # what is left of new sequences: their ranges, counted out; of older gaps: met by size and rank
        after = _table(spark, [r for r in left_over if r[0] == capacity], "gap first last left")
        remain = (after.select("last", "left", F.explode(F.expr(f"sequence(first, last - 1, {STRETCH}L)")).alias("start"))
                  .repartition("start", "left")
                  .select("left", F.explode(F.expr(f"sequence(start, least(start + {STRETCH}L, last) - 1)")).alias("rank"))
                  .select((F.col("rank") + sequences).alias("sequence_id"), F.col("left").alias("gap")))
        if gaps is not None:
            older = F.broadcast(_table(spark, [r for r in left_over if r[0] < capacity], "gap first last left"))
            remain = remain.unionByName(gaps.join(older, "gap").filter("rank >= first AND rank < last")
                                        .select("sequence_id", F.col("left").alias("gap")))
        gaps = written(remain, "pack-gaps")
        sequences += opened
    out = done[0] if done else rows.select(*pieces_df.columns).withColumns(
        {"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = written(pieces(docs, vocab_path, id_col, text_col, capacity, end_id), "pack-made")
    return pack(made, "length", ("id", "piece"), capacity).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
              capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most ``capacity`` of them), pieces."""
    made = written(pieces(docs, vocab_path, id_col, text_col, capacity, end_id, with_ids=True), "pack-made")
    packed = pack(made, "length", ("id", "piece"), capacity)
    # a group is one sequence: at most ``capacity`` pieces and ids
    held = F.sort_array(F.collect_list(F.struct("offset", "id", "piece", "ids")))
    return (packed.groupBy("sequence_id").agg(held.alias("held"))
            .select("sequence_id", F.flatten("held.ids").alias("ids"),
                    F.transform("held", lambda p: F.struct(p["id"].alias(id_col), p["piece"].alias("piece"),
                                                           p["offset"].alias("offset"))).alias("pieces")))
