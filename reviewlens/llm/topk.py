"""Exact top-k inner products by a pivot-distance index.

Vectors are made whole numbers (floor(scale * x)) and compared by their inner
product.  One more coordinate, sqrt(M^2 - |v|^2) with M the largest norm, turns
the largest inner product into the smallest distance:
|q' - v'|^2 = |q|^2 + M^2 - 2 q.v with q' = (q, 0).

Index: pivots are fitted on a bounded sample (``SAMPLE`` rows, the smallest by
a hash of the id: farthest-first, then two rounds of means); every vector is
keyed by its nearest pivot and its distance to it, and belongs to a cell
(pivot, part).  Parts split a cell that holds over ``CELL_ROWS`` rows by a hash
of the id, so a hot vector spreads.

Search, in two steps that share one function: a cell's vectors are sorted by
distance to the pivot into annuli of ``ANNULUS`` rows; a query walks them
outwards from its own distance, and stops where the triangle inequality,
|d(q, p) - d(v, p)| <= d(q, v), leaves no better vector.  First each query
searches its nearest cell, which gives it a k-th score to beat; then it is sent
to those cells whose distance range can still hold a better one.  Bounds are
widened by ``SLACK`` for rounding; scores are exact integers.

Sizes: the cell table (pivots, parts, distance ranges) has a row per pivot.  The
queries that are sent to a cell go there in blocks of about ``QUERY_ROWS``, and
its vectors to each block, so a group is bounded by the parameters.

Defined cases: a vector that is NULL or holds a NULL, NaN or infinity takes no
part, nor does a NULL id or one of another length than the commonest; a
candidate listed twice counts once, with its best score; a query id is answered
once, from all its vectors; fewer than k candidates give fewer rows; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require, written

SCALE = 256
K = 5
PIVOTS = 64
SAMPLE = 4096
CELL_ROWS = 4096
ANNULUS = 256
QUERY_BLOCK = 512
QUERY_ROWS = 8192       # queries of a group, about
SLACK = 1e-6


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, vec array<double> of whole numbers, norm2) of the rows that take part."""
    require(vectors, id_col, vec_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    return (rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("vec"))
            .withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x)))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Farthest-first centres of a sample, moved twice to the means of their rows."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [sample[0]]
    far = ((sample - chosen[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(sample)) and far.max() > 0:
        chosen.append(sample[far.argmax()])
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(1))
    centres = np.array(chosen)
    for _ in range(2):
        near = distances(sample, centres).argmin(1)
        centres = np.array([sample[near == i].mean(0) if (near == i).any() else c
                            for i, c in enumerate(centres)])
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T))


def search_cell(query_ids: np.ndarray, queries: np.ndarray, to_pivot: np.ndarray, beat: np.ndarray,
                ids: np.ndarray, vectors: np.ndarray, pivot_dist: np.ndarray, top2: float, k: int):
    """The k best of one cell for each query, those under ``beat`` left out.

    ``pivot_dist`` are the vectors' distances to the cell's pivot, ``to_pivot``
    the queries' (with their extra coordinate), ``top2`` is M^2.  Returns
    (query index, vector id, score) arrays.
    """
    order = np.argsort(pivot_dist, kind="stable")
    ids, vectors, pivot_dist = ids[order], vectors[order], pivot_dist[order]
    repeated = len(np.unique(ids)) < len(ids)
    starts = np.arange(0, len(ids), ANNULUS)
    inner, outer = pivot_dist[starts], pivot_dist[np.minimum(starts + ANNULUS, len(ids)) - 1]
    # no vector of an annulus is nearer to the query than this
    bound = np.maximum(0, np.maximum(inner[None, :] - to_pivot[:, None], to_pivot[:, None] - outer[None, :]))
    walk = np.argsort(bound, axis=1, kind="stable")
    q2 = (queries**2).sum(1)
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    best = np.full((len(queries), k), -np.inf)
    active = np.arange(len(queries))
    for turn in range(len(starts)):
        block = walk[active, turn]
        near = bound[active, block]
        # the highest score that distance ``near`` allows
        allowed = (q2[active] + top2 - near**2) / 2
        allowed += SLACK * (1 + q2[active] + top2)
        go = allowed >= np.maximum(best[active, -1], beat[active])
        active, block = active[go], block[go]        # bounds only grow along the walk
        if not len(active):
            break
        for b in np.unique(block):
            who = active[block == b]
            part = slice(starts[b], starts[b] + ANNULUS)
            score = queries[who] @ vectors[part].T
            score[query_ids[who][:, None] == ids[part][None, :]] = -np.inf
            both_ids = np.concatenate([best_ids[who], np.broadcast_to(ids[part], score.shape)], 1)
            both = np.concatenate([best[who], score], 1)
            if repeated:                              # of the rows of one id the best alone takes a place
                pick = np.lexsort((-both, both_ids), axis=1)
                both_ids, both = np.take_along_axis(both_ids, pick, 1), np.take_along_axis(both, pick, 1)
                both[:, 1:][both_ids[:, 1:] == both_ids[:, :-1]] = -np.inf
            pick = np.lexsort((both_ids, -both), axis=1)[:, :k]
            best_ids[who] = np.take_along_axis(both_ids, pick, 1)
            best[who] = np.take_along_axis(both, pick, 1)
    at, rank = np.nonzero((best > -np.inf) & (best >= beat[:, None]))
    return at, best_ids[at, rank], best[at, rank].astype(np.int64)


def _search(queries: DataFrame, index: DataFrame, width: int, top2: float, k: int) -> DataFrame:
    """Blocks of queries (query_id, vec, to_pivot, beat) meet the vectors of their cell (pivot, part)."""
    def run(cell_queries: pa.Table, cell: pa.Table) -> pa.Table:
        out = []
        if cell_queries.num_rows and cell.num_rows:
            ids, vectors = cell.column("id").to_numpy(), matrix(cell.column("vec"), width)
            pivot_dist = cell.column("dist").to_numpy()
            for at in range(0, cell_queries.num_rows, QUERY_BLOCK):
                block = cell_queries.slice(at, QUERY_BLOCK)
                who = block.column("query_id").to_numpy()
                row, vec_id, score = search_cell(
                    who, matrix(block.column("vec"), width), block.column("to_pivot").to_numpy(),
                    block.column("beat").to_numpy(), ids, vectors, pivot_dist, top2, k)
                out.append((who[row], vec_id, score))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), parts, strict=True)))

    keys = ["pivot", "part", "block"]
    return (queries.groupBy(*keys).cogroup(index.groupBy(*keys))
            .applyInArrow(run, "query_id bigint, vec_id bigint, score bigint"))


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
          k: int = K, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best other vectors.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vec_col, scale)
    sizes = rows.groupBy(F.size("vec").alias("w")).agg(F.count("*").alias("n"), F.max("norm2").alias("m"))
    common = sizes.orderBy(F.desc("n"), F.desc("w")).first()
    if common is None or common["w"] == 0:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width, top2 = common["w"], float(common["m"])
    rows = rows.filter(F.size("vec") == width)
    sample = (rows.select("id", "vec", "norm2", F.xxhash64("id").alias("h")).orderBy("h", "id", "vec")
              .limit(SAMPLE).toArrow())
    extra = np.sqrt(np.maximum(0, top2 - sample.column("norm2").to_numpy()))[:, None]
    centres = fit_pivots(np.hstack([matrix(sample.column("vec"), width), extra]), pivots)

    def key(batches):
        for batch in batches:
            vec = matrix(batch.column(1), width)
            high = np.sqrt(np.maximum(0, top2 - batch.column(2).to_numpy()))[:, None]
            dist = distances(np.hstack([vec, high]), centres)
            near = dist.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near, pa.int32()),
                 pa.array(dist[np.arange(len(near)), near])], ["id", "vec", "pivot", "dist"])

    keyed = written(rows.select("id", "vec", "norm2").mapInArrow(
        key, "id bigint, vec array<double>, pivot int, dist double"), "topk-keyed")
    # a row per pivot
    parts = {r["pivot"]: max(1, math.ceil(r["n"] / CELL_ROWS))
             for r in keyed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    split = F.create_map(*[F.lit(x) for item in sorted(parts.items()) for x in item])
    index = keyed.withColumn("part", F.pmod(F.xxhash64("id"), split[F.col("pivot")]).cast("int"))
    # a row per pivot; the parts of a pivot share its range
    ranges = {r["pivot"]: (r["low"], r["high"]) for r in
              keyed.groupBy("pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high")).collect()}
    low = np.array([ranges.get(p, (np.inf, -np.inf))[0] for p in range(len(centres))])
    high = np.array([ranges.get(p, (np.inf, -np.inf))[1] for p in range(len(centres))])

    def nearest(batches):
        for batch in batches:
            vec = matrix(batch.column(1), width)
            dist = distances(np.hstack([vec, np.zeros((len(vec), 1))]), centres)
            dist[:, np.isinf(low)] = np.inf
            near = dist.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near, pa.int32()),
                 pa.array(dist[np.arange(len(near)), near]), pa.array(np.full(len(near), -np.inf))],
                ["query_id", "vec", "pivot", "to_pivot", "beat"])

    def others(batches):
        for batch in batches:
            vec, first = matrix(batch.column(1), width), batch.column(2).to_numpy()
            beat = batch.column(3).to_numpy(zero_copy_only=False)
            dist = distances(np.hstack([vec, np.zeros((len(vec), 1))]), centres)
            bound = np.maximum(0, np.maximum(low - dist, dist - high))
            q2 = (vec**2).sum(1)[:, None]
            allowed = (q2 + top2 - bound**2) / 2 + SLACK * (1 + q2 + top2)
            go = (allowed >= beat[:, None]) & ~np.isinf(low)
            go[np.arange(len(vec)), first] = False
            who, pivot = np.nonzero(go)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)),
                 pa.array(pivot, pa.int32()), pa.array(dist[who, pivot]), pa.array(beat[who])],
                ["query_id", "vec", "pivot", "to_pivot", "beat"])

    def search(queries: DataFrame, name: str) -> DataFrame:
        """Queries in blocks, repeated for each part of their cell; vectors for each block sent there."""
        sent = written(queries, name)
        # a row per pivot
        blocks = {r["pivot"]: math.ceil(r["n"] / QUERY_ROWS)
                  for r in sent.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
        many = F.create_map(*[F.lit(x) for item in sorted(blocks.items() or [(-1, 1)]) for x in item])
        many = many[F.col("pivot")]
        asked = (sent.withColumn("block", F.pmod(F.xxhash64("query_id"), many).cast("int"))
                 .withColumn("part", F.explode(F.sequence(F.lit(0), split[F.col("pivot")] - 1))))
        rows = (index.filter(F.col("pivot").isin(list(blocks)))
                .withColumn("block", F.explode(F.sequence(F.lit(0), many - 1))))
        return _search(asked, rows, width, top2, k)

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    schema = "query_id bigint, vec array<double>, pivot int, to_pivot double, beat double"
    queries = keyed.filter(is_query).select("id", "vec")
    first = written(best(search(queries.mapInArrow(nearest, schema), "topk-nearest")), "topk-first")
    threshold = (first.filter(F.col("rank") == k)
                 .select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("beat")))
    asked = (queries.mapInArrow(nearest, schema).select(F.col("query_id").alias("id"), "vec", F.col("pivot"))
             .join(threshold, "id", "left")
             .select("id", "vec", "pivot", F.coalesce("beat", F.lit(float("-inf"))).alias("beat")))
    second = search(asked.mapInArrow(others, schema), "topk-others")
    return best(first.select("query_id", "vec_id", "score").unionByName(second)).select(
        "query_id", "rank", "vec_id", "score")
