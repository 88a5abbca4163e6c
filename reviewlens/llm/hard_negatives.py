"""Hard negatives by angular triangle filtering.

Vectors are made whole numbers (floor(scale * x)); a score is an integer inner
product.  Of every anchor, the positives are its best rows of the same label,
and a positive's hard negatives are the best rows of other labels whose score
lies in a window of the positive's score.

Index: ``REFERENCES`` unit directions are fitted on a bounded sample
(``SAMPLE`` rows, the smallest by a hash of the id).  Every row is indexed with
its angles to all of them, stored as 32-bit floats, and its norm, and belongs
to the cell of its nearest direction.

Filter: with a and b the angles of query and row to one direction, their own
angle lies between |a - b| and min(a + b, 2 pi - a - b), so its cosine lies
between cos(a + b) and cos(a - b); every direction narrows the interval.  Times
the norms this bounds the score, widened by ``SLACK`` for the stored angles and
rounding.  First blocks of ``BLOCK`` rows, sorted by their angle, are judged by
their ranges of angles and norms, then the rows of the blocks that are left by
their own angles; what overlaps no window, or cannot beat the k-th best found
so far, gets no integer score.

Sizes: a cell is split by a hash of the id into parts of about ``CELL_ROWS``
rows, the queries that go to a cell into blocks of about ``QUERY_ROWS``, so a
group holds a part and a block whatever the table's size.  Rows equal in vector
and label score alike, so only the smallest ids among them (as many as are
returned, and one) can be returned; the others are left out before anything is
compared.  Anchors are all kept.

Defined cases: a row whose label or vector is NULL, or whose vector holds a
NULL, NaN or infinity, takes no part, nor does a NULL id or a vector of another
length than the commonest; an id with several rows counts once, with its least
(label, vector); zero vectors score zero with all; a positive whose score is
negative has an empty window; an anchor without positives, or a positive
without rows in its window, gives no rows; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, require, written
from .topk import fit_pivots, matrix

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = (3, 10), (9, 10)      # the window, as shares of the positive's score
REFERENCES = 16
SAMPLE = 4096
CELL_ROWS = 16384
QUERY_ROWS = 4096
BLOCK = 256                       # rows of an annulus
TURN = 16                         # blocks scored before the best are looked at again
QUERY_TILE = 256
SLACK = 1e-5                      # of the norms' product; stored angles are within 3e-7
EXACT = 2.0**53
NONE = np.iinfo(np.int64).min


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors**2).sum(1))
    return vectors / np.where(norm > 0, norm, 1)[:, None]


def angles(vectors: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angle of each row to each direction; a zero vector has right angles."""
    return np.arccos(np.clip(unit(vectors) @ references.T, -1, 1)).astype(np.float32)


def fit_references(sample: np.ndarray, references: int = REFERENCES) -> np.ndarray:
    centres = unit(fit_pivots(unit(sample), references))
    return centres if len(centres) else np.zeros((1, sample.shape[1]))


def block_bounds(q_angle: np.ndarray, q_norm: np.ndarray, low: np.ndarray, high: np.ndarray,
                 norm_low: np.ndarray, norm_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) score of each query with the rows of each block.

    ``low`` and ``high`` are the blocks' ranges of angles to each direction.
    """
    upper = np.ones((len(q_angle), len(low)))
    lower = -upper
    for j in range(q_angle.shape[1]):
        a = q_angle[:, j, None].astype(np.float64)
        gap = np.maximum(0, np.maximum(low[None, :, j] - a, a - high[None, :, j]))
        np.minimum(upper, np.cos(gap), out=upper)
        near, far = a + low[None, :, j], a + high[None, :, j]
        least = np.where(far <= np.pi, np.cos(far), np.where(near >= np.pi, np.cos(near), -1))
        np.maximum(lower, least, out=lower)
    q = q_norm[:, None]
    slack = SLACK * q * norm_high + SLACK
    most = np.where(upper >= 0, upper * norm_high, upper * norm_low) * q + slack
    least = np.where(lower >= 0, lower * norm_low, lower * norm_high) * q - slack
    return least, most


def row_bounds(q_angle: np.ndarray, q_norm: np.ndarray, angle: np.ndarray,
               norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) score of each query with each row, by cos(a +- b) = cos a cos b -+ sin a sin b."""
    upper = np.ones((len(q_angle), len(angle)), np.float32)
    lower = -upper
    for j in range(q_angle.shape[1]):
        both = np.outer(np.cos(q_angle[:, j]), np.cos(angle[:, j]))
        sines = np.outer(np.sin(q_angle[:, j]), np.sin(angle[:, j]))
        np.minimum(upper, both + sines, out=upper)
        np.maximum(lower, both - sines, out=lower)
    norms = np.outer(q_norm, norm)
    slack = SLACK * norms + SLACK
    return lower * norms - slack, upper * norms + slack


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-valued rows."""
    largest = math.sqrt(((a**2).sum(1)).max(initial=0) * ((b**2).sum(1)).max(initial=0))
    if largest < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_in_windows(query: dict[str, np.ndarray], cell: dict[str, np.ndarray], k: int,
                    same_label: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of a cell for each window of each query, ties to smaller ids.

    ``query`` holds id, label, vec, norm, angle and the windows ``low`` and
    ``high`` (queries x windows, whole numbers; low > high is empty); ``cell``
    holds id, label, vec, norm, angle.  Returns (query index, window, id, score).
    """
    order = np.lexsort((cell["id"], cell["angle"].min(1), cell["angle"].argmin(1)))
    cell = {name: column[order] for name, column in cell.items()}
    starts = np.arange(0, len(order), BLOCK)
    ranges = [f.reduceat(cell[c], starts, axis=0) for c in ("angle", "norm") for f in (np.minimum, np.maximum)]
    found = []
    for at in range(0, len(query["id"]), QUERY_TILE):
        tile = {name: column[at:at + QUERY_TILE] for name, column in query.items()}
        found.append([at, *_search_tile(tile, cell, starts, ranges, k, same_label)])
    empty = [np.zeros(0, np.int64)] * 4
    parts = [[at + who, window, ids, score] for at, who, window, ids, score in found] or [empty]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _search_tile(tile, cell, starts, ranges, k, same_label):
    windows = tile["low"].shape[1]
    filled = tile["low"] <= tile["high"]
    low = np.where(filled, tile["low"], np.iinfo(np.int64).max).min(1)
    high = np.where(filled, tile["high"], NONE).max(1)
    least, most = block_bounds(tile["angle"], tile["norm"], *ranges)
    able = (most >= low[:, None]) & (least <= high[:, None]) & filled.any(1)[:, None]
    worst = np.full((len(low), windows), NONE)            # the k-th best so far
    best = [np.zeros(0, np.int64)] * 4                    # who, window, id, score
    by_most = np.argsort(-np.where(able, most, -np.inf).max(0), kind="stable")
    for turn in range(0, len(starts), TURN):
        blocks = by_most[turn:turn + TURN]
        # every window must still be open to what a block can hold
        need = able[:, blocks] & (most[:, blocks] >= np.where(filled, worst, np.iinfo(np.int64).max).min(1)[:, None])
        who = np.flatnonzero(need.any(1))
        blocks = blocks[need.any(0)]
        if not len(who):
            continue
        rows = np.concatenate([np.arange(starts[b], min(starts[b] + BLOCK, len(cell["id"]))) for b in np.sort(blocks)])
        row_least, row_most = row_bounds(tile["angle"][who], tile["norm"][who], cell["angle"][rows], cell["norm"][rows])
        label = cell["label"][rows][None, :] == tile["label"][who][:, None]
        pair = (row_most >= low[who][:, None]) & (row_least <= high[who][:, None]) & (label == same_label)
        pair &= cell["id"][rows][None, :] != tile["id"][who][:, None]
        use, rows_used = pair.any(1), pair.any(0)
        who, rows, pair = who[use], rows[rows_used], pair[use][:, rows_used]
        if not len(who):
            continue
        score = np.where(pair, inner(tile["vec"][who], cell["vec"][rows]), NONE)
        ids = cell["id"][rows]
        for w in range(windows):
            fits = (score >= np.maximum(tile["low"][who, w], worst[who, w])[:, None]) \
                & (score <= tile["high"][who, w][:, None]) & pair
            held = np.where(fits, score, NONE)
            if held.shape[1] > k:                          # all that tie with the k-th best stay
                held[held < np.partition(held, -k, axis=1)[:, -k, None]] = NONE
            q, c = np.nonzero(held > NONE)
            if not len(q):
                continue
            best = [np.concatenate([old, new]) for old, new in zip(
                best, (who[q], np.full(len(q), w), ids[c], held[q, c]), strict=True)]
        best, rank = _first_k(*best, k)
        full = rank == k - 1
        worst[best[0][full], best[1][full]] = best[3][full]
    return best


def _first_k(who, window, ids, score, k):
    """The rows ranked below k within their (query, window), and their ranks."""
    order = np.lexsort((ids, -score, window, who))
    who, window, ids, score = who[order], window[order], ids[order], score[order]
    if not len(who):
        return [who, window, ids, score], np.zeros(0, np.int64)
    first = np.concatenate(([True], (who[1:] != who[:-1]) | (window[1:] != window[:-1])))
    rank = np.arange(len(who)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    keep = rank < k
    return [x[keep] for x in (who, window, ids, score)], rank[keep]


def _columns(table: pa.Table, names: str, width: int, references: int) -> dict[str, np.ndarray]:
    out = {}
    for name in names.split():
        column = table.column(name)
        if name in ("vec", "angle"):
            out[name] = matrix(column, width if name == "vec" else references)
        elif name in ("low", "high"):
            out[name] = matrix(column, len(column[0]) if len(column) else 1)
        else:
            out[name] = column.to_numpy()
    return out


def _search(queries: DataFrame, index: DataFrame, width: int, references: int, k: int, same_label: bool) -> DataFrame:
    """Blocks of queries meet the parts of the cells they were sent to."""
    def run(block: pa.Table, cell: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 4
        if block.num_rows and cell.num_rows:
            q = _columns(block, "id label vec norm angle low high", width, references)
            c = _columns(cell, "id label vec norm angle", width, references)
            who, window, ids, score = best_in_windows(q, c, k, same_label)
            out = [q["id"][who], window, ids, score]
        return pa.table(dict(zip(("query_id", "w", "id", "score"), (pa.array(x, pa.int64()) for x in out), strict=True)))

    keys = ["cell", "part", "block"]
    found = (queries.groupBy(*keys).cogroup(index.groupBy(*keys))
             .applyInArrow(run, "query_id bigint, w bigint, id bigint, score bigint"))
    order = Window.partitionBy("query_id", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def one_row_an_id(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.min(F.struct("label", "vec", "norm2")).alias("r")).select("id", "r.*")


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding",
         label_col: str = "label", label: Column | None = None, positives: int = POSITIVES,
         negatives: int = NEGATIVES, scale: int = SCALE, references: int = REFERENCES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``; ``label`` an expression over
    ``vectors`` that stands for ``label_col``.
    """
    require(vectors, id_col, vec_col, label_col)
    spark = vectors.sparkSession
    schema = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
              "positive_score bigint, negative_score bigint")
    given = vectors.select(F.col(id_col).cast("long").alias("id"),
                           (F.col(label_col) if label is None else label).cast("long").alias("label"),
                           F.col(vec_col).cast("array<double>").alias("v"))
    rows = _whole(given, scale)
    sizes = rows.groupBy(F.size("vec").alias("w")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("w")).first()
    if common is None or common["w"] == 0:
        return spark.createDataFrame([], schema)
    width = common["w"]
    rows = written(one_row_an_id(rows.filter(F.size("vec") == width)), "negatives-rows")
    sample = (rows.select("id", "vec", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(SAMPLE).toArrow())
    directions = fit_references(matrix(sample.column("vec"), width), references)
    n_directions = len(directions)

    def index_rows(batches):
        for batch in batches:
            vec = matrix(batch.column(2), width)
            angle = angles(vec, directions)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.sqrt(batch.column(3).to_numpy())),
                 pa.FixedSizeListArray.from_arrays(pa.array(angle.ravel()), n_directions).cast(pa.list_(pa.float32())),
                 pa.array(angle.argmin(1).astype(np.int32))], ["id", "label", "vec", "norm", "angle", "cell"])

    kept = max(positives, negatives) + 1
    alike = Window.partitionBy("vec", "label").orderBy("id")
    indexed = written(rows.withColumn("copy", F.row_number().over(alike))
                      .filter((F.col("copy") <= kept)).drop("copy").select("id", "label", "vec", "norm2")
                      .mapInArrow(index_rows, INDEXED), "negatives-index")
    anchors = written(rows.filter(is_anchor).select("id", "label", "vec", "norm2")
                      .mapInArrow(index_rows, INDEXED), "negatives-anchors")

    # positives: a cell is a label; a hot label has many parts
    any_score = F.array(F.lit(int(NONE) + 1)), F.array(F.lit(int(np.iinfo(np.int64).max)))
    counts = written(indexed.groupBy(F.col("label").alias("cell")).agg(F.count("*").alias("rows"))
                     .join(anchors.groupBy(F.col("label").alias("cell")).agg(F.count("*").alias("asked")), "cell"),
                     "negatives-labels")
    found = _search(*_dealt(
        anchors.withColumns({"cell": F.col("label"), "low": any_score[0], "high": any_score[1]}),
        indexed.withColumn("cell", F.col("label")), counts), width, n_directions, positives, True)
    first = written(found.select(F.col("query_id").alias("anchor_id"), (F.col("rank") - 1).alias("p"),
                                 F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                    "negatives-positives")

    # negatives: an anchor goes, with a window for each positive, to the cells whose ranges overlap one
    asked = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("p", "positive_score"))).alias("ps"))
    score = F.col("ps.positive_score")       # at most ``positives`` of them
    asked = asked.select(
        F.col("anchor_id").alias("id"),
        _padded(F.transform(score, lambda s: _ceil_share(s, LOW)), positives, 1).alias("low"),
        _padded(F.transform(score, lambda s: _floor_share(s, HIGH)), positives, 0).alias("high"))
    ranges = indexed.groupBy("cell").agg(
        F.count("*").alias("rows"), F.min("norm").alias("norm_low"), F.max("norm").alias("norm_high"),
        *[f(F.get("angle", F.lit(j))).alias(f"{n}{j}") for j in range(n_directions)
          for n, f in (("low", F.min), ("high", F.max))]).orderBy("cell").collect()      # a row per direction
    cells = np.array([r["cell"] for r in ranges])
    bounds = [np.array([[r[f"{n}{j}"] for j in range(n_directions)] for r in ranges]) for n in ("low", "high")]
    bounds += [np.array([r[n] for r in ranges]) for n in ("norm_low", "norm_high")]

    def send(batches):
        for batch in batches:
            q = _columns(pa.Table.from_batches([batch]), "norm angle low high", width, n_directions)
            least, most = block_bounds(q["angle"], q["norm"], *bounds)
            go = ((most[:, :, None] >= q["low"][:, None, :]) & (least[:, :, None] <= q["high"][:, None, :])
                  & (q["low"] <= q["high"])[:, None, :]).any(2)
            who, cell = np.nonzero(go)
            out = batch.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells[cell].astype(np.int32))],
                                             [*batch.schema.names, "cell"])

    sent = written(anchors.drop("cell").join(asked, "id").mapInArrow(send, SENT), "negatives-sent")
    rows_of = {r["cell"]: r["rows"] for r in ranges}
    counts = spark.createDataFrame(          # a row per direction
        [(r["cell"], rows_of[r["cell"]], r["asked"]) for r in
         sent.groupBy("cell").agg(F.count("*").alias("asked")).collect()], "cell int, rows bigint, asked bigint")
    hard = _search(*_dealt(sent, indexed, counts), width, n_directions, negatives, False)
    return (hard.select(F.col("query_id").alias("anchor_id"), F.col("w").cast("int").alias("p"), "rank",
                        F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(first, ["anchor_id", "p"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                    "positive_score", "negative_score"))


INDEXED = "id bigint, label bigint, vec array<double>, norm double, angle array<float>, cell int"
SENT = ("id bigint, label bigint, vec array<double>, norm double, angle array<float>, "
        "low array<bigint>, high array<bigint>, cell int")


def _whole(given: DataFrame, scale: int) -> DataFrame:
    """(id, label, vec array<double> of whole numbers, norm2) of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = given.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(finite)
    return (rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("vec"))
            .withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x)))


def _floor_share(score: Column, share: tuple[int, int]) -> Column:
    """floor(score * share), exact for whole scores."""
    product, over = score * share[0], F.lit(share[1]).cast("long")
    return F.call_function("div", product - F.pmod(product, over), over)


def _ceil_share(score: Column, share: tuple[int, int]) -> Column:
    return -_floor_share(-score, share)


def _padded(values: Column, n: int, fill: int) -> Column:
    """Windows beyond an anchor's positives are empty."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill).cast("long"), n)), 1, n)


def _dealt(queries: DataFrame, index: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries in blocks, repeated for each part of their cell; rows in parts, for each block sent there.

    ``counts`` has the ``rows`` and the ``asked`` queries of each cell.
    """
    totals = counts.agg(F.sum("rows").alias("rows"), F.sum("asked").alias("asked")).first()
    counts = counts.withColumns({"parts": F.ceil(F.col("rows") / CELL_ROWS),
                                 "blocks": F.ceil(F.col("asked") / QUERY_ROWS)})

    def met(side: DataFrame, by: str) -> DataFrame:
        return join_counted(side, counts, ["cell"], by, totals[by] or 0).drop("rows", "asked")

    def times(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = (met(queries, "asked").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
         .withColumn("part", times("parts")).drop("parts", "blocks"))
    rows = (met(index, "rows").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
            .withColumn("block", times("blocks")).drop("parts", "blocks"))
    return q, rows
