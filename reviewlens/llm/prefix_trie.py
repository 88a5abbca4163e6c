"""Conversation prefix trie, rolled up by centroid decomposition.

Every distinct sequence of the first d turns (role, text) of a conversation is
a node; the conversations that start with it are its members.  A node is named
(smallest member, d).  ``shared_starts`` rebuilds each conversation from the
first turns of another one before that.

Turns are numbered, and prefixes hashed, without a conversation in one task:
rows are range-sorted by (conversation, turn), each sorted partition runs its own
sums, and what a conversation brings into a partition from earlier ones is
added (one row a partition).  A prefix is the sum of 4 x 32 bits of the MD5 of
(position, role, text) over its turns, so equal prefixes have equal sums, and
others with a chance of about 2**-128.  The root is the prefix of no turns.

Chains: the nodes whose smallest member is x form a chain of depths b..e on the
path of x, hung below a node of another chain.  The size of a node's subtree is
then one sum over the path rows of its members.

Rollup (``subtree_totals``), on the forest of parent edges: a component's
centroid is its lowest node that holds over half of the component below
itself.  The total of the centroid's own part is added to the centroid and to
every node on the path from it to the component's top; then the centroid is
taken out, and each part below it and the part above are components again, of
half the size at most.  So a tree of any depth takes about log2(n) rounds.
Components over ``CELL`` nodes are split by Spark jobs, a round a few joins on
(conversation, depth); smaller ones are dealt to tasks by a hash, about ``CELL``
nodes a task, and finished there by the same steps in numpy.

Ends: the ids of the conversations that end at a node are range-sorted and
joined into blocks of text in parallel; a node's blocks are hashed in order as
a stream, as SHA-256 demands, whatever their number.

Skew: a node or conversation that holds over a ``HEAVY``-th of the rows is
joined map-side (``join_counted``), counts and minima are partial aggregates.

Defined cases: turns without conv_id take no part; turns of equal number are
ordered by role and text, repeated rows are turns of their own; NULL roles and
texts are empty; a NULL turn comes first; conversations without turns are
members of the root; further columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, require, written

CELL = 1 << 15            # nodes of a component that one task finishes
END_BLOCK = 4096          # ids of a block of text
WORD = r"[^\x20\x09-\x0D]+"
LANES = [f"s{i}" for i in range(4)]


# --- running sums within conversations ---------------------------------------

def running_sums(rows: DataFrame, key: str, order: list[str], values: list[str], keep: list[str],
                 name: str) -> DataFrame:
    """``key``, ``keep`` and the inclusive running sums of ``values`` within each key, written.

    Rows are range-sorted by (key, order), so a key may lie in many partitions.
    """
    spark = rows.sparkSession
    placed = (rows.select(key, *order, *[c for c in keep + values if c not in order])
              .withColumn("_at", F.monotonically_increasing_id()))     # parts equal rows
    sort = [key, *order, "_at"]
    placed = placed.repartitionByRange(*sort).sortWithinPartitions(*sort).select(key, *keep, *values)
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in (key, *keep)] + [f"{v} bigint" for v in values] + ["part int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        last, carried = None, np.zeros(len(values), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            who = batch.column(0).to_numpy(zero_copy_only=False)
            start = np.concatenate(([0], np.flatnonzero(who[1:] != who[:-1]) + 1))
            group = np.cumsum(np.concatenate(([False], who[1:] != who[:-1])))
            sums = []
            for i in range(len(values)):
                total = np.cumsum(batch.column(1 + len(keep) + i).to_numpy(zero_copy_only=False))
                before = np.concatenate(([0], total))[start]
                sums.append(total - before[group] + np.where(group == 0, carried[i] if who[0] == last else 0, 0))
            last, carried = who[-1], np.array([s[-1] for s in sums], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:1 + len(keep)], *(pa.array(s, pa.int64()) for s in sums),
                 pa.array(np.full(len(who), part, np.int32))], [key, *keep, *values, "part"])

    local = written(placed.mapInArrow(run, schema), name)
    # a row per partition: what its last key has, which later partitions of that key begin with
    ends = local.groupBy("part").agg(F.max(F.struct(key, *values)).alias("e"), F.min(key).alias("first"))
    found, open_key, have = [], None, [0] * len(values)
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        more = [r["e"][v] for v in values]
        if r["first"] == open_key:
            found.append((r["part"], open_key, *have))
        if r["e"][key] == open_key:
            have = [a + b for a, b in zip(have, more, strict=True)]
        else:
            open_key, have = r["e"][key], more
    before = spark.createDataFrame(found, ", ".join(["part int", f"{key} bigint"] + [f"before_{v} bigint" for v in values]))
    out = local.join(F.broadcast(before), ["part", key], "left")
    return out.select(key, *keep, *[(F.col(v) + F.coalesce(f"before_{v}", F.lit(0))).alias(v) for v in values])


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """(conv, pos from 1, digest, words) of every turn."""
    require(conversations, id_col, turn_col, role_col, text_col)
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumns({"digest": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")),
                             "words": F.regexp_count("text", F.lit(WORD)).cast("long"), "pos": F.lit(1).cast("long")})
    return running_sums(rows, "conv", ["turn", "role", "text"], ["pos"], ["digest", "words"], "trie-turns")


def shared_starts(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``head`` (up to ``most``) turns of conversation ``base``
    and go on with their own turns after their first ``head``.

    Both are expressions of ``conv``.  Returns the rebuilt turns (conv, pos, digest, words)
    and the conversations (conv, turns).
    """
    total = turns.count()
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own")).withColumns({"base": base, "head": head})
    first = (turns.filter(F.col("pos") <= most).groupBy(F.col("conv").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("lead")))   # ``most`` of them
    lead = F.slice(F.coalesce("lead", F.expr("cast(array() as array<struct<pos:bigint,digest:string,words:bigint>>)")),
                   F.lit(1), F.col("head"))
    convs = written(sizes.join(first, "base", "left").withColumn("lead", lead)
                    .withColumn("led", F.size("lead").cast("long")), "trie-conversations")
    led = convs.select("conv", F.explode("lead").alias("t")).select("conv", "t.pos", "t.digest", "t.words")
    own = (join_counted(turns, convs.select("conv", "own", "head", "led"), ["conv"], "own", total)
           .filter(F.col("pos") > F.col("head"))
           .select("conv", (F.col("pos") - F.col("head") + F.col("led")).alias("pos"), "digest", "words"))
    after = F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("head"))
    return led.unionByName(own), convs.select("conv", (F.col("led") + after).alias("turns"))


# --- the trie ----------------------------------------------------------------

def path_rows(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, owner, turns) for every conversation and each of its prefixes, and
    the nodes (owner, depth, n_convs, words)."""
    mixed = F.md5(F.concat_ws(":", F.col("pos").cast("string"), "digest"))
    lanes = [F.conv(F.substring(mixed, 8 * i + 1, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(LANES)]
    sums = running_sums(turns.select("conv", "pos", "words", *lanes), "conv", ["pos"], LANES, ["pos", "words"],
                        "trie-prefixes")
    root = convs.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("words"),
                        *[F.lit(0).cast("long").alias(s) for s in LANES])
    rows = written(sums.unionByName(root).select(
        "conv", F.col("pos").alias("depth"), "words",
        F.md5(F.concat_ws(",", "pos", *LANES)).alias("prefix")), "trie-paths")
    nodes = written(rows.groupBy("prefix").agg(
        F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"),
        F.first("words").alias("words")), "trie-nodes")
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    named = join_counted(rows.select("conv", "depth", "prefix"), nodes.select("prefix", "owner", "n_convs"),
                         ["prefix"], "n_convs", total).select("conv", "depth", "owner")
    return written(named, "trie-owners"), nodes.select("owner", "depth", "n_convs", "words")


def tree(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv, depth, parent, n_convs, n_children, words, size) of every node; ``parent`` is its parent's conv,
    ``size`` the nodes of its subtree; ``first`` the depth at which its chain begins."""
    own = F.col("conv") == F.col("owner")
    chains = written(paths.groupBy("conv").agg(
        F.min(F.when(own, F.col("depth"))).alias("first"), F.max("depth").alias("last"),
        F.max(F.when(~own, F.struct("depth", "owner")))["owner"].alias("hung"),
        F.count("*").alias("rows")).filter("first IS NOT NULL"), "trie-chains")
    total = chains.agg(F.sum("rows")).first()[0] or 0
    full = join_counted(paths, chains, ["conv"], "rows", total)
    # what a conversation's chain holds at a depth or below it
    below = F.col("last") - F.greatest("depth", "first") + 1
    sizes = full.groupBy(F.col("owner").alias("conv"), "depth").agg(F.sum(below).alias("size"))
    hung = (chains.filter("first > 0").groupBy(F.col("hung").alias("conv"), (F.col("first") - 1).alias("depth"))
            .agg(F.count("*").alias("hung_here")))
    return written(
        full.filter(own).select("conv", "depth", "first", "last", "hung")
        .join(nodes.withColumnRenamed("owner", "conv"), ["conv", "depth"])
        .join(sizes, ["conv", "depth"]).join(hung, ["conv", "depth"], "left")
        .select("conv", "depth", "first", "n_convs", "words", "size",
                F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("hung")).alias("parent"),
                (F.coalesce("hung_here", F.lit(0)) + (F.col("depth") < F.col("last")).cast("long")).alias("n_children")),
        "trie-tree")


# --- centroid decomposition ----------------------------------------------------

def finish_components(top: np.ndarray, parent: np.ndarray, depth: np.ndarray, size: np.ndarray,
                      weights: np.ndarray) -> np.ndarray:
    """Subtree totals of a forest by centroid decomposition.

    ``top`` is the index of each node's component top, ``parent`` the index of its parent
    within the component (-1 at tops), ``size`` the nodes of its subtree there,
    ``weights`` a row per node.  Returns a row of totals per node.
    """
    n = len(top)
    place = _preorder(parent, depth, size)
    whole = size.copy()                                     # subtree intervals: place .. place + whole
    size, top, alive = size.copy(), top.copy(), np.ones(n, bool)
    totals = np.zeros_like(weights)
    while alive.any():
        live = np.flatnonzero(alive)
        over = live[2 * size[live] > size[top[live]]]       # a path from each top downwards
        order = over[np.lexsort((-size[over], top[over]))]
        last = np.append(top[order][1:] != top[order][:-1], True)
        centroid = np.full(n, -1)
        centroid[top[order[last]]] = order[last]
        c = centroid[top[live]]
        below = (place[live] >= place[c]) & (place[live] < place[c] + whole[c])
        above = (place[c] > place[live]) & (place[c] < place[live] + whole[live])
        part = np.zeros((n, weights.shape[1]), weights.dtype)
        np.add.at(part, c[below], weights[live[below]])
        # the centroid and its path to the top take the total of the centroid's part
        takes = above | (live == c)
        totals[live[takes]] += part[c[takes]]
        size[live[above]] -= size[c[above]]
        cut = np.zeros(n, bool)
        cut[c] = True
        alive[c] = False
        children = live[(parent[live] >= 0) & cut[parent[live]] & ~cut[live]]
        # of the centroid's children, the last that is placed before a node is above it
        children = children[np.argsort(top[children] * n + place[children])]
        inside = live[below & (live != c)]
        if len(inside):
            at = np.searchsorted(top[children] * n + place[children], top[inside] * n + place[inside], side="right")
            top[inside] = children[at - 1]
    return totals


def _preorder(parent: np.ndarray, depth: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places such that a subtree is an interval of ``size`` places that begins at its root."""
    order = np.lexsort((parent, depth))
    by_parent = parent[order]
    first = np.concatenate(([True], (by_parent[1:] != by_parent[:-1]) | (depth[order][1:] != depth[order][:-1])))
    before = np.cumsum(size[order]) - size[order]
    before -= before[np.flatnonzero(first)][np.cumsum(first) - 1]       # within siblings
    place = np.zeros(len(parent), np.int64)
    tops = parent[order] < 0
    roots = order[tops]
    place[roots] = np.cumsum(size[roots]) - size[roots]
    rest, offset = order[~tops], before[~tops]
    for level in np.split(np.arange(len(rest)), np.flatnonzero(np.diff(depth[rest])) + 1) if len(rest) else []:
        nodes = rest[level]
        place[nodes] = place[parent[nodes]] + 1 + offset[level]
    return place


def _finish(values: list[str]):
    def run(table: pa.Table) -> pa.Table:
        held = {c: table.column(c).to_numpy(zero_copy_only=False) for c in
                ("conv", "depth", "parent", "size", "top_conv", "top_depth", *values, *(f"sum_{v}" for v in values))}
        names, code = np.unique(held["conv"], return_inverse=True)
        span = int(held["depth"].max()) + 2 if len(code) else 1
        key = code * span + held["depth"]
        order = np.argsort(key)

        def index(conv: np.ndarray, depth: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(names, conv), max(0, len(names) - 1))
            want = at * span + depth
            found = order[np.minimum(np.searchsorted(key[order], want), len(order) - 1)]
            return np.where((names[at] == conv) & (key[found] == want), found, -1)
        top = index(held["top_conv"], held["top_depth"])
        is_top = (held["conv"] == held["top_conv"]) & (held["depth"] == held["top_depth"])
        parent = np.where(is_top, -1, index(np.where(is_top, 0, held["parent"]).astype(np.int64), held["depth"] - 1))
        totals = finish_components(top, parent, held["depth"], held["size"], np.stack([held[v] for v in values], 1))
        return pa.table({"conv": held["conv"], "depth": held["depth"],
                         **{f"sum_{v}": held[f"sum_{v}"] + totals[:, i] for i, v in enumerate(values)}})
    return run


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: list[str], cell: int | None = None) -> DataFrame:
    """(conv, depth, sum_<value>...): the sums of ``values`` over each node's subtree.

    ``nodes`` has conv, depth, parent, size and the values; ``paths`` has (conv, depth,
    owner): the node of depth ``depth`` on the path of conversation ``conv``.
    """
    cell = cell or CELL
    comp, node = ["top_conv", "top_depth"], ["conv", "depth"]
    sums = [f"sum_{v}" for v in values]
    state = nodes.select(*node, "parent", "size", *[F.col(v).cast("long").alias(v) for v in values])
    roots = state.filter("parent IS NULL").select(
        F.col("conv").alias("top_conv"), F.col("depth").alias("top_depth"), F.col("size").alias("total"))
    first = roots.first()                                     # a trie has one root
    if first is None:
        return nodes.select(*node, *[F.lit(0).cast("long").alias(s) for s in sums])
    state = state.withColumns({**{k: F.lit(first[k]).cast("long") for k in ("top_conv", "top_depth", "total")},
                               **{s: F.lit(0).cast("long") for s in sums}})
    if first["total"] > cell:
        state = written(state, "trie-state")                  # joins on the component, no constants
    small, done = [], []
    while True:
        small.append(state.filter(F.col("total") <= cell))
        big = state.filter(F.col("total") > cell)
        count = big.count()
        if not count:
            break
        # a row per component of over ``cell`` nodes
        cuts = written(big.filter("2 * size > total").groupBy(*comp)
                       .agg(F.min(F.struct("size", "conv", "depth")).alias("c"))
                       .select(*comp, F.col("c.conv").alias("cut_conv"), F.col("c.depth").alias("cut_depth"),
                               F.col("c.size").alias("cut_size")), "trie-centroids")
        many = big.groupBy(*comp).agg(F.count("*").alias("nodes"))
        cuts = written(cuts.join(many, comp), "trie-cuts")
        # per chain: which node of the centroid's depth, and which below it, is on its path
        chains = big.groupBy(*comp, "conv").agg(F.count("*").alias("chain_nodes"))
        n_chains = chains.groupBy(*comp).agg(F.count("*").alias("n_chains"))
        held = cuts.join(n_chains, comp)
        chains = join_counted(chains, held, comp, "n_chains", held.agg(F.sum("n_chains")).first()[0])
        at = paths.select("conv", F.col("depth").alias("cut_depth"), F.col("owner").alias("at_cut"))
        under = paths.select("conv", (F.col("depth") - 1).alias("cut_depth"), F.col("owner").alias("under_cut"))
        part = big.select(F.col("conv").alias("under_cut"), (F.col("depth") - 1).alias("cut_depth"),
                          F.col("size").alias("under_size"))
        chains = written(chains.join(at, ["conv", "cut_depth"], "left").join(under, ["conv", "cut_depth"], "left")
                         .join(part, ["under_cut", "cut_depth"], "left")
                         .select(*comp, "conv", "chain_nodes", "cut_conv", "cut_depth", "cut_size", "at_cut",
                                 "under_cut", "under_size"), "trie-pieces")
        placed = join_counted(big, chains, [*comp, "conv"], "chain_nodes", count)
        below = (F.col("depth") >= F.col("cut_depth")) & F.coalesce(F.col("at_cut") == F.col("cut_conv"), F.lit(False))
        is_cut = (F.col("conv") == F.col("cut_conv")) & (F.col("depth") == F.col("cut_depth"))
        placed = written(placed.withColumns({"below": below, "is_cut": is_cut}), "trie-placed")
        parts = placed.filter("below").groupBy(*comp).agg(*[F.sum(v).alias(f"part_{v}") for v in values])
        cuts = written(cuts.join(parts, comp), "trie-parts")
        # the centroid's path to its top, met in stretches of ``cell`` depths
        stretches = F.explode(F.sequence(F.floor(F.col("top_depth") / cell), F.floor(F.col("cut_depth") / cell)))
        steps = cuts.select(F.col("cut_conv").alias("walk"), "top_depth", "cut_depth", "cut_size",
                            *[f"part_{v}" for v in values], stretches.alias("stretch"))
        walks = paths.select(F.col("conv").alias("walk"), F.col("depth"), "owner",
                             F.floor(F.col("depth") / cell).alias("stretch"))
        taken = (walks.join(steps, ["walk", "stretch"])
                 .filter((F.col("depth") >= F.col("top_depth")) & (F.col("depth") <= F.col("cut_depth")))
                 .select(F.col("owner").alias("conv"), "depth", F.col("cut_size").alias("less"),
                         *[f"part_{v}" for v in values]))
        moved = placed.join(taken, node, "left").withColumns(
            {s: F.col(s) + F.coalesce(f"part_{v}", F.lit(0)) for s, v in zip(sums, values, strict=True)})
        piece = F.col("below") & ~F.col("is_cut")
        moved = written(moved.select(
            *node, "parent", *values, *sums, "is_cut",
            F.when(piece, F.col("size")).otherwise(F.col("size") - F.coalesce("less", F.lit(0))).alias("size"),
            F.when(piece, F.col("under_cut")).otherwise(F.col("top_conv")).alias("top_conv"),
            F.when(piece, F.col("cut_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            F.when(piece, F.col("under_size")).otherwise(F.col("total") - F.col("cut_size")).alias("total")), "trie-round")
        done.append(moved.filter("is_cut").select(*node, *sums))
        state = moved.filter("NOT is_cut").drop("is_cut")
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    # small components are dealt whole, about ``cell`` nodes a task
    deals = max(1, -(-nodes.count() // cell))
    dealt = rest.withColumn("deal", F.pmod(F.xxhash64(*comp), F.lit(deals)))
    schema = "conv bigint, depth bigint, " + ", ".join(f"{s} bigint" for s in sums)
    out = dealt.groupBy("deal").applyInArrow(_finish(values), schema)
    for more in done:
        out = out.unionByName(more)
    return out


# --- ends ------------------------------------------------------------------------

def ends_hashes(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) from (owner, depth, conv): SHA-256 of the ids, ascending, joined by commas."""
    node, sort = ["owner", "depth"], ["owner", "depth", "conv"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, depth, conv = (c.to_numpy() for c in batch.columns)
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])))[:len(owner)]
            starts = np.flatnonzero(new)
            starts = np.concatenate([np.arange(a, b, END_BLOCK) for a, b in zip(
                starts, np.append(starts[1:], len(owner)), strict=True)] or [starts])
            text = [",".join(map(str, x.tolist())) for x in np.split(conv, starts[1:])] if len(starts) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[starts]), pa.array(depth[starts]), pa.array(conv[starts]), pa.array(text, pa.string())],
                [*sort, "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for owner, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (owner, depth) == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = (owner, depth), hashlib.sha256(ids.encode())
            yield _hash_rows(out)
        yield _hash_rows([(*last, state.hexdigest())] if last is not None else [])

    joined = written(ends.select(*sort).repartitionByRange(*sort).sortWithinPartitions(*sort)
                     .mapInArrow(blocks, "owner bigint, depth bigint, conv bigint, ids string"), "trie-ends")
    return (joined.repartition(*node).sortWithinPartitions(*sort)
            .mapInArrow(hashes, "owner bigint, depth bigint, ends_sha256 string"))


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"owner": pa.int64(), "depth": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())],
                                      list(kinds))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node from turns (conv, pos, digest, words) and conversations (conv, turns)."""
    paths, nodes = path_rows(turns, convs)
    made = tree(paths, nodes)
    weighed = made.withColumns({"leaves": (F.col("n_children") == 0).cast("long"),
                                "saved": (F.col("n_convs") - 1) * F.col("words")})
    totals = written(subtree_totals(weighed, paths, ["leaves", "saved"]), "trie-totals")
    ends = paths.join(convs.select("conv", F.col("turns").alias("depth")), ["conv", "depth"])
    hashes = ends_hashes(ends).withColumnRenamed("owner", "conv")
    none = hashlib.sha256(b"").hexdigest()
    return (made.join(totals, ["conv", "depth"]).join(hashes, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
