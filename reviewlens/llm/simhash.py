"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprint: the text's ASCII letters are lower-cased, words are runs of other
characters than ASCII white space, shingles are ``words`` consecutive words
joined by one space (repeats count; a text of fewer words is one shingle; a
text without words has fingerprint 0).  A bit is 1 if it is set in over half
of the shingles' XXH64 hashes (seed 42).

Links: two fingerprints at most ``2 * half`` bits apart share a variant, a
value at most ``half`` bits from both.  Every distinct fingerprint emits all
its variants, variants are shuffled, and equal ones meet.  A variant is
shuffled in compact form: its bucket is a linear code over its bits
(``syndrome``) whose bits are parities, so the variants of a fingerprint fall
into few buckets (37 of 256, 137 of 65,536); a bucket is sent the fingerprint
once and regenerates those variants of it that belong there.  The buckets grow
with the count, and one that is still sent too many is split by more bits of
the code, so that no group holds the fingerprints of the corpus.  Within a bucket all fingerprints that share a variant are pairwise linked (each is
within ``half`` of it), so a star from the smallest loses no link; the pairs
of the star are deduplicated and verified by their bit distance.

Components: large-star/small-star rounds over the links, each round written to
the shared folder.  The smallest id of a component names it.

Skew: equal fingerprints are one row before variants are emitted; hub nodes of
a component are met by partial minima and by joins that AQE may split.

Defined cases: a NULL text counts as empty; empty texts have fingerprint 0 and
link like any other; rows with a NULL id get a component like all rows, and
its name is NULL only if all its ids are; repeated rows share a component;
further columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, text_digest, text_or_empty, without, written

BITS = 64
SEED = 42
WORDS = 4                     # shingle length of the contract
HALF = 2                      # half of the largest distance, 4 bits
MIN_PARTS = 8                 # of the link table of a round
MIN_BUCKET_BITS = 8           # 256 buckets at least
MAX_BUCKET_BITS = 30
BUCKET_FINGERPRINTS = 1 << 18  # fingerprints sent to a bucket on average, at most (2 MB)
SPLIT_OVER = 4                 # a bucket that is sent so many times that is split
CHUNK_VARIANTS = 1 << 21      # variants held at once by a task (16 MB an array)
BLOCK = 8192                  # fingerprints of a shuffled block
SLICE = 1 << 16               # characters of a text that are hashed at once
EDGES_A_PART = 1 << 18        # of the link table of a round

# bit k of a byte value, least significant first
_BLANKS = [bytes([c]) for c in b" \t\n\x0b\x0c\r"]
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _tokens(text: str) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice."""
    held: list[bytes] = []                         # of a word that goes on
    for at in range(0, len(text), SLICE):
        part = text[at:at + SLICE].encode("utf-8").lower()
        cut = len(part) if at + SLICE >= len(text) else max(part.rfind(c) for c in _BLANKS) + 1
        if cut:
            yield b"".join([*held, part[:cut]]).split()
            held = []
        held.append(part[cut:])


def fingerprint(text: str, words: int = WORDS) -> int:
    digest, seed = xxhash.xxh64_intdigest, SEED
    ones, n, first = np.zeros(BITS, np.int64), 0, []
    for tokens in _tokens(text):
        tokens = first + tokens
        if len(tokens) < words:
            first = tokens
            continue
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[:len(tokens) - words + 1].tolist(), ends[words - 1:].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        n += len(hashes)
        at = hashes.astype("<u8", copy=False).view(np.uint8).reshape(len(hashes), 8) + np.arange(0, 2048, 256)
        counts = np.bincount(at.ravel(), minlength=2048).reshape(8, 256)
        ones += (counts @ _BYTE_BITS).ravel()          # 64 counts, lowest bit first
        first = tokens[len(tokens) - words + 1:]
    if not n:
        return digest(b" ".join(first), seed) if first else 0
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = WORDS, with_digest: bool = False) -> DataFrame:
    """(id, fp[, digest]): the fingerprint as a signed long, and the text's SHA-256."""
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"),
                       *[text_digest(text_col).alias("digest")] * with_digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]],
                                             ["id", "fp", *batch.schema.names[2:]])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp bigint" + ", digest binary" * with_digest)


# --- variants ---------------------------------------------------------------

@functools.cache
def _masks(half: int) -> np.ndarray:
    """All XOR masks of at most ``half`` bits."""
    out = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(BITS), k)]
    return np.array(out, np.uint64)


@functools.cache
def _code(bucket_bits: int, more: int) -> np.ndarray:
    """A column for each of the 64 bits.

    Bucket bit ``j`` is the parity of the bits ``j``, ``j + bucket_bits``, ..., so
    two flipped bits change at most two bucket bits; ``more`` lower bits are mixed.
    """
    return np.array([(1 << (i % bucket_bits + more)) | (xxhash.xxh64_intdigest(b"column%d" % i, SEED) >> BITS - more)
                     for i in range(BITS)], np.uint64)


def syndrome(values: np.ndarray, bucket_bits: int, more: int = 0) -> np.ndarray:
    """The linear code of each value: syndrome(a ^ b) == syndrome(a) ^ syndrome(b).

    Without its lower ``more`` bits it is the code of ``bucket_bits`` bits.
    """
    out = np.zeros(len(values), np.uint64)
    for i, column in enumerate(_code(bucket_bits, more)):
        out ^= ((values >> np.uint64(i)) & np.uint64(1)) * column
    return out.astype(np.int64)


def bucket_bits_for(count: int, half: int = HALF) -> int:
    """So many bits that an even share of the fingerprints sent to all buckets is small enough."""
    bits = MIN_BUCKET_BITS
    while bits < MAX_BUCKET_BITS and \
            count * sum(math.comb(bits, k) for k in range(half + 1)) > BUCKET_FINGERPRINTS << bits:
        bits += 1
    return bits


def _find(parent: dict[int, int], x: int) -> int:
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while (up := parent.get(x, x)) != root:
        parent[x], x = root, up
    return root


def _distance_ok(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


@functools.cache
def _masks_of_bucket(bucket_bits: int, half: int) -> int:
    """The most variants of one fingerprint that fall into one bucket."""
    return int(np.unique(syndrome(_masks(half), bucket_bits), return_counts=True)[1].max())


@functools.lru_cache(maxsize=64)
def _coded_masks(bucket_bits: int, more: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks in the order of their codes, and the codes."""
    code = syndrome(_masks(half), bucket_bits, more)
    order = np.argsort(code, kind="stable")
    return _masks(half)[order], code[order]


def links_in_bucket(fps: np.ndarray, bucket: int, bucket_bits: int, half: int, split: int = 0) -> np.ndarray:
    """Verified links (a < b) that connect all fingerprints sharing a variant of this bucket.

    A bucket of a split one has the ``split`` more bits of its code behind its own.  The variants are regenerated in ``parts`` slices by more bits of a code, so
    memory stays bounded however many fingerprints the bucket was sent.
    """
    fps = np.unique(fps)
    masks = _masks(half)
    slices = max(0, math.ceil(math.log2(max(1, len(fps) * len(masks) / 2**(bucket_bits + split) / CHUNK_VARIANTS))))
    # a fingerprint's variants of one bucket are at most so many
    slices = max(slices, math.ceil(math.log2(max(1, len(fps) * _masks_of_bucket(bucket_bits, half) / 2**split
                                                 / CHUNK_VARIANTS))))
    masks, of_mask = _coded_masks(bucket_bits, split + slices, half)
    of_fp = syndrome(fps, bucket_bits, split + slices)
    parent: dict[int, int] = {}
    links = []
    for part in range(1 << slices):
        want = of_fp ^ ((bucket << slices) | part)
        lo, hi = np.searchsorted(of_mask, want), np.searchsorted(of_mask, want, side="right")
        n = hi - lo
        owner = np.repeat(np.arange(len(fps)), n)
        pick = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        variant = fps[owner] ^ masks[pick]
        ranked = np.sort(variant)
        met = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if not len(met):
            continue
        at = np.minimum(np.searchsorted(met, variant), len(met) - 1)
        shared = met[at] == variant
        at, owner = at[shared], owner[shared]
        order = np.lexsort((owner, at))
        at, owner = at[order], owner[order]
        first = np.concatenate(([True], at[1:] != at[:-1]))
        head = owner[np.flatnonzero(first)[np.cumsum(first) - 1]]
        star = np.unique(np.stack([head, owner], 1)[~first], axis=0)
        a, b = fps[star[:, 0]], fps[star[:, 1]]
        good = _distance_ok(a, b, 2 * half)
        for x, y in zip(a[good].tolist(), b[good].tolist(), strict=True):
            rx, ry = _find(parent, x), _find(parent, y)
            if rx != ry:                       # a spanning forest keeps the components
                parent[max(rx, ry)] = min(rx, ry)
                links.append((x, y))
    return np.array(links, np.uint64).reshape(-1, 2)


def links(fps: DataFrame, half: int = HALF) -> DataFrame:
    """Distinct verified links (a, b) over the distinct fingerprints in column ``fp``.

    The links connect exactly the fingerprints that the ``2 * half`` bit rule
    connects; a pair already connected within a bucket may be left out.
    """
    bits = bucket_bits_for(fps.count())
    masks = _masks(half)
    of_mask = syndrome(masks, bits)
    reach = np.unique(of_mask)
    split = split_buckets(fps, bits, half)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), BLOCK):
                block = np.sort(values[at:at + BLOCK])
                own = syndrome(block, bits)
                bucket = (own[:, None] ^ reach).ravel()
                order = np.argsort(bucket, kind="stable")
                bucket, owner = bucket[order], order // len(reach)
                keys, held = [], []
                for who in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                    to, sent = int(bucket[who[0]]), owner[who]
                    more = split.get(to, 0)
                    if not more:
                        keys.append((to, 0))
                        held.append(block[sent].tobytes())
                        continue
                    code, low = syndrome(masks, bits, more), (1 << more) - 1
                    parts = [np.zeros((0, 2), np.int64)]
                    for step in np.unique(own[sent] ^ to):      # the variants that lead here
                        some = sent[own[sent] ^ to == step]
                        part = (syndrome(block[some], bits, more)[:, None] ^ np.unique(code[of_mask == step])) & low
                        parts.append(np.stack([part.ravel(), np.repeat(some, part.shape[1])], 1))
                    pairs = np.unique(np.concatenate(parts), axis=0)
                    for group in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1):
                        keys.append((to, int(group[0, 0])))
                        held.append(block[group[:, 1]].tobytes())
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([k for k, _ in keys], pa.int32()),
                    "part": pa.array([p for _, p in keys], pa.int32()), "fps": pa.array(held, pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        values = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("fps")])
        bucket, part = table.column("bucket")[0].as_py(), table.column("part")[0].as_py()
        more = split.get(bucket, 0)
        found = links_in_bucket(values, bucket << more | part, bits, half, more).view(np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    blocks = fps.select("fp").mapInArrow(emit, "bucket int, part int, fps binary")
    return blocks.groupBy("bucket", "part").applyInArrow(meet, "a bigint, b bigint").distinct()


def split_buckets(fps: DataFrame, bits: int, half: int = HALF) -> dict[int, int]:
    """The buckets that are sent too many fingerprints, each with the bits it is split by.

    A row per bucket and one per bucket that it sends to; few buckets are left.
    """
    steps, variants = np.unique(syndrome(_masks(half), bits), return_counts=True)
    steps = F.array(*(F.struct(F.lit(int(s)).alias("to"), F.lit(int(v)).alias("each"))
                      for s, v in zip(steps, variants, strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own, n = np.unique(syndrome(values, bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n, pa.int64())], ["own", "n"])

    own = fps.select("fp").mapInArrow(count, "own bigint, n bigint").groupBy("own").agg(F.sum("n").alias("n"))
    sent = (own.select(F.explode(steps).alias("step"), "own", "n")
            .groupBy(F.col("own").bitwiseXOR(F.col("step.to")).alias("bucket"))
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("step.each")).alias("variants"))
            .filter(F.col("n") > SPLIT_OVER * BUCKET_FINGERPRINTS))
    return {r["bucket"]: math.ceil(math.log2(r["variants"] / BUCKET_FINGERPRINTS)) for r in sent.collect()}


# --- components -------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with its component's smallest node.

    Alternates large-star and small-star steps until the edge set stays the
    same; each step is a minimum per node (partial aggregation) and a join.
    """
    pairs = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .filter("u <> v").distinct())
    # equal edge sets: the same count and the same sum of hashes
    mark = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    edges = written(pairs, "star-edges")
    seen, now = None, edges.agg(*mark).first()
    while now != seen:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = (linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # no more files than the links fill: each round reads what the last one wrote
        edges = written(small.coalesce(max(MIN_PARTS, -(-now["n"] // EDGES_A_PART))), "star-edges")
        seen, now = now, edges.agg(*mark).first()
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _named(docs: DataFrame, id_col: str, text_col: str, words: int, half: int,
           with_digest: bool = False) -> DataFrame:
    """(fp, id[, digest], component_id), one row per document."""
    rows = written(fingerprints(docs, id_col, text_col, words, with_digest), "simhash-fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    nodes = written(components(links(distinct, half)), "simhash-components")
    rooted = (distinct.join(nodes, distinct["fp"] == nodes["node"], "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    named = (rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
             .select("fp", "component_id"))
    return rows.join(named, "fp")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  words: int = WORDS, half: int = HALF) -> DataFrame:
    """One row per document: id, fingerprint (hex), component_id, kept (its id names the component)."""
    return _named(docs, id_col, text_col, words, half).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     words: int = WORDS, half: int = HALF) -> DataFrame:
    """One document of each component (the smallest id) with all its columns, whatever their names.

    A row is decided by its id and its text, as ids may be NULL or repeated; rows
    that repeat both are all kept or all dropped.
    """
    named = _named(docs, id_col, text_col, words, half, with_digest=True)
    dropped = named.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select("id", "digest")
    return without(docs, dropped, id_col, text_col)
