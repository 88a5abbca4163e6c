"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word's subwords are the word itself and its character n-grams (3 to 6, with
``<`` and ``>`` at its ends), hashed into buckets that hold an embedding each.
A word is the mean of its subwords.  A window of ``WINDOW`` words is the mean of
its words (a repeated word counts once, and a slot left empty as zero, so that
neither repetition nor a short text magnifies a word), and a softmax layer
scores the window; a text scores as its most toxic window, so a long text does
not thin out an insult.  Embeddings and
softmax are trained jointly in numpy (full-batch Adam), so an unseen
misspelling or inflection gets its score from the n-grams that it shares with
training words.  Labels are per text: at first all windows of a toxic text
count as toxic, then ``ROUNDS - 1`` times those that the model finds toxic, and
at least the worst of each text.  Every ``CALIBRATE``-th text of the sample is
kept out of that and fits the scale and offset of the scores.

Fitting uses a bounded sample of labelled rows (``SAMPLE`` of each class and
``SAMPLE_CHARS`` characters of each, the smallest by a hash of the id) in one
task, which hands back one number a bucket; the driver holds no text.  Scoring reads every whole text of
every row in tasks: since the layer is linear, a distinct word of a batch is
reduced to one number once.  Every subword of the sample is trained; one seen in
few windows weighs less by its count (``RARE``), so that noise stays small.

Defined cases: a NULL text counts as empty; a text without words scores the
share of toxic rows among the labelled; labels other than 0 and 1 and labels of
unknown documents are ignored, a document labelled both ways counts as toxic;
an id that stands for several texts is learned from its least one; a text over
``SAMPLE_CHARS`` is scored, but not learned from;
without labelled rows of both classes every score is 0; repeated rows score
alike; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import text_batches
from .common import require, text_or_empty

SAMPLE = 1200         # labelled rows of each class that are fitted, at most
SAMPLE_CHARS = 1 << 22  # characters of each class that are fitted, at most
CALIBRATE = 4         # every fourth of them sets the scale of the scores instead
WINDOW = 8            # words
BUCKETS = 1 << 18
DIM = 4
GRAMS = (3, 6)
ROUNDS = 3            # of labelling windows and training
STEPS = 22            # of each round
RATE = 0.1
DECAY = 1e-6
LONE = 0.2            # weight of a word of the clean texts as a window by itself
# A subword of n training windows weighs n / (n + RARE) of a frequent one.  Chosen by the
# loss on the calibration rows of training samples (README); held-out rows have no part in it.
RARE = 30
THRESHOLD = 0.3
HELD_OUT = 2          # crc32(id) mod 4 of the rows that are never learned from
SEED = 11


@functools.lru_cache(maxsize=1 << 16)
def _bare(token: str) -> str:
    """A lower-cased token without the characters at its ends that are no letters or digits."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


def word_table(texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of each word of all texts, number of words of each text)."""
    tokens: list[str] = []
    held = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = text.lower().split()
        counts[i] = len(found)
        tokens += found
        if len(tokens) > 100_000:               # Arrow holds them in a tenth of the memory
            held.append(pa.array(tokens, pa.large_string()))
            tokens = []
    held.append(pa.array(tokens, pa.large_string()))
    del tokens
    if not counts.sum():
        return [], np.zeros(0, np.int64), counts
    coded = pa.chunked_array(held).dictionary_encode().unify_dictionaries().combine_chunks()
    del held
    bare = pa.array([_bare(t) for t in coded.dictionary.to_pylist()], pa.large_string()).dictionary_encode()
    which = bare.indices.to_numpy()[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    words = bare.dictionary.to_pylist()
    if "" in words:                                   # tokens without letters are no words
        real = which != words.index("")
        counts = np.bincount(np.repeat(np.arange(len(texts)), counts)[real], minlength=len(texts))
        which = which[real]
    return words, which, counts


def subwords(words: Sequence[str], chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all subwords, number of subwords of each word), word by word."""
    parts = [_subwords(words[at:at + chunk]) for at in range(0, len(words), chunk)] or [_subwords([])]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _subwords(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"<{w}>" for w in words]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    # a lone surrogate cannot be in a Spark string, so every character is one code point
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(length), length)
    owner = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(chars))
    mix, spread = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())
    owners = [np.arange(len(words))]
    buckets = [np.fromiter((xxhash.xxh64_intdigest(w, SEED) % BUCKETS for w in words), np.int64, len(words))]
    rolled = np.zeros(len(chars), np.uint64)
    for n in range(1, GRAMS[1] + 1):
        inside = at + n <= ends
        ahead = np.where(inside, at + n - 1, 0)
        rolled = rolled * mix + chars[ahead] + np.uint64(n)
        if n >= GRAMS[0]:
            owners.append(owner[inside])
            buckets.append(((rolled[inside] * spread) >> shift).astype(np.int64))
    who, what = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(who, kind="stable")
    return what[order].astype(np.int32), np.bincount(who, minlength=len(words))


def _segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of rows; a group may be empty."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return out


def _windows(counts: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(words of each window, windows of each text): about equal windows of up to ``size`` words."""
    per_text = -(-counts // size)
    text = np.repeat(np.arange(len(counts)), per_text)
    place = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    n, k = counts[text], per_text[text]
    return (place + 1) * n // k - place * n // k, per_text


def _first_in_window(which: np.ndarray, in_window: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Whether each word is the first of its kind in its window."""
    first = np.ones(len(which), bool)
    place = np.arange(len(which)) - np.repeat(np.cumsum(in_window) - in_window, in_window)
    for back in range(1, size):
        first[back:] &= (which[back:] != which[:-back]) | (place[back:] < back)
    return first


def _gathered_sums(table: np.ndarray, index: np.ndarray, weight: np.ndarray | float, counts: np.ndarray,
                   chunk: int = 1 << 18) -> np.ndarray:
    """Sums of ``table[index] * weight`` over consecutive groups of ``counts`` entries, in slices."""
    out = np.zeros((len(counts), table.shape[1]), table.dtype)
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        start = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, start + chunk, side="right")))
        part = slice(start, int(ends[to - 1]))
        scale = weight if np.isscalar(weight) else weight[part]
        out[at:to] = _segment_sums(table[index[part]] * scale, counts[at:to])
        at = to
    return out


@dataclass
class ToxicityModel:
    slope: np.ndarray        # per bucket: embedding times (toxic minus clean) layer
    intercept: float
    prior: float             # score of a text without words
    fitted: bool = True

    def logits(self, texts: Sequence[str]) -> np.ndarray:
        """Of each text's worst window; NaN for a text without words."""
        words, which, counts = word_table(texts)
        out = np.full(len(texts), np.nan)
        if not len(which):
            return out
        what, n = subwords(words)
        per_word = _segment_sums(self.slope[what].astype(np.float64), n) / n
        in_window, per_text = _windows(counts)
        parts = per_word[which] * _first_in_window(which, in_window)
        logit = _segment_sums(parts, in_window) / WINDOW + self.intercept
        full = counts > 0
        out[full] = np.maximum.reduceat(logit, (np.cumsum(per_text) - per_text)[full])
        return out

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(texts))
        logit = self.logits(texts)
        return np.where(np.isnan(logit), self.prior, 1 / (1 + np.exp(-np.clip(logit, -500, 500))))

    def calibrated(self, texts: Sequence[str], toxic: np.ndarray, weight: np.ndarray) -> ToxicityModel:
        """The same order of texts, with scores that are probabilities on these texts."""
        logit = self.logits(texts)
        seen = ~np.isnan(logit)
        x, y, w = logit[seen], toxic[seen], weight[seen]
        if not len(y) or y.min() == y.max():
            return self
        scale = np.abs(x).mean() + 1e-9
        design = np.stack([x / scale, np.ones_like(x)], 1)
        beta = np.zeros(2)
        for _ in range(50):                                    # Newton steps, lightly regularised
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            grad = design.T @ (w * (p - y)) + 0.05 * beta
            beta -= np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2), grad)
        a, b = max(beta[0], 1e-3) / scale, beta[1]
        return ToxicityModel(self.slope * np.float32(a), a * self.intercept + b, self.prior)


class _Trainer:
    """Adam steps on the embeddings and the softmax layer over windows."""

    def __init__(self, words: Sequence[str], window: np.ndarray, word: np.ndarray, windows: int):
        """``word[i]`` is in ``window[i]``, a pair at most once, in the order of the windows."""
        self.window, self.word = window, word
        what, n = subwords(words)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), n)
        windows_of = np.bincount(self.word, minlength=len(words)).astype(np.float32)
        held = np.bincount(what, weights=windows_of[owner], minlength=BUCKETS)
        self.used = np.flatnonzero(np.bincount(what, minlength=BUCKETS))
        self.trust = (held[self.used] / (held[self.used] + RARE)).astype(np.float32)[:, None]
        del held
        place = np.zeros(BUCKETS, np.int32)
        place[self.used] = np.arange(len(self.used))
        self.what = what = place[what]
        weight = (1 / n).astype(np.float32)
        self.weight = weight[owner][:, None]
        order = np.argsort(what, kind="stable").astype(np.int32)
        self.back_owner = owner[order]
        self.back_weight = weight[self.back_owner][:, None]
        del order
        self.per_bucket = np.bincount(what, minlength=len(self.used))
        self.per_word = np.bincount(owner, minlength=len(words))
        order = np.argsort(self.word, kind="stable")
        self.back_window = self.window[order]
        self.windows_of_word = np.bincount(self.word, minlength=len(words))
        self.words_of_window = np.bincount(self.window, minlength=windows)
        rng = np.random.default_rng(SEED)
        self.emb = (0.01 * rng.uniform(-1, 1, (len(self.used), DIM))).astype(np.float32)
        self.layer = (4 * WINDOW * rng.uniform(-1, 1, (DIM, 2))).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.emb, self.layer, self.bias)]
        self.steps = 0

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        word_vec = _gathered_sums(self.emb * self.trust, self.what, self.weight, self.per_word)
        vec = _gathered_sums(word_vec, self.word, np.float32(1 / WINDOW), self.words_of_window)
        logit = vec @ self.layer + self.bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        return vec, p / p.sum(1, keepdims=True)

    def step(self, toxic: np.ndarray, weight: np.ndarray) -> None:
        self.steps += 1
        vec, p = self.forward()
        d = (p - np.stack([1 - toxic, toxic], 1)) * (weight / weight.sum())[:, None]
        d_vec = d @ self.layer.T / WINDOW
        d_word = _gathered_sums(d_vec.astype(np.float32), self.back_window, np.float32(1), self.windows_of_word)
        d_emb = _gathered_sums(d_word, self.back_owner, self.back_weight, self.per_bucket) * self.trust
        grads = (d_emb + DECAY * self.emb,
                 vec.T @ d + DECAY * self.layer, d.sum(0))
        for value, grad, (m, v) in zip((self.emb, self.layer, self.bias), grads, self.moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def _spread(y: np.ndarray) -> np.ndarray:
    """Marks every ``CALIBRATE``-th row of each class."""
    out = np.zeros(len(y), bool)
    for c in (0, 1):
        out[np.flatnonzero(y == c)[CALIBRATE - 1::CALIBRATE]] = True
    return out


def fit(texts: Sequence[str], toxic: Sequence[int], prior: float) -> ToxicityModel:
    """Train on texts of both classes; ``prior`` is the toxic share of all labelled rows."""
    y = np.asarray(toxic, np.float32)
    words, which, counts = word_table(texts)
    seen = y[counts > 0]
    if not len(seen) or seen.min() == seen.max():
        return ToxicityModel(np.zeros(1), 0.0, 0.0, fitted=False)
    # texts count as if the classes had the ratio of all labelled rows
    ratio = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean())).astype(np.float32)
    aside = _spread(y)
    size, per_text = _windows(counts)
    text, first = np.repeat(np.arange(len(y)), per_text), _first_in_window(which, size)
    # each word of the clean texts is a clean window by itself, too: text may repeat it alone
    lone = np.unique(which[np.repeat((y == 0) & ~aside, counts)])
    window = np.concatenate([np.repeat(np.arange(len(size)), size)[first], len(size) + np.arange(len(lone))])
    trainer = _Trainer(words, window, np.concatenate([which[first], lone]), len(size) + len(lone))
    start, full = (np.cumsum(per_text) - per_text)[counts > 0], counts > 0
    label, use = y[text], np.where(aside[text], 0, ratio[text])
    for turn in range(ROUNDS):
        if turn:
            p = trainer.forward()[1][:len(size), 1]
            worst = np.zeros(len(y), np.float32)
            worst[full] = np.maximum.reduceat(p, start)
            label = ((y[text] > 0) & ((p >= 0.5) | (p >= worst[text]))).astype(np.float32)
            # other windows of toxic texts: unknown
            use = np.where(~aside[text] & ((label > 0) | (y[text] == 0)), ratio[text], 0)
        for _ in range(STEPS):
            trainer.step(np.append(label, np.zeros(len(lone))).astype(np.float32),
                         np.append(use, np.full(len(lone), LONE * ratio[y == 0][0])).astype(np.float32))
    slope = np.zeros(BUCKETS, np.float32)
    slope[trainer.used] = (trainer.emb * trainer.trust) @ (trainer.layer[:, 1] - trainer.layer[:, 0])
    model = ToxicityModel(slope, float(trainer.bias[1] - trainer.bias[0]), prior)
    return model.calibrated([t for t, a in zip(texts, aside, strict=True) if a], y[aside], ratio[aside])


def is_held_out(id_col: str | Column) -> Column:
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 4 == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` labelled rows of each class, held-out ids left out."""
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    marks = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(id_col))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")))
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return fit([], [], 0.0)
    prior = sizes[1] / (sizes[0] + sizes[1])
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    by_hash = Window.partitionBy("y").orderBy("h", "id")
    hashed = marks.withColumn("h", F.xxhash64("id"))
    ids = [hashed.filter(F.col("y") == y).orderBy("h", "id").limit(sample) for y in (0, 1)]
    ids = ids[0].unionByName(ids[1])
    # 2 * sample rows at most, and so many characters
    picked = (rows.filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(ids), "id")
              .groupBy("id", "y", "h").agg(F.min("text").alias("text"))
              .withColumn("so_far", F.sum(F.length("text")).over(by_hash)).filter(F.col("so_far") <= SAMPLE_CHARS))

    def fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
        model = fit(texts, toxic, prior)
        yield pa.RecordBatch.from_pydict({"slope": pa.array([model.slope.astype("<f4").tobytes()], pa.binary()),
                                          "intercept": [float(model.intercept)], "fitted": [model.fitted]})

    fitted = (picked.select("text", "y", "h", "id").repartition(1).sortWithinPartitions("y", "h", "id")
              .select("text", "y").mapInArrow(fit_rows, "slope binary, intercept double, fitted boolean").first())
    if fitted is None or not fitted["fitted"]:
        return fit([], [], 0.0)
    return ToxicityModel(np.frombuffer(fitted["slope"], "<f4"), fitted["intercept"], prior)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)      # one number a bucket: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_batches(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(shared.value.scores(texts))],
                    ["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(id_col), is_held_out("id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = train(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd
        out = [shared.value.scores(part) < THRESHOLD for _, part in text_batches(pa.array(texts))]
        return pd.Series(np.concatenate(out) if out else [], dtype=bool)

    return docs.filter(clean(text_or_empty(text_col)))
