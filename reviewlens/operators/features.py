"""Text features: MLlib stages for the classifier, DataFrame views for checks.

The classifier's featuriser: lower-cased whitespace tokens, English stop words
removed; word unigrams + bigrams and character trigrams of what is left hashed into count
vectors, L2-normalised, then scaled by the largest absolute value per feature
(keeps sparse vectors sparse, unlike min-max scaling).

The words are found by MLlib's stages; the grams are slices of the joined words, hashed and
counted over Arrow batches (``HashedTerms``), so no gram is ever an object of its own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import (
    MaxAbsScaler, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover,
)
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasNumFeatures, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.ordered import numbered

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TOKEN_PATTERN = r"\s+"
CHAR_GRAM = 3
NUM_FEATURES = 1 << 14
BLOCKS = 3                # of features: words, word pairs, character grams
CHUNK = 1 << 19           # bytes of text hashed at once, or one longer text
LONG = 64                 # four-byte words of a term that are hashed beside those of others
HASH_SEED = 42            # of HashingTF and of SQL's hash


def tokenizer(input_col: str = "text", output_col: str = "words") -> RegexTokenizer:
    return RegexTokenizer(inputCol=input_col, outputCol=output_col, pattern=TOKEN_PATTERN,
                          gaps=True, toLowercase=True, minTokenLength=1)


def stop_words_remover(input_col: str = "words", output_col: str = "clean") -> StopWordsRemover:
    return StopWordsRemover(inputCol=input_col, outputCol=output_col, caseSensitive=False)


def bigrams(input_col: str = "clean", output_col: str = "bigrams") -> NGram:
    return NGram(n=2, inputCol=input_col, outputCol=output_col)


def char_gram_pattern(n: int = CHAR_GRAM) -> str:
    """A zero-width match at every position capturing the next n characters:
    one linear regex pass yields all overlapping n-grams in order."""
    return f"(?s)(?=(.{{{n}}}))"


def char_grams(text: Column, n: int = CHAR_GRAM) -> Column:
    """All length-n substrings of the lower-cased text (empty when shorter)."""
    return F.regexp_extract_all(F.lower(text), F.lit(char_gram_pattern(n)), 1)


def char_gram_stage(input_col: str = "text", output_col: str = "chars",
                    n: int = CHAR_GRAM) -> SQLTransformer:
    stmt = (f"SELECT *, regexp_extract_all(lower(`{input_col}`), '{char_gram_pattern(n)}', 1) "
            f"AS `{output_col}` FROM __THIS__")
    return SQLTransformer(statement=stmt)


def whole_words(term: str) -> str:
    """SQL: a term filled up to a multiple of four bytes.

    There the hash of ``HashingTF`` and SQL's ``hash`` are the same function, so a
    column expression finds a term's feature.
    """
    return f"concat({term}, repeat(char(1), pmod(-octet_length({term}), 4)))"


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: int | None = None) -> np.ndarray:
    """MurmurHash3 (32 bits, signed) of slices of ``data`` filled up as by ``whole_words``; ``first``
    stands for a slice's first byte.  ``data`` goes on for three bytes after its last slice."""
    word_at = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    h = np.full(len(start), HASH_SEED, np.uint32)
    words = (end - start + 3) // 4
    todo = np.arange(len(start))
    k = 0
    while len(todo) and k < LONG:
        at = start[todo] + 4 * k
        w = word_at[at]
        filled = (np.uint64(0xFFFFFFFF) << (8 * np.minimum(4, end[todo] - at)).astype(np.uint64)).astype(np.uint32)
        w = (w & ~filled) | (np.uint32(0x01010101) & filled)
        if first is not None and k == 0:
            w = (w & np.uint32(0xFFFFFF00)) | np.uint32(first)
        w *= np.uint32(0xCC9E2D51)
        w = (w << np.uint32(15)) | (w >> np.uint32(17))
        v = h[todo] ^ (w * np.uint32(0x1B873593))
        h[todo] = ((v << np.uint32(13)) | (v >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        k += 1
        todo = todo[words[todo] > k]
    for i in todo:                        # few are so long: one after the other
        v, rest = int(h[i]), data[start[i] + 4 * k:end[i]].tobytes()
        for w in np.frombuffer(rest + b"\x01" * (-len(rest) % 4), "<u4").tolist():
            w = w * 0xCC9E2D51 & 0xFFFFFFFF
            v ^= (w << 15 | w >> 17) * 0x1B873593 & 0xFFFFFFFF
            v = ((v << 13 | v >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h[i] = v
    h ^= (4 * words).astype(np.uint32)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _counted_terms(texts: np.ndarray, ends: np.ndarray, num_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(row * features + feature, count), ascending, of texts of words with a blank between: ``texts``
    are their UTF-8 bytes and three more, ``ends`` where each begins and the last ends."""
    n = int(ends[-1])
    data = texts[:n]
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    blank = data == 0x20
    start = np.flatnonzero(~blank & (edge[:-1] | np.r_[True, blank[:-1]]))
    end = np.flatnonzero(~blank & (edge[1:] | np.r_[blank[1:], True])) + 1
    pair = np.flatnonzero(row[start[:-1]] == row[start[1:]])
    char = np.r_[np.flatnonzero((data & 0xC0) != 0x80), n]
    gram = np.flatnonzero(row[char[:-3]] == row[char[2:-1]]) if len(char) > 3 else char[:0]
    # the regular expression also begins at the second half of a character beyond 16 bits, which UTF-8 has as "?"
    half = gram[data[char[gram]] >= 0xF0]
    found = ((0, start, end, None), (1, start[pair], end[pair + 1], None), (2, char[gram], char[gram + 3], None),
             (2, char[half + 1] - 1, char[half + 3], 0x3F))
    keys = [row[a] * (BLOCKS * num_features) + block * num_features + _hashes(texts, a, b, first).astype(np.int64)
            % num_features for block, a, b, first in found]
    return np.unique(np.concatenate(keys), return_counts=True)


def _term_chunks(texts: pa.Array, num_features: int) -> Iterator[pa.Array]:
    """A sparse vector of term counts per text, as ``VectorUDT`` stores it: an array for every
    ``CHUNK`` of text, as a text's vector is several times as large as the text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    size, at = BLOCKS * num_features, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        keys, counts = _counted_terms(np.r_[data[ends[at]:ends[to]], np.zeros(3, np.uint8)], ends[at:to + 1] - ends[at],
                                      num_features)
        places = pa.array(np.searchsorted(keys, np.arange(to - at + 1) * size).astype(np.int32))
        yield pa.StructArray.from_arrays(
            [pa.array(np.zeros(to - at, np.int8)), pa.array(np.full(to - at, size, np.int32)),
             pa.ListArray.from_arrays(places, pa.array((keys % size).astype(np.int32))),
             pa.ListArray.from_arrays(places, pa.array(counts.astype(np.float64)))],
            ["type", "size", "indices", "values"])
        at = to


def _term_vectors(texts: pa.Array, num_features: int) -> pa.Array:
    """The same in one array."""
    kind = pa.struct({"type": pa.int8(), "size": pa.int32(), "indices": pa.list_(pa.int32()), "values": pa.list_(pa.float64())})
    return pa.concat_arrays([pa.array([], kind), *_term_chunks(texts, num_features)])


class HashedTerms(Transformer, HasInputCol, HasOutputCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """Words with a blank between -> counts of their hashed words, word pairs and character trigrams.

    Of every block the counts are those of ``HashingTF`` over the same terms as arrays,
    each filled up by ``whole_words``.
    """

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, numFeatures: int = NUM_FEATURES):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n = self.getNumFeatures()
        # the workers find this package where the driver has it
        dataset.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_ROOT)

        # a batch has thousands of texts: their vectors go back a chunk at a time, so neither side holds them all
        @F.arrow_udf(VectorUDT())
        def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield from _term_chunks(texts, n)
        return dataset.withColumn(self.getOutputCol(), vectors(self.getInputCol()))


def featurizer_stages(text_col: str = "text", num_features: int = NUM_FEATURES) -> list:
    """Stages text -> ``features`` (sparse, non-negative, max-abs scaled)."""
    return [
        SQLTransformer(statement=f"SELECT *, coalesce(`{text_col}`, '') AS _text FROM __THIS__"),
        tokenizer("_text", "_words"),
        stop_words_remover("_words", "_clean"),
        SQLTransformer(statement="SELECT * EXCEPT (_words, _clean), array_join(_clean, ' ') AS _clean_text FROM __THIS__"),
        HashedTerms(inputCol="_clean_text", outputCol="_raw", numFeatures=num_features),
        Normalizer(p=2.0, inputCol="_raw", outputCol="_l2"),
        MaxAbsScaler(inputCol="_l2", outputCol="features"),
    ]


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def clean_words(text: Column) -> Column:
    """The tokens of a text without the stop words, in order."""
    stop = english_stop_words()          # so many literals are looked up in a hash set
    return F.filter(F.split(F.lower(text), TOKEN_PATTERN), lambda w: (F.length(w) > 0) & ~w.isin(*stop))


# -- DataFrame views of the same steps ------------------------------------------

def tokenized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``words`` (tokens) and ``clean`` (stop words removed)."""
    words = tokenizer(text_col, "words").transform(docs)
    return stop_words_remover("words", "clean").transform(words)


def terms(docs: DataFrame, text_col: str = "text", key: str | None = None,
          distinct_per_doc: bool = False) -> DataFrame:
    """One row per kept token: the tokenizer + stop-word stages as native
    expressions (``split`` in generated code, ``explode``, and an anti join
    with the stop list), for views that aggregate tokens rather than keep
    per-document arrays.  Same tokens as ``tokenized(...).clean``.

    The stop list has a fixed size (181 words), so broadcasting it is bounded.
    """
    words = F.split(F.lower(F.col(text_col)), TOKEN_PATTERN)
    if distinct_per_doc:
        words = F.array_distinct(words)
    cols = ([key] if key else []) + [F.explode(words).alias("term")]
    kept = docs.select(*cols).where(F.length("term") > 0)
    stop = docs.sparkSession.createDataFrame([(w,) for w in english_stop_words()], "term string")
    return kept.join(F.broadcast(stop), "term", "left_anti")


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term -> occurrences over all documents (map-side partial counts)."""
    return terms(docs, text_col).groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term -> number of documents containing it."""
    once = terms(docs, text_col, distinct_per_doc=True)
    return once.groupBy("term").agg(F.count(F.lit(1)).alias("doc_count"))


def char_gram_counts(docs: DataFrame, text_col: str = "text", n: int = CHAR_GRAM) -> DataFrame:
    """gram -> occurrences over all documents, in the text without its stop words."""
    clean = F.array_join(clean_words(F.col(text_col)), " ")
    grams = docs.select(F.explode(char_grams(clean, n)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("count"))


def word_grams(docs: DataFrame, key: str = "doc_id", text_col: str = "text", longest: int = 2) -> DataFrame:
    """(key, term): every word and every run of up to ``longest`` words, stop words left out before."""
    # exploded as an expression: of an array column Spark would infer a filter and find the words anew for each run
    rows = _gram_arrays(docs, key, text_col, longest)
    return rows.select(key, F.explode(F.concat("_grams", F.array().cast("array<string>"))).alias("term"))


def _gram_arrays(docs: DataFrame, key: str, text_col: str, longest: int) -> DataFrame:
    """(key, _grams): the same as an array a row."""
    rows = docs.select(key, clean_words(F.col(text_col)).alias("_words"))

    def runs(n: int) -> Column:
        none = F.array().cast("array<string>")
        return F.when(F.size("_words") >= n, F.transform(
            F.sequence(F.lit(1), F.size("_words") - (n - 1)),
            lambda i: F.array_join(F.slice("_words", i, n), " "))).otherwise(none)
    # the words are an array of their row, found once
    return rows.select(key, F.concat(F.col("_words"), *[runs(n) for n in range(2, longest + 1)]).alias("_grams"))


def _by_key(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the rows whose key no other row has, the rest): the first are whole texts, counted where they are read."""
    repeated = (docs.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") > 1).select("_key"))
    same = docs[key].eqNullSafe(repeated["_key"])
    return docs.join(repeated, same, "left_anti"), docs.join(repeated, same, "left_semi")


def _counted(arrays: DataFrame, key: str, terms: str, count: str) -> DataFrame:
    """(key, term, count) of each row's array of terms, found within the row: equal terms of the sorted
    array are runs, and a run's length is the distance of its end from the last one's."""
    at = F.when(F.size("_sorted") > 0, F.sequence(F.lit(1), F.size("_sorted")))
    ends = arrays.select(key, F.sort_array(terms).alias("_sorted")).select(key, "_sorted", F.filter(
        at, lambda i: ~F.get("_sorted", i - 1).eqNullSafe(F.get("_sorted", i))).alias("_ends"))
    runs = F.transform("_ends", lambda end, i: F.struct(
        F.get("_sorted", end - 1).alias("term"),
        (end - F.coalesce(F.get("_ends", i - 1), F.lit(0))).cast("bigint").alias(count)))
    return ends.select(key, F.inline(runs))


def ngram_dictionary(docs: DataFrame, key: str = "doc_id", text_col: str = "text", longest: int = 2,
                     min_docs: int = 1) -> DataFrame:
    """(term, id, doc_count): a number for every n-gram of the texts, from 0, the most frequent first.

    Unlike hashed features no two n-grams share a number, and unlike a fitted
    vocabulary the dictionary is a table: terms are counted with partial
    aggregation and numbered by a range sort, so it is never on one machine.
    """
    whole, parts = _by_key(docs, key)
    once = (_gram_arrays(whole, key, text_col, longest).select(F.explode(F.array_distinct("_grams")).alias("term"))
            .unionAll(word_grams(parts, key, text_col, longest).distinct().select("term")))
    found = once.groupBy("term").agg(F.count(F.lit(1)).alias("doc_count")).where(F.col("doc_count") >= min_docs)
    return numbered(found, [F.desc("doc_count"), F.asc("term")]).select("term", "id", "doc_count")


def ngram_counts(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text_col: str = "text",
                 longest: int = 2) -> DataFrame:
    """(key, id, count): each text's n-grams by their numbers; an n-gram that is not in the dictionary is left out.

    A text's n-grams are counted before they meet the dictionary, which has one row a term: the only
    shuffle of all (key, term) rows.  They are not sorted for it, the dictionary's side is hashed.
    """
    whole, parts = _by_key(docs, key)
    counts = _counted(_gram_arrays(whole, key, text_col, longest), key, "_grams", "count").unionByName(
        word_grams(parts, key, text_col, longest).groupBy(key, "term").agg(F.count(F.lit(1)).alias("count")))
    return counts.join(dictionary.select("term", "id").hint("shuffle_hash"), "term").select(key, "id", "count")


def max_abs_scaled_counts(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, term) count divided by the term's largest count in any document:
    the MaxAbsScaler of term-count vectors, as rows.

    The per-term maximum is an aggregate joined back on the term (AQE
    broadcasts it when small and splits a skewed term otherwise), not a
    window, so a term present in most documents is not sorted in one task.
    """
    whole, parts = _by_key(docs, key)
    tf = _counted(whole.select(key, clean_words(F.col(text_col)).alias("_words")), key, "_words", "tf").unionByName(
        terms(parts, text_col, key=key).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))
    peak = tf.groupBy("term").agg(F.max("tf").alias("max_tf"))
    return tf.join(peak, "term").select(key, "term", "tf", (F.col("tf") / F.col("max_tf")).alias("scaled"))
