"""BPE encoding and decoding with batched numpy merge rounds.

Vocabulary: a byte-level BPE file of the ``tokenizers`` library (its path is a
parameter; without a normaliser, with the byte-level split).  A worker process
reads a file once.

Encoding a batch of texts: the texts are cut at added tokens (their strings
become their ids) and split into words by the byte-level pattern.  The
distinct words of the batch are laid out as symbols in one flat array.  Every
round looks up the pair keys of all neighbours by binary search over the
sorted keys of the merge table, takes each word's lowest rank by a segmented
minimum, and merges that pair everywhere in its word, from the left; words
with no pair left drop out.  Ids are gathered back per text.

Decoding concatenates the ids' bytes by one gather and reads them as UTF-8,
with U+FFFD for what is not UTF-8, as the library does.

The split pattern runs in the ``regex`` module, whose Unicode tables may be
newer than the library's.  Each character beyond ASCII is compared once; a
text with one that the two class differently is split by the library.

Batches hold about ``BATCH_CHARS`` characters, or one text if that is longer,
so a task's memory follows the longest text and not the partition.

Defined cases: a NULL text counts as empty; an empty text has no ids (their
digest is that of the empty string); repeated rows give equal rows; further
columns are ignored; an empty table gives an empty result; ids outside the
vocabulary are rejected by ``decode``.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .common import require, text_or_empty

BATCH_CHARS = 4 << 20
NO_RANK = np.int32(2**31 - 1)

# Fixed values of the byte-level format: the split pattern, and the bytes that
# stand for themselves in a vocabulary file (others are U+0100 onwards).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a vocabulary file stands for."""
    hidden = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def ragged_gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s:s+n] for all (s, n), concatenated."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") \
                or not split.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        as_byte = byte_of_char()
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        spelled = {i: bytes(as_byte[c] for c in s) for s, i in vocab.items() if s not in self.added}
        spelled |= {i: s.encode() for s, i in self.added.items()}
        self.token_bytes = [spelled.get(i, b"") for i in range(self.size)]
        self.byte_lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.byte_flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.of_byte = np.zeros(256, np.int32)
        for c, b in as_byte.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int32), merged
        self.words = regex.compile(SPLIT)
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) \
            if self.added else None
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.as_byte = as_byte
        self.alike: dict[str, bool] = {}

    # --- splitting

    def _same_class(self, char: str) -> bool:
        """Whether both Unicode tables class a character alike."""
        if char not in self.alike:
            probe = f"a{char}b 1{char}2 .{char} {char}  x"
            spans, at = [], 0
            for word in self.words.findall(probe):
                spans.append((at, at + len(word)))
                at += len(word)
            self.alike[char] = spans == [span for _, span in self.library.pre_tokenize_str(probe)]
        return self.alike[char]

    def split(self, text: str) -> list[str]:
        if text.isascii() or all(map(self._same_class, set(text))):
            return self.words.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    # --- merging

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NO_RANK)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), counts)
        done_ids: list[np.ndarray] = []
        done_owner: list[np.ndarray] = []
        while len(symbols):
            # the rank of the pair that starts at each symbol; none at a word's end
            rank = np.full(len(symbols), NO_RANK)
            inside = owner[1:] == owner[:-1]
            rank[:-1][inside] = self._pair_ranks(symbols[:-1][inside], symbols[1:][inside])
            first = np.flatnonzero(np.concatenate(([True], ~inside)))
            length = np.diff(np.append(first, len(symbols)))
            low = np.minimum.reduceat(rank, first)
            ended = np.repeat(low == NO_RANK, length)
            if ended.any():
                done_ids.append(symbols[ended])
                done_owner.append(owner[ended])
                symbols, owner, rank = symbols[~ended], owner[~ended], rank[~ended]
                low, length = low[low != NO_RANK], length[low != NO_RANK]
                if not len(symbols):
                    break
            hit = rank == np.repeat(low, length)
            # of pairs that overlap (a run of one symbol), every second from the left
            at = np.flatnonzero(hit)
            run_start = np.concatenate(([True], (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])))
            place = np.arange(len(at)) - np.flatnonzero(run_start)[np.cumsum(run_start) - 1]
            at = at[place % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.merged[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        words: list[str] = []
        n_words = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            before = len(words)
            if self.cuts is None or not self.cuts.search(text):
                words += self.split(text)
            else:
                at = 0
                for m in self.cuts.finditer(text):
                    words += self.split(text[at:m.start()])
                    words.append("\0" + m[0])      # no own word of a text holds an added token
                    at = m.end()
                words += self.split(text[at:])
            n_words[i] = len(words) - before
        if not words:
            return np.zeros(0, np.int32), n_words
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        del words
        distinct = coded.dictionary.to_pylist()
        which = coded.indices.to_numpy()
        special = {i: self.added[w[1:]] for i, w in enumerate(distinct)
                   if w[:1] == "\0" and w[1:] in self.added}
        ids, n_ids = self.merge_words([b"" if i in special else w.encode() for i, w in enumerate(distinct)])
        if special:
            where = np.array(list(special))
            ids = np.insert(ids, (np.cumsum(n_ids) - n_ids)[where], list(special.values()))
            n_ids[where] = 1
        starts = np.cumsum(n_ids) - n_ids
        per_word = n_ids[which]
        text_of_word = np.repeat(np.arange(len(texts)), n_words)
        n_tokens = np.bincount(text_of_word, weights=per_word, minlength=len(texts)).astype(np.int64)
        return ragged_gather(ids, starts[which], per_word), n_tokens

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included."""
        ids = np.asarray(ids)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        return ragged_gather(self.byte_flat, self.byte_starts[ids], self.byte_lengths[ids]) \
            .tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def text_batches(column: pa.Array, chars: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(position, texts) of about ``chars`` characters each."""
    start, held, size = 0, [], 0
    for i, value in enumerate(column):
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= chars:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def encode_texts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded): ids of every whole text, and their text again."""
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path)
        for batch in batches:
            for start, texts in text_batches(batch.column(1)):
                ids, n = bpe.encode(texts)
                ends = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                     pa.array([bpe.decode(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.string())],
                    ["id", "ids", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string")


def digest_texts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), digested beside the encoder.

    The same encoder as ``encode_texts``; ids and texts do not leave the worker.
    """
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path)
        for batch in batches:
            for start, texts in text_batches(batch.column(1)):
                ids, n = bpe.encode(texts)
                ids = ids.astype("<u4")
                parts = np.split(ids, np.cumsum(n)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()),
                     pa.array([hashlib.sha256(p.tobytes()).hexdigest() for p in parts], pa.string()),
                     pa.array([hashlib.sha256(bpe.decode(p).encode()).hexdigest() for p in parts], pa.string())],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
