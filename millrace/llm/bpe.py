"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

Pair occurrence index: the distinct words of a batch are laid out in one linked array of symbols; an index maps each
pair of neighbours to all its positions in the batch; the ranks that are active are applied in ascending order, each
to all its positions, and only the lists of the pairs at a merge are updated. A merge makes only pairs of higher
rank, so one ascending pass over the ranks gives what word-by-word encoding gives, also for words of any length.
"""

from __future__ import annotations

import base64
import heapq
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

#: Fixed value: the pattern that cuts a text into words for the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Words whose ids a worker remembers; a cache only.
REMEMBERED = 1_000_000


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = FOLDER) -> str:
    path = os.path.join(folder, f"{name}.tiktoken")
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(f"{name}.tiktoken")
    return path


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Byte-level BPE by the ranks of a vocabulary file."""

    def __init__(self, vocabulary: bytes | str):
        """vocabulary: the lines of a vocabulary file, or its path."""
        if isinstance(vocabulary, str):
            vocabulary = vocabulary_bytes(vocabulary)
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.lengths[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall

    def _rank(self, pair: tuple[int, int]) -> int:
        """Id of the symbol that a pair merges to, which is also its rank; -1 if it doesn't merge."""
        r = self.pairs.get(pair)
        if r is None:
            r = self.pairs[pair] = self.ranks.get(self.bytes_of[pair[0]] + self.bytes_of[pair[1]], -1)
        return r

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word, all words at once."""
        out: list[tuple[int, ...] | None] = [None] * len(words)
        symbols: list[int] = []
        begin: list[int] = []
        rest: list[int] = []
        for k, w in enumerate(words):
            b = w.encode("utf-8")
            r = self.ranks.get(b)
            if r is not None and len(b) < 2:
                out[k] = (r,)
                continue
            rest.append(k)
            begin.append(len(symbols))
            symbols.extend([self.single[c] for c in b])
        n = len(symbols)
        if not n:
            return out
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        for b in begin:
            prv[b] = -1
            if b:
                nxt[b - 1] = -1
        nxt[n - 1] = -1
        index: dict[int, list[int]] = {}
        active: list[int] = []
        rank = self._rank

        def enter(i: int) -> None:
            j = nxt[i]
            if j >= 0 and (r := rank((symbols[i], symbols[j]))) >= 0:
                at = index.get(r)
                if at is None:
                    index[r] = [i]
                    heapq.heappush(active, r)
                else:
                    at.append(i)

        for i in range(n):
            enter(i)
        while active:
            r = heapq.heappop(active)
            for i in sorted(index.pop(r)):  # from left to right, as overlapping pairs of one symbol merge
                j = nxt[i]
                # a position whose pair has changed since it was entered stays out
                if symbols[i] < 0 or j < 0 or rank((symbols[i], symbols[j])) != r:
                    continue
                symbols[i], symbols[j] = r, -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prv[k] = i
                    enter(i)
                if prv[i] >= 0:
                    enter(prv[i])
        for k, b in zip(rest, begin):
            ids = []
            i = b
            while i >= 0:
                ids.append(symbols[i])
                i = nxt[i]
            out[k] = tuple(ids)
        return out

    def encode_words(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text; the ids of all of them are in self.words afterwards."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        cut = [self.split(t) if t else [] for t in texts]
        new = list(set().union(*[set(ws).difference(self.words) for ws in cut]))
        # long words first fill a run of their own, so one batch never holds too many symbols at once
        for run in _runs(new):
            self.words.update(zip(run, self.merge(run)))
        return cut

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        known = self.words
        out = []
        for ws in self.encode_words(texts):
            out.append(list(chain.from_iterable(map(known.__getitem__, ws))))
        return out


def _runs(words: list[str], limit: int = 1_000_000) -> Iterator[list[str]]:
    run: list[str] = []
    size = 0
    for w in words:
        run.append(w)
        size += len(w)
        if size > limit:
            yield run
            run, size = [], 0
    if run:
        yield run


_encoders: dict[int, Encoder] = {}


def shipped(df: DataFrame, path: str) -> Broadcast[bytes]:
    """The vocabulary file at a path of the driver, for the workers (about a megabyte): they need no such path."""
    return df.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))


def encoder(vocabulary: Broadcast[bytes]) -> Encoder:
    """The worker's encoder for a shipped vocabulary, made once."""
    key = zlib.crc32(vocabulary.value)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary.value)
    return _encoders[key]


def slices(batch: pa.RecordBatch, text: str, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of a limited number of bytes, so very long texts don't add up in a worker."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(col), 0))
    part = np.cumsum(sizes) // chars
    edges = np.concatenate((np.flatnonzero(np.diff(part, prepend=-1)), [batch.num_rows])) if len(part) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(a, b - a)


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None, out: str = "ids") -> DataFrame:
    """key and ids, without special tokens, for every row; an empty and a null text give an empty list.

    Strings that look like special tokens are ordinary text. One pass over the rows, no shuffle.
    """
    vocabulary = shipped(df, path or vocabulary_path())
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        e = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "t"):
                ids = e.encode(part.column(1).to_pylist())
                flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["k", "ids"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>")
    return rows.select(F.col("k").alias(key), F.col("ids").alias(out))


def decoded(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """key and text: what lists of ids stand for; bytes that are no UTF-8 show replacement marks. A null list gives an empty text."""
    vocabulary = shipped(df, path or vocabulary_path())
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(vocabulary).bytes_of
        for batch in batches:
            texts = [b"".join([of[i] for i in x or ()]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    return df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
