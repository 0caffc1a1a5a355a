"""What the similarity joins share: texts prepared once, counts of tokens, and postings packed by columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm import shingles as S
from millrace.session import written

EPS = 1e-9
#: Widths of the table of counts (powers of two): a cell for two tokens, within these bounds.
NARROW, WIDE = 1 << 20, 1 << 25
#: Postings of one token that are compared in one task; longer lists are cut in blocks that meet in pairs.
BLOCK = 4096
#: Postings that one partition should hold.
PER_PARTITION = 2_000_000
#: References to sets in postings: bits of their first id. Sets that share one are told apart when texts are compared.
REF = np.int64((1 << 40) - 1)
#: Rows that an array operation makes at once.
CHUNK = 1 << 20

# Steps of frequency: each small number its own, then eight an octave; step 0 is a token that stands once.
_STEPS = np.unique(np.ceil(2 * 2 ** (np.arange(31 * 8) / 8)).astype(np.int64))[:254]


def texts_of(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def prepared_all(df: DataFrame, text: str, width: int, keep: list[str]) -> DataFrame:
    """keep columns, s1, s2 (id of the set of shingles), ref, n (shingles) and words (the normalised text); these are null for rows without words."""
    names = [f.name for f in df.schema.fields if f.name in keep]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n_words, docs = S.word_hashes(texts_of(batch, text))
            h, doc = S.shingle_sets(flat, n_words, width)
            id1, id2 = S.set_ids(h, doc, batch.num_rows)
            size = np.bincount(doc, minlength=batch.num_rows)
            none = n_words == 0
            rest = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            words = pa.array([b" ".join(d).decode() if d else None for d in docs], pa.string())
            yield pa.RecordBatch.from_pydict(rest | {"s1": pa.array(id1, mask=none), "s2": pa.array(id2, mask=none), "ref": pa.array(id1 & REF, mask=none), "n": pa.array(size.astype(np.int32), mask=none), "words": words})

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in keep)
    return df.select(*names, text).mapInArrow(make, kinds + "s1 long, s2 long, ref long, n int, words string")


def prepared(df: DataFrame, text: str, width: int, keep: list[str]) -> DataFrame:
    """As prepared_all, of rows with words only."""
    return prepared_all(df, text, width, keep).where("words is not null")


def _squeezed(counts: np.ndarray) -> bytes:
    """Counters as bytes, with a list of those that don't fit, compressed."""
    big = np.flatnonzero(counts > 254).astype(np.uint32)
    low = np.where(counts > 254, 255, counts).astype(np.uint8)
    raw = np.array([len(counts), len(big)], np.int64).tobytes() + big.tobytes() + counts[big].astype(np.int64).tobytes() + low.tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _restored(blob: bytes) -> np.ndarray:
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]), codec="zstd", asbytes=True)
    n, m = np.frombuffer(raw, np.int64, 2)
    counts = np.frombuffer(raw, np.uint8, n, 16 + 12 * m).astype(np.int64)
    counts[np.frombuffer(raw, np.uint32, m, 16)] = np.frombuffer(raw, np.int64, m, 16 + 4 * m)
    return counts


def counted(df: DataFrame, tokens: Callable[[pa.RecordBatch], np.ndarray], total: int) -> np.ndarray:
    """How often the tokens occur, as steps of frequency in a table addressed by hash; step 0 only for what stands once at most.

    The table's width follows ``total``, the number of tokens, between NARROW and WIDE. Each task sums its rows in one
    table, tasks meet block by block, in two levels where they are many; the summed table (a byte a cell, 32 MB at
    most) reaches the driver. What the cells hold on average is taken off as the share of other tokens.
    """
    width = min(WIDE, max(NARROW, 1 << max(0, total // 2 - 1).bit_length()))
    blocks = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width, np.uint32)
        for batch in batches:
            cell, n = np.unique(tokens(batch) & np.uint64(width - 1), return_counts=True)
            sums[cell.astype(np.int64)] += n.astype(np.uint32)
        if sums.any():
            task = TaskContext.get()
            lot = (task.partitionId() if task else 0) % 256
            yield pa.RecordBatch.from_pydict({"lot": pa.array([lot] * blocks, pa.int32()), "block": pa.array(range(blocks), pa.int32()), "counts": pa.array([_squeezed(p) for p in sums.reshape(blocks, -1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                c = _restored(c)
                sums[b] = sums[b] + c if b in sums else c
        if sums:
            yield pa.RecordBatch.from_pydict({"lot": pa.array([0] * len(sums), pa.int32()), "block": pa.array(list(sums), pa.int32()), "counts": pa.array([_squeezed(s) for s in sums.values()], pa.binary())})

    schema = "lot int, block int, counts binary"
    rows = df.mapInArrow(count, schema)
    if rows.rdd.getNumPartitions() > 256:
        rows = rows.repartition(1024, "lot", "block").mapInArrow(add, schema)
    counts = np.zeros((blocks, width // blocks), np.int64)
    for r in rows.repartition(16, "block").mapInArrow(add, schema).toLocalIterator():
        counts[r.block] = _restored(r.counts)
    counts = counts.reshape(-1)
    own = counts - int(counts.sum()) // width
    return np.where(counts > 1, np.maximum(1, np.searchsorted(_STEPS, own, side="right")), 0).astype(np.uint8)


def steps_of(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    return table[(h & np.uint64(len(table) - 1)).astype(np.int64)]


def blocks_of(steps: np.ndarray) -> np.ndarray:
    """In how many blocks a token's list is cut, by its step of frequency."""
    return -(-np.concatenate(([1], _STEPS, [_STEPS[-1]] * (255 - len(_STEPS))))[steps] // BLOCK)


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns (arrays of one length, or of several items a row) by byte planes, compressed."""
    n = len(columns[0])
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns)
    return np.array([n, len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    n, size = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    raw = np.frombuffer(pa.decompress(blob[16:], size, codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, width in kinds:
        item = np.dtype(kind).itemsize * width
        c = np.ascontiguousarray(raw[at : at + n * item].reshape(item, n).T).view(kind)
        out.append(c if width > 1 else c.reshape(n))
        at += n * item
    return out


def refs_packed(ref: np.ndarray) -> list[np.ndarray]:
    return [(ref & 0xFFFFFFFF).astype(np.uint32), (ref >> 32).astype(np.uint8)]


def spread(parts: np.ndarray, n_parts: int, order: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Postings grouped by partition, in the given order within each: one packed row per partition."""
    order = order[np.argsort(parts[order], kind="stable")]
    parts = parts[order]
    columns = [c[order] for c in columns]
    present, begin = np.unique(parts, return_index=True)
    ends = np.append(begin[1:], len(parts))
    for k in range(0, len(present), 256):
        blobs = [packed([c[a:b] for c in columns]) for a, b in zip(begin[k : k + 256], ends[k : k + 256])]
        yield pa.RecordBatch.from_pydict({"part": pa.array(present[k : k + 256], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def first_of_each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the first occurrence of each (a, b)."""
    order = np.lexsort((b, a))
    keep = np.ones(len(order), bool)
    keep[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return np.sort(order[keep])


def ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, counts[i] rows (i, starts[i] + 0, 1, ...)."""
    i = np.repeat(np.arange(len(starts)), counts)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[i]


def slices_of(counts: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows whose counts sum to the limit at most, or of one row."""
    tail, lo = np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(tail, (tail[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi
        lo = hi


def n_partitions(df: DataFrame, postings: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(postings / PER_PARTITION))


def verified(pairs: DataFrame, texts: DataFrame, t: float, width: int) -> DataFrame:
    """a1, a2, b1, b2: those pairs of sets under the pairs of refs (a, b) whose likeness is at least t.

    texts: ref, s1, s2, words. Only texts under a ref of a pair travel; sets that share a ref are all compared.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4000):
                part = batch.slice(k, 4000)
                c, p, q = S.overlaps(texts_of(part, "x"), texts_of(part, "y"), width)
                yield part.filter(pa.array(c >= t * (p + q - c) - EPS)).select(["a1", "a2", "b1", "b2"])

    # written, so their size is known: where the refs are few the texts are filtered as they are read, else where they meet
    pairs = written(pairs)
    texts = texts.join(pairs.select(F.explode(F.array("a", "b")).alias("ref")), "ref", "left_semi")
    one = texts.groupBy("ref", "s1", "s2").agg(F.first("words").alias("words"))
    left = pairs.join(one.select(F.col("ref").alias("a"), F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("words").alias("x")), "a")
    both = left.join(one.select(F.col("ref").alias("b"), F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("words").alias("y")), "b")
    both = both.where("a <> b or struct(a1, a2) < struct(b1, b2)")
    return both.select("a1", "a2", "b1", "b2", "x", "y").mapInArrow(check, "a1 long, a2 long, b1 long, b2 long")


def expanded(sets: DataFrame, members: DataFrame, key: str, wanted: Column) -> DataFrame:
    """<key>_a, <key>_b: the pairs of rows of pairs of sets and of equal sets, as far as ``wanted`` (of the structs x and y of the members' columns) holds."""
    rest = F.struct(*[c for c in members.columns if c not in ("s1", "s2")])
    m = members.select("s1", "s2", rest.alias("m"))
    a = sets.withColumnsRenamed({"a1": "s1", "a2": "s2"}).join(m, ["s1", "s2"]).select("b1", "b2", F.col("m").alias("x"))
    between = a.withColumnsRenamed({"b1": "s1", "b2": "s2"}).join(m, ["s1", "s2"]).select("x", F.col("m").alias("y")).where(wanted)
    within = m.withColumnRenamed("m", "x").join(m.withColumnRenamed("m", "y"), ["s1", "s2"]).where((F.col("x")[key] < F.col("y")[key]) & wanted)
    every = between.unionAll(within.select("x", "y")).select(F.col("x")[key].alias("x"), F.col("y")[key].alias("y"))
    return every.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
