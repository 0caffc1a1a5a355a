"""Problem 7: new batches held against all history, without reprocessing the history.

Content-defined chunking: a hash rolls over three words, and a chunk begins where it meets a condition, so an edit changes
only the chunks it touches. A chunk is known by the window at its beginning and runs to the next beginning. The
persistent chunk table maps chunks to records, with the bytes of each; it is bucketed by chunk, and batches are appended
to it, each to a partition of its own, so an append that is repeated replaces itself. A batch brings its chunks to the
buckets, where they meet those of all records accepted so far and of the batch itself: no row of the history is
shuffled, and none of its texts is read or cut again. The chunks and bytes that two records share add up over the
buckets, and coverage decides which pairs are kept; an exact check of whole texts follows.

Each record enters the table with its rarest chunks, one more than likeness allows it to lose; the order of rarity is
fixed when the store is made. From the sizes of two records follows how many of the entered chunks alike ones must
share: the coverage asked for, so deciding by it loses no pair. Records
with too few chunks to be sure of one that is left (short or repetitive texts) are entered under the prefix of their
shingles as well, under which all that are alike meet.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import postings as P, shingles as S
from millrace.llm.near_duplicates import needed
from millrace.session import shared_dir

WINDOW = 3
#: Share of windows that begin a chunk, in eighths.
BEGINS = 7
#: Entries beyond the first that alike records are asked to share.
MORE = 3
#: Columns of an entry: token, ref (two parts), shingles and chunks of the record, fewest bytes of its entries, place of the chunk in the record's order, bytes of the chunk.
KINDS = [(np.uint32, 1), (np.uint32, 1), (np.uint8, 1), (np.uint32, 1), (np.uint32, 1), (np.uint16, 1), (np.uint32, 1), (np.uint32, 1)]
RECORDS = "row_id long, h string, keys array<long>, s1 long, s2 long, ref long, n int, words string, batch_no int"
#: What an entry for a single shingle covers: enough by itself.
SURE = 1 << 20
#: Coverage as one number: chunks in the upper bits, bytes in the lower 40.
_BYTES = 40


def chunks_of(flat: np.ndarray, n_words: np.ndarray, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, bytes) of the distinct chunks of each text, sorted by text and hash; of one that occurs twice the first counts."""
    h, doc, first = S.windows(flat, n_words, WINDOW)
    length = np.array([len(w) + 1 for d in docs for w in d], np.int64)
    before = np.concatenate(([0], np.cumsum(length)))
    begins = h % np.uint64(8) < BEGINS
    h, doc, first = h[begins], doc[begins], first[begins]
    ends = np.cumsum(n_words)[doc] if len(doc) else np.zeros(0, np.int64)
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    stop = np.where(last, ends, np.append(first[1:], 0)) if len(doc) else ends
    size = before[stop] - before[first]
    order = np.lexsort((np.arange(len(h)), h, doc))
    h, doc, size = h[order], doc[order], size[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep], size[keep]


def losses(t: float, n: np.ndarray) -> np.ndarray:
    """Shingles of n that an alike record may lack."""
    return n - np.ceil(t * n - P.EPS).astype(np.int64)


def post_chunks(texts: DataFrame, given: Broadcast[np.ndarray], n_parts: int, t: float, probe: bool) -> DataFrame:
    """part, blob: the entries of records (s1, s2, ref, words) in the chunk table; given: the order of chunks. Entries of a hot chunk are spread over blocks; as a ``probe`` they go to all of them."""
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = given.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = list(zip(P.texts_of(batch, "s1"), P.texts_of(batch, "s2")))
            if len(seen) > 1_000_000:
                seen.clear()
            new = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
            batch = batch.take(pa.array(new, pa.int64()))
            k = len(new)
            flat, n_words, docs = S.plain_hashes(P.texts_of(batch, "words"))
            ref = np.array(P.texts_of(batch, "ref"), np.int64)
            h, hd = S.shingle_sets(flat, n_words, WINDOW)
            n = np.bincount(hd, minlength=k)
            chunk, doc, size = chunks_of(flat, n_words, docs)
            c = np.bincount(doc, minlength=k)
            step = P.steps_of(table, chunk)
            order = np.lexsort((chunk, step, doc))
            chunk, doc, size, step = chunk[order], doc[order], size[order], step[order]
            pos = np.arange(len(chunk)) - np.repeat(np.cumsum(c) - c, c)
            lost = losses(t, n)
            use = pos <= lost[doc]
            token, doc, size, pos, blocks = S.mix(chunk[use]), doc[use], size[use], pos[use], P.blocks_of(step[use])
            least = np.full(k, 65535, np.int64)
            np.minimum.at(least, doc, size)
            # too few chunks to be sure of one that is left: single shingles too, in the order of their hashes
            at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            few = (c <= lost)[hd] & (at <= lost[hd])
            token = np.concatenate((token, S.mix(h[few] + np.uint64(1))))
            doc, size, pos = np.concatenate((doc, hd[few])), np.concatenate((size, np.full(few.sum(), SURE))), np.concatenate((pos, at[few]))
            blocks = np.concatenate((blocks, P.blocks_of(P.steps_of(table, h[few]))))
            if (blocks > 1).any():
                if probe:
                    i, block = P.ranges(np.zeros(len(blocks), np.int64), blocks)
                    token, doc, size, pos, blocks = token[i], doc[i], size[i], pos[i], blocks[i]
                else:
                    block = ref[doc] % blocks
                token = np.where(blocks > 1, S.mix(token + S.mix(block.astype(np.uint64))), token)
            part = ((token & np.uint64(0x7FFFFFFF)) % np.uint64(n_parts)).astype(np.int64)
            token = (token >> np.uint64(32)).astype(np.uint32)
            columns = [token, *P.refs_packed(ref[doc]), n[doc].astype(np.uint32), c[doc].astype(np.uint32), least[doc].astype(np.uint16), pos.astype(np.uint32), size.astype(np.uint32)]
            yield from P.spread(part, n_parts, np.argsort(token, kind="stable"), columns)

    return texts.select("ref", "s1", "s2", "words").mapInArrow(post, "part int, blob binary")


def settled(rows: DataFrame) -> DataFrame:
    """part, blob: the rows of each part as one, each entry once and sorted, so that look-ups need no sorting. A task holds its parts one by one if they come sorted."""

    def merge(blobs: list[bytes]) -> bytes:
        token, low, high, *rest = (np.concatenate(x) for x in zip(*[P.unpacked(b, KINDS) for b in blobs]))
        order = np.lexsort((low, high, token))
        once = np.ones(len(token), bool)
        a, b, c = token[order], low[order], high[order]
        once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        order = order[once]
        return P.packed([x[order] for x in (token, low, high, *rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and part != last:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([last], pa.int32()), "blob": pa.array([merge(held)], pa.binary())})
                    held = []
                held.append(blob)
                last = part
        if held:
            yield pa.RecordBatch.from_pydict({"part": pa.array([last], pa.int32()), "blob": pa.array([merge(held)], pa.binary())})

    return rows.sortWithinPartitions("part").mapInArrow(run, "part int, blob binary")


def _entries(blob: bytes) -> list[np.ndarray]:
    token, low, high, *rest = P.unpacked(blob, KINDS)
    return [token, low.astype(np.int64) | high.astype(np.int64) << 32, *[c.astype(np.int64) for c in rest]]


def shared(batch: pa.Table, held: pa.Table, t: float) -> pa.Table:
    """a, b, covered, asked of the pairs of a record of the batch and one of the table that meet in a bucket.

    Of two records of n and m shingles that need ``least`` common ones, the first MORE + 1 chunks that they share stand
    among the first n - least + MORE + 1 of the one and m - least + MORE + 1 of the other: only those count, and so many
    are asked, or as many as they have in common for certain, if that is less, with the fewest bytes that they may have.
    """
    parts: list[np.ndarray] = []

    def merged() -> np.ndarray:
        rows = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        if not len(rows):
            return rows
        new = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1))))
        return np.column_stack((rows[new, :2], np.add.reduceat(rows[:, 2], new), rows[new, 3]))

    probes = [_entries(b) for b in batch.column("blob").to_pylist()]
    tx, rx, nx, cx, lx, px, _ = (np.concatenate(c) for c in zip(*probes)) if probes else [np.zeros(0, np.int64)] * 7
    for blob in held.column("blob").to_pylist() if len(tx) else ():
        ty, ry, ny, cy, ly, py, sy = _entries(blob)
        start = np.searchsorted(ty, tx, side="left")
        counts = np.searchsorted(ty, tx, side="right") - start
        for lo, hi in P.slices_of(counts):
            i, y = P.ranges(start[lo:hi], counts[lo:hi])
            x = i + lo
            n, m = nx[x], ny[y]
            least = needed(t, n, m)
            ok = (rx[x] != ry[y]) & (least <= np.minimum(n, m)) & ((px[x] <= n - least + MORE) & (py[y] <= m - least + MORE) | (sy[y] == SURE))
            x, y, n, m, least = x[ok], y[ok], n[ok], m[ok], least[ok]
            sure = sy[y] == SURE
            common = np.maximum(cx[x] - n, cy[y] - m) + least
            inside = np.minimum(losses(t, n) - n, losses(t, m) - m) + least + 1
            chunks = np.maximum(1, np.minimum(np.minimum(common, inside), MORE + 1))
            need = (chunks << _BYTES) | chunks * np.minimum(lx[x], ly[y])
            covered = np.where(sure, (SURE << _BYTES) | (SURE << 16), (1 << _BYTES) | np.minimum(sy[y], 65535))
            parts.append(np.column_stack((np.minimum(rx[x], ry[y]), np.maximum(rx[x], ry[y]), covered, need)))
            if sum(map(len, parts)) > 4 * P.CHUNK:
                parts = [merged()]
    rows = merged()
    return pa.table({name: pa.array(rows[:, i]) for i, name in enumerate(("a", "b", "covered", "asked"))})


class ChunkStore:
    """What has been accepted so far, under a path: records, chunk table, order of chunks and the pairs found for each batch.

    records: row id, hash, keys and normalised text by batch; chunks: the chunk table, a partition for each batch, bucketed;
    found: pairs of refs by batch. Everything is written by batch and replaced when a batch is run again.
    """

    def __init__(self, spark: SparkSession, path: str, t: float = 0.6):
        self.spark, self.path, self.t = spark, path, t
        self.table = f"chunks_{uuid.uuid4().hex}"
        self.steps: Broadcast[np.ndarray] | None = None
        self.parts = 0

    def _opened(self) -> None:
        """Read the order of chunks and register the table; a store that was never begun raises."""
        if self.steps is None:
            row = self.spark.read.parquet(f"{self.path}/order").first()
            note = json.loads(row.note)
            assert note["t"] == self.t, "the store was made for another likeness"
            # 32 MB at most, shipped once for all batches
            self.steps, self.parts = self.spark.sparkContext.broadcast(np.frombuffer(row.steps, np.uint8)), note["parts"]
            self.spark.sql(f"create table {self.table} (part int, blob binary, batch_no int) using parquet partitioned by (batch_no) clustered by (part) into {self.parts} buckets location '{self.path}/chunks'")
            # the partitions of batches that were appended before
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/chunks")
            if folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
                self.spark.sql(f"alter table {self.table} recover partitions")

    def land(self, records: DataFrame, key: str) -> None:
        """Normalise records (key, batch_no, job_id_hash, body, keys) and keep them by batch; nothing is accepted yet."""
        hashed = F.transform(F.coalesce("keys", F.array().cast("array<string>")), lambda k: F.xxhash64(k))
        rows = records.select(F.col(key).cast("long").alias("row_id"), F.col("batch_no").cast("int").alias("batch_no"), F.lower("job_id_hash").alias("h"), hashed.alias("keys"), "body")
        rows = P.prepared_all(rows, "body", WINDOW, ["row_id", "batch_no", "h", "keys"])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("batch_no").parquet(f"{self.path}/records")

    def records(self, batch_no: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(RECORDS).parquet(f"{self.path}/records")
        return rows if batch_no is None else rows.where(F.col("batch_no") == batch_no)

    def texts(self, batch_no: int | None = None) -> DataFrame:
        """Records with a text that can meet others: words and a key."""
        return self.records(batch_no).where("words is not null and size(keys) > 0")

    def begin(self, batch_no: int = 0) -> None:
        """Fix the order of chunks and the number of buckets by a first batch."""
        texts = self.texts(batch_no)
        total = texts.agg(F.sum("n")).first()[0] or 0

        def tokens(batch: pa.RecordBatch) -> np.ndarray:
            return S.shingle_sets(*S.plain_hashes(P.texts_of(batch, "words"))[:2], WINDOW)[0]

        steps = P.counted(texts.select("words"), tokens, total)
        # the first batch is part of a history that grows
        note = {"t": self.t, "parts": P.n_partitions(texts, int(2 * total * (1 - self.t)))}
        self.spark.createDataFrame([(bytearray(steps.tobytes()), json.dumps(note))], "steps binary, note string").write.mode("overwrite").parquet(f"{self.path}/order")
        self.steps = None

    def append(self, batch_no: int) -> None:
        """Accept a landed batch: add its entries to the chunk table."""
        self._opened()
        rows = settled(post_chunks(self.texts(batch_no), self.steps, self.parts, self.t, probe=False).repartition(self.parts, "part"))
        # overwriting the one partition makes a repeated append harmless
        self.spark.sql(f"insert overwrite table {self.table} partition (batch_no = {batch_no}) select part, blob from {{rows}}", rows=rows)
        self.spark.catalog.refreshTable(self.table)

    def match(self, batch_no: int) -> None:
        """Find the pairs of an accepted batch with all records accepted up to it that cover each other enough."""
        self._opened()
        probe = post_chunks(self.texts(batch_no), self.steps, self.parts, self.t, probe=True)
        held = self.spark.table(self.table).where(F.col("batch_no") <= batch_no).select("part", "blob")
        t = self.t
        met = probe.groupBy("part").cogroup(held.groupBy("part")).applyInArrow(lambda x, y: shared(x, y, t), "a long, b long, covered long, asked long")
        sums = met.groupBy("a", "b").agg(F.sum("covered").alias("covered"), F.max("asked").alias("asked"))
        low = F.lit((1 << _BYTES) - 1)
        enough = (F.shiftright("covered", _BYTES) >= F.shiftright("asked", _BYTES)) & (F.col("covered").bitwiseAND(low) >= F.col("asked").bitwiseAND(low))
        sums.where(enough).select("a", "b").write.mode("overwrite").parquet(f"{self.path}/found/batch_no={batch_no}")

    def batches(self) -> list[int]:
        """Numbers of the batches that have landed: one for each delivery."""
        return sorted(r[0] for r in self.records().select("batch_no").distinct().collect())

    def pairs(self, batches: list[int]) -> DataFrame:
        """row_id_a, row_id_b: pairs found for these batches that the check of whole texts confirms and that share a key, and those of equal hashes."""
        found = self.spark.read.schema("a long, b long, batch_no int").parquet(f"{self.path}/found").where(F.col("batch_no").isin(batches)).select("a", "b").distinct() if batches else self.spark.createDataFrame([], "a long, b long")
        texts = self.texts()
        alike = P.verified(found, texts.select("ref", "s1", "s2", "words"), self.t, WINDOW)
        new = F.col("batch_no").isin(batches)
        members = texts.select("s1", "s2", "row_id", new.alias("is_new"), "keys")
        wanted = (F.col("x.is_new") | F.col("y.is_new")) & F.arrays_overlap("x.keys", "y.keys")
        every = P.expanded(alike, members, "row_id", wanted).unionAll(equal_hashes(self.records().select("row_id", "h", new.alias("is_new"))))
        return every.dropDuplicates()


def equal_hashes(records: DataFrame) -> DataFrame:
    """row_id_a, row_id_b: pairs of rows (row_id, h, is_new), one of them new, with the same hash; a hash that very many rows hold is split by AQE."""
    h = records.where("h is not null").select("h", F.col("row_id").alias("x"), F.col("is_new").alias("nx"))
    fresh = h.where("nx").drop("nx")
    # new rows meet old ones, and later new ones
    pairs = fresh.join(h.withColumnsRenamed({"x": "y", "nx": "ny"}), "h").where("not ny or x < y")
    return pairs.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))


def match_batches(records: DataFrame, key: str, t: float = 0.6, path: str | None = None) -> DataFrame:
    """<key>_a, <key>_b: pairs of rows, one of them of a batch above 0, with equal job_id_hash, or alike texts and a common block key.

    records: key, batch_no (0: the history that is there already), job_id_hash, body (null: the text takes no part), keys
    (array of strings). The history makes the store, then each batch is appended and matched in turn. Null hashes match
    nothing; rows without keys match by hash only; exact repeats match like others; rows without batch number form the
    last batch. No other column is read.
    """
    spark = records.sparkSession
    store = ChunkStore(spark, path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}", t)
    store.land(records.withColumn("batch_no", F.coalesce("batch_no", F.lit(2**31 - 1))), key)
    numbers = store.batches()
    store.begin(0)
    store.append(0)
    for b in (x for x in numbers if x):
        store.append(b)
        store.match(b)
    return store.pairs([x for x in numbers if x]).withColumnsRenamed({"row_id_a": f"{key}_a", "row_id_b": f"{key}_b"})
