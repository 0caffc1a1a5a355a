"""Problem 6: pairs of records whose shingle sets are alike, without comparing all pairs.

Prefix-tree join. All sets are put in one global order of shingles, rare ones first, by counts over the whole
collection. A set enters the tree below each shingle of its prefix (a pair that is alike enough shares one there), with
the shingles that follow it as its path. Subtrees are spread over partitions by their root shingle; one that too many
sets enter is cut in blocks that meet in pairs. Within a partition the tree is laid out as flat levels: nodes keep the
range of set sizes and the most that remains below them. Pairs of nodes are walked from the root down, so what sets with
one path share is worked out once for all of them, and a pair of subtrees is cut as soon as the overlap so far and the
remaining lengths can't reach what the smallest sets below need. Pairs of sets that are left pass the same bound with
their own lengths, and a bound by parity bitmaps of what remains. A bound may take the root for the first shingle that two
sets share, as below that one they meet too: what stands before it is lost to both. All bounds are exact, so no pair is
lost. Candidates are then
verified on whole texts.

Equal sets are one candidate; their rows come back through the membership table at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm import postings as P, shingles as S
from millrace.session import is_blank, written

#: 32-bit lanes of a bitmap.
LANES = 4
#: Code of a missing shingle on a path.
END = 0xFFFF
#: Columns of a posting: token, ref (two parts), size of the set, place of the token in it, path, bitmap of what follows.
KINDS = [(np.uint32, 1), (np.uint32, 1), (np.uint8, 1), (np.uint32, 1), (np.uint32, 1), (np.uint16, 1), (np.uint16, 1), (np.uint32, LANES)]
_SEEN = 1_000_000


def likeness_text(title: Column, description: Column) -> Column:
    """Title, a blank and description; null where the description is blank, so the row takes no part."""
    return F.when(~is_blank(description), F.concat(F.coalesce(title, F.lit("")), F.lit(" "), description))


def needed(t: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common shingles that sets of these sizes need."""
    return np.ceil(t / (1 + t) * (x + y) - P.EPS).astype(np.int64)


def shingle_counts(texts: DataFrame, width: int, total: int) -> np.ndarray:
    def tokens(batch: pa.RecordBatch) -> np.ndarray:
        flat, n, _ = S.plain_hashes(P.texts_of(batch, "words"))
        return S.shingle_sets(flat, n, width)[0]

    return P.counted(texts.select("words"), tokens, total)


def post_sets(texts: DataFrame, width: int, t: float, table: np.ndarray, n_parts: int) -> DataFrame:
    """part, blob: the entries of each set of texts (ref, words), spread over partitions by their root shingle. A posting takes the same bytes whatever n_parts."""
    given = texts.sparkSession.sparkContext.broadcast(table)  # 32 MB at most

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = given.value
        seen: set[tuple[int, int]] = set()  # sets that this task has entered: copies of one text are entered once
        for batch in batches:
            ids = list(zip(P.texts_of(batch, "s1"), P.texts_of(batch, "s2")))
            if len(seen) > _SEEN:
                seen.clear()
            new = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
            batch = batch.take(pa.array(new, pa.int64()))
            n = len(new)
            flat, n_words, _ = S.plain_hashes(P.texts_of(batch, "words"))
            ref = np.array(P.texts_of(batch, "ref"), np.int64)
            h, doc = S.shingle_sets(flat, n_words, width)
            size = np.bincount(doc, minlength=n)
            step = P.steps_of(steps, h)
            order = np.lexsort((h, step, doc))
            h, doc, step = h[order], doc[order], step[order]
            pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            bits = S.rest_bitmaps(h, np.cumsum(size)[doc], LANES)
            # codes keep the global order; equal ones may stand for different shingles
            code = np.append((step.astype(np.uint16) << np.uint16(8)) | (h >> np.uint64(56)).astype(np.uint16), [END, END]).astype(np.uint16)
            own = np.append(doc, [-1, -1])
            path = [np.where(own[k : len(h) + k] == doc, code[k : len(h) + k], END).astype(np.uint16) for k in (1, 2)]
            prefix = size - np.ceil(t * size - P.EPS).astype(np.int64) + 1
            # a shingle that one row holds leads to no other
            use = (pos < prefix[doc]) & (step > 0)
            h, doc, pos, bits, path, blocks = h[use], doc[use], pos[use], bits[use], [p[use] for p in path], P.blocks_of(step[use])
            token = S.mix(h)
            if (blocks > 1).any():
                mine = (ref[doc] % blocks).astype(np.int64)
                i, other = P.ranges(np.zeros(len(blocks), np.int64), blocks)
                low, high = np.minimum(mine[i], other).astype(np.uint64), np.maximum(mine[i], other).astype(np.uint64)
                token = np.where(blocks[i] > 1, S.mix(token[i] + S.mix((low << np.uint64(32)) | high)), token[i])
                doc, pos, bits, path = doc[i], pos[i], bits[i], [p[i] for p in path]
            part, token = ((token & np.uint64(0x7FFFFFFF)) % np.uint64(n_parts)).astype(np.int64), (token >> np.uint64(32)).astype(np.uint32)
            columns = [token, *P.refs_packed(ref[doc]), size[doc].astype(np.uint32), pos.astype(np.uint32), *path, bits]
            yield from P.spread(part, n_parts, np.argsort(token, kind="stable"), columns)

    return texts.select("ref", "s1", "s2", "words").mapInArrow(post, "part int, blob binary")


class Level:
    """Nodes of one depth: begin and end of what lies below them, the smallest and largest set, the most that remains."""

    def __init__(self, starts: np.ndarray, end: int, size: np.ndarray, rest: np.ndarray):
        self.begin, self.end = starts, np.append(starts[1:], end)
        self.low, self.high = np.minimum.reduceat(size, starts), np.maximum.reduceat(size, starts)
        self.rest = np.maximum.reduceat(rest, starts)

    def open(self, x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
        """Pairs of nodes with sets of fitting sizes below."""
        return (self.high[x] >= t * self.low[y] - P.EPS) & (self.high[y] >= t * self.low[x] - P.EPS)


def _rest_bound(common: np.ndarray, loose: int, x: np.ndarray, y: np.ndarray, last_x: np.ndarray, last_y: np.ndarray) -> np.ndarray:
    """The most shingles two paths can share: what they share so far and what remains.

    The path with the smaller last shingle has no more to give but what remains below it; shingles of the other one
    that aren't matched yet (``loose`` less the common ones) may still be. Equal codes may hide either order.
    """
    left = np.maximum(loose - common, 0)
    small, large = np.minimum(x, y), np.maximum(x, y)
    either = np.minimum(large, small + left)
    rest = np.where(last_x < last_y, np.minimum(x, y + left), np.where(last_x > last_y, np.minimum(y, x + left), either))
    return 1 + common + rest


def _below(level: Level, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of what lies below pairs of nodes, a bounded number at a time; for a node with itself each pair once."""
    rows = level.end[x] - level.begin[x]
    for lo, hi in P.slices_of(rows):
        k, i = P.ranges(level.begin[x[lo:hi]], rows[lo:hi])
        k += lo
        same = x[k] == y[k]
        start = np.where(same, i, level.begin[y[k]])
        counts = level.end[y[k]] - start
        for a, b in P.slices_of(counts):
            r, j = P.ranges(start[a:b], counts[a:b])
            yield i[r + a], j


def traverse(token: np.ndarray, ref: np.ndarray, size: np.ndarray, pos: np.ndarray, y1: np.ndarray, y2: np.ndarray, bits: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of refs of the sets in the subtrees of a partition that may be alike."""
    order = np.lexsort((ref, size, y2, y1, token))
    token, ref, size, pos, y1, y2, bits = token[order], ref[order], size[order].astype(np.int64), pos[order].astype(np.int64), y1[order].astype(np.int64), y2[order].astype(np.int64), bits[order]
    once = np.ones(len(token), bool)
    once[1:] = (token[1:] != token[:-1]) | (ref[1:] != ref[:-1]) | (size[1:] != size[:-1]) | (bits[1:] != bits[:-1]).any(1)
    token, ref, size, pos, y1, y2, bits = (c[once] for c in (token, ref, size, pos, y1, y2, bits))
    if len(token) < 2:
        return
    new0 = np.concatenate(([True], token[1:] != token[:-1]))
    new1 = new0 | np.concatenate(([True], y1[1:] != y1[:-1]))
    new2 = new1 | np.concatenate(([True], y2[1:] != y2[:-1]))
    leaf_at, mid_at = np.flatnonzero(new2), np.flatnonzero(new1)
    leaves = Level(leaf_at, len(token), size, np.maximum(size - pos - 3, 0))
    mids = Level(mid_at, len(token), size, np.maximum(size - pos - 2, 0))
    mids_low, mids_rest = mids.low, mids.rest
    c1, l1, l2 = y1[mid_at], y1[leaf_at], y2[leaf_at]
    # children of a middle node are leaves
    to_leaf = np.cumsum(new2) - 1
    mids.begin, mids.end = to_leaf[mids.begin], to_leaf[mids.end - 1] + 1
    root_end = np.append(np.flatnonzero(new0[mid_at])[1:], len(mid_at))[np.cumsum(new0[mid_at]) - 1]
    i = np.arange(len(mid_at))
    counts = root_end - i
    for lo, hi in P.slices_of(counts):
        r, y = P.ranges(i[lo:hi], counts[lo:hi])
        x = r + lo
        ok = mids.open(x, y, t)
        x, y = x[ok], y[ok]
        most = _rest_bound((c1[x] == c1[y]).astype(np.int64), 1, mids_rest[x], mids_rest[y], c1[x], c1[y])
        ok = most >= needed(t, mids_low[x], mids_low[y])
        for u, v in _below(mids, x[ok], y[ok]):
            ok = leaves.open(u, v, t)
            u, v = u[ok], v[ok]
            a, b, c, d = l1[u], l2[u], l1[v], l2[v]
            common = np.minimum((a == c).astype(np.int64) + (b == d) + (a == d) + (b == c), 2)
            most = _rest_bound(common, 2, leaves.rest[u], leaves.rest[v], b, d)
            ok = most >= needed(t, leaves.low[u], leaves.low[v])
            for p, q in _below(leaves, u[ok], v[ok]):
                n, m = size[p], size[q]
                least = needed(t, n, m)
                ok = (p != q) & (least <= np.minimum(n, m)) & (np.minimum(n - pos[p], m - pos[q]) >= least)
                p, q, apart = p[ok], q[ok], (n + m - 2 * least - pos[p] - pos[q])[ok]
                differ = np.zeros(len(p), np.int64)
                for k in range(bits.shape[1]):
                    differ += np.bitwise_count(bits[p, k] ^ bits[q, k])
                ok = differ <= apart
                yield ref[p[ok]], ref[q[ok]]


def candidates(posted: DataFrame, t: float, n_parts: int) -> DataFrame:
    """a, b: refs of sets that may be alike, each pair once, the smaller first."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition holds PER_PARTITION postings or so, and nothing of another one
        held = [P.unpacked(blob, KINDS) for batch in batches for blob in batch.column(1).to_pylist()]
        if not held:
            return
        token, low, high, size, pos, y1, y2, bits = (np.concatenate(c) for c in zip(*held))
        ref = low.astype(np.int64) | high.astype(np.int64) << 32
        found: list[np.ndarray] = []

        def merged() -> np.ndarray:
            return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

        for x, y in traverse(token, ref, size, pos, y1, y2, bits, t):
            if len(x):
                found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
            if sum(map(len, found)) > 4 * P.CHUNK:
                pairs = merged()
                found = [pairs]
                if len(pairs) > 2 * P.CHUNK:
                    found = []
                    yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})
        pairs = merged()
        yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return posted.repartitionById(n_parts, F.col("part")).mapInArrow(meet, "a long, b long").dropDuplicates()


def similar_sets(texts: DataFrame, t: float = 0.8, width: int = 5) -> DataFrame:
    """a1, a2, b1, b2: ids of all pairs of different shingle sets of prepared texts with likeness of at least t, each pair once."""
    total = texts.agg(F.sum("n")).first()[0] or 0
    table = shingle_counts(texts, width, total)
    parts = P.n_partitions(texts, int(total * (1 - t) * 1.2))
    pairs = candidates(post_sets(texts, width, t, table, parts), t, parts)
    return P.verified(pairs, texts, t, width)


def near_duplicate_rows(df: DataFrame, key: str, text: str, t: float = 0.8, width: int = 5) -> DataFrame:
    """<key>_a, <key>_b: all pairs of rows whose texts' shingle sets have a likeness of at least t, the smaller key first.

    Null texts and texts without words take no part; exact repeats are pairs too. Other columns of df are ignored. The
    texts are read and normalised once, and written to the shared folder.
    """
    texts = written(P.prepared(df.select(F.col(key), F.col(text)), text, width, [key]))
    return P.expanded(similar_sets(texts, t, width), texts.select(key, "s1", "s2"), key, F.lit(True))
