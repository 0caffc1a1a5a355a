"""Problem 9: containers of fixed capacity filled with documents, none divided unless it alone exceeds the capacity.

Best-two-fit. A container is filled greedily with the largest document that fits; then its smallest document is
replaced by two unpacked ones whose sizes fit the expanded gap more tightly, as long as that leaves less room. Each
partition fills containers from its own documents, so texts don't move. Containers that stay open (filled below
CLOSED, mostly the last ones of a partition) are emptied again: the sizes of their documents meet those of other
partitions and fill containers together, so the room left doesn't depend on how the documents are partitioned.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millrace.llm.bpe import encoder, shipped, slices, vocabulary_path
from millrace.session import written

#: Share of the capacity from which a container stays as its partition filled it.
CLOSED = 0.995
#: Left documents that one task packs.
TOGETHER = 2_000_000


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of the sizes (each from 1 to capacity) in each container. Equal sizes go in reverse order of position."""
    stock: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        stock.setdefault(s, []).append(i)
    present = sorted(stock)

    def take(s: int) -> int:
        i = stock[s].pop()
        if not stock[s]:
            del present[bisect_left(present, s)]
        return i

    def put(s: int, i: int) -> None:
        if not stock[s]:
            insort(present, s)
        stock[s].append(i)

    bins = []
    while present:
        room, held = capacity, []
        while present and present[0] <= room:
            s = present[bisect_right(present, room) - 1]
            held.append((s, take(s)))
            room -= s
        while room and len(present) and 2 * present[0] <= room + held[-1][0]:
            small, gap = held[-1][0], room + held[-1][0]
            have = np.array(present)
            x = have[have * 2 <= gap]
            y = have[np.searchsorted(have, gap - x, side="right") - 1]
            # two documents of one size need two in stock
            twice = (x == y) & np.array([len(stock[int(v)]) < 2 for v in x])
            total = np.where(twice, 0, x + y)
            k = int(total.argmax())
            if total[k] <= small:
                break
            put(*held.pop())
            for s in sorted((int(x[k]), int(y[k])), reverse=True):
                held.append((s, take(s)))
            held.sort(reverse=True)
            room = gap - int(total[k])
        bins.append([i for _, i in held])
    return bins


ROW = {"budget_id": pa.int32(), "container_id": pa.int64(), "k": None, "piece_no": pa.int32(), "token_start": pa.int32(), "n_tokens": pa.int32(), "open": pa.bool_()}


def _batches(columns: list[list], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_pydict({n: pa.array(c[a : a + 50_000], t or kind) for (n, t), c in zip(ROW.items(), columns)})


def _numbered() -> int:
    task = TaskContext.get()
    return (task.partitionId() if task else 0) << 36


def pack_corpus(df: DataFrame, key: str, text: str, budgets: list[tuple[int, str, int]]) -> DataFrame:
    """budget_id, container_id, <key>, piece_no, token_start, n_tokens: where each document lies, for (budget, tokenizer, capacity) of each budget.

    A document over the capacity is divided: pieces of just the capacity fill containers of their own, the rest is
    packed like a document. Null and empty texts take no room and come out with n_tokens 0 in container -1. Repeated
    rows are packed as often as they stand. What the partitions fill is written to the shared folder, a few numbers a row.
    """
    kind = df.schema[key].dataType.simpleString()
    vocabularies = {name: shipped(df, vocabulary_path(name)) for name in {b[1] for b in budgets}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        base = _numbered()
        keys: list[pa.Array] = []
        sizes: dict[str, list[np.ndarray]] = {n: [] for n in vocabularies}
        for batch in batches:
            for part in slices(batch, "t"):
                keys.append(part.column(0))
                texts = part.column(1).to_pylist()
                for n, vocabulary in vocabularies.items():
                    e = encoder(vocabulary)
                    known = e.words
                    sizes[n].append(np.array([sum(map(len, map(known.__getitem__, ws))) for ws in e.encode_words(texts)], np.int64))
        if not keys:
            return
        ids = pa.concat_arrays(keys)
        for budget, name, capacity in budgets:
            size = np.concatenate(sizes[name])
            whole = np.maximum(size - 1, 0) // capacity
            rows = []  # container, document, piece, start, tokens, open
            c = base
            for d in np.flatnonzero(whole).tolist():
                for p in range(int(whole[d])):
                    rows.append((c, d, p + 1, p * capacity, capacity, False))
                    c += 1
            of = np.flatnonzero(size)
            start = (whole * capacity)[of].tolist()
            items, of = (size - whole * capacity)[of].tolist(), of.tolist()
            for held in best_two_fit(items, capacity):
                opened = sum(items[i] for i in held) < CLOSED * capacity
                rows.extend((c, of[i], start[i] // capacity + 1, start[i], items[i], opened) for i in held)
                c += 1
            rows.extend((-1, d, 1, 0, 0, False) for d in np.flatnonzero(size == 0).tolist())
            if rows:
                cs, ds, *rest = map(list, zip(*rows))
                yield from _batches([[budget] * len(cs), cs, ids.take(pa.array(ds)).to_pylist(), *rest], ids.type)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = _numbered() + (1 << 60)
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.concat_tables(held).combine_chunks()
        budget_of, sizes = rows.column("budget_id").to_numpy(), rows.column("n_tokens").to_numpy()
        for budget, _, capacity in budgets:
            at = np.flatnonzero(budget_of == budget)
            container = np.zeros(len(at), np.int64)
            for held_items in best_two_fit(sizes[at].tolist(), capacity):
                container[held_items] = base
                base += 1
            part = rows.take(pa.array(at))
            part = part.set_column(part.schema.get_field_index("container_id"), "container_id", pa.array(container))
            yield from part.select(list(ROW)).to_batches(50_000)

    schema = f"budget_id int, container_id long, k {kind}, piece_no int, token_start int, n_tokens int, open boolean"
    filled = written(df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema))
    left = filled.where("open")
    tasks = max(1, -(-left.count() // TOGETHER))
    both = filled.where("not open").unionByName(left.repartition(tasks).mapInArrow(again, schema))
    return both.drop("open").withColumnRenamed("k", key)


def fill_report(packed: DataFrame, budgets: list[tuple[int, str, int]]) -> DataFrame:
    """budget_id, containers, tokens, least, fill: how many containers are used, and the share of their room that is."""
    capacity = F.coalesce(*[F.when(F.col("budget_id") == b, F.lit(c)) for b, _, c in budgets], F.lit(0)).cast("long")
    used = packed.where("n_tokens > 0").groupBy("budget_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return used.select("budget_id", "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), F.round(F.col("tokens") / (F.col("containers") * capacity), 4).alias("fill"))
