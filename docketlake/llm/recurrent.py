"""Keys (hashed shingles) that occur in two different texts or more, found with one narrow shuffle.

Keys that are frequent in some stretch of the corpus are counted first, over all documents, into a
short list that every task gets; they are known to recur and need no shuffle. The other keys are
dealt by key, sorted, and read off group by group.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written
from .wordblocks import Block, blocks

HOT_KEYS = 65_536
HOT_BLOCK = 4 << 20
HOT_IN_BLOCK = 4
COUNTER_BITS = 22
SLICE = 4096


def hot_keys(docs: DataFrame, keys: Callable[[Block], tuple[np.ndarray, np.ndarray]], lower: bool) -> tuple[DataFrame, np.ndarray]:
    """At most HOT_KEYS keys that several rows of one block share: as a table (key), and rarest first.

    A choice of what is treated apart; results do not depend on it. ``keys`` gives (row, key) once
    per row and key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), lower, HOT_BLOCK):
                key, n = np.unique(keys(block)[1], return_counts=True)
                often = n >= HOT_IN_BLOCK
                yield pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often])], ["key", "n"])

    seen = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    table = written(seen.orderBy(F.col("n").desc(), "key").limit(HOT_KEYS), "hot")
    top = table.toArrow()
    keys_, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    return table.select("key"), keys_[np.lexsort((keys_, n))]


def frequency_classes(docs: DataFrame, keys: Callable[[Block], tuple[np.ndarray, np.ndarray]], lower: bool) -> np.ndarray:
    """For each of 2**COUNTER_BITS counters, the bit length of the number of (row, key) pairs it holds.

    A key's counter is given by its upper bits (see ``class_of``). Counted over all documents; a
    counter may hold several keys, so a class is an upper bound. Each task sends its counters in
    slices; a slice is summed as its rows stream by, so memory does not grow with the tasks.
    """
    cells = 1 << COUNTER_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for block in blocks(batch.column("text"), lower, HOT_BLOCK):
                total += np.bincount(_counter(keys(block)[1]), minlength=cells)
        table = total.reshape(-1, SLICE)
        at = np.flatnonzero(table.any(axis=1))
        packed = [zlib.compress(table[i].tobytes(), 1) for i in at.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed, pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                now = np.frombuffer(zlib.decompress(body), np.int64)
                sums[i] = sums[i] + now if i in sums else now
        lengths = [np.frexp(x.astype(np.float64))[1].astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(lengths, pa.binary())], ["slice", "counts"])

    parts = docs.select("text").mapInArrow(count, "slice long, counts binary")
    summed = parts.repartition(partitions(docs.sparkSession), "slice").mapInArrow(add, "slice long, counts binary").toArrow()
    out = np.zeros((cells // SLICE, SLICE), np.uint8)
    for i, body in zip(summed.column("slice").to_pylist(), summed.column("counts").to_pylist()):
        out[i] = np.frombuffer(body, np.uint8)
    return out.reshape(-1)


def _counter(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def class_of(classes: np.ndarray, key: np.ndarray) -> np.ndarray:
    return classes[_counter(key)].astype(np.int64)


def recurring(entries: DataFrame) -> DataFrame:
    """Rows of ``entries`` (key, doc_id, tag, n) whose key occurs with two tags or more.

    Adds ``low`` and ``high``, the smallest and largest doc_id of the key. Made for keys outside
    the hot list; a group may span Arrow batches and is held until it ends.
    """
    names = ["key", "doc_id", "tag", "n"]

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        key, doc, tag, n = np.concatenate(parts, axis=1)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        mixed = np.minimum.reduceat(tag, start) != np.maximum.reduceat(tag, start)
        low, high = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
        pick = np.repeat(mixed, size)
        arrays = [x[pick] for x in (key, doc, tag, n, np.repeat(low, size), np.repeat(high, size))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [*names, "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            now = np.stack([batch.column(c).to_numpy() for c in names])
            if not now.shape[1]:
                continue
            cut = int(np.searchsorted(now[0], now[0, -1]))  # the last group may go on
            if cut:
                yield flush([*held, now[:, :cut]])
                held = [now[:, cut:]]
            elif held and held[0][0, 0] != now[0, 0]:
                yield flush(held)
                held = [now]
            else:
                held.append(now)
        if held:
            yield flush(held)

    dealt = entries.select(*names).repartition(partitions(entries.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, doc_id long, tag long, n long, low long, high long")
