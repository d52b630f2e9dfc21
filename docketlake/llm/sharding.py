"""Sharding of indivisible groups by Karmarkar-Karp differencing.

Groups (equal texts) start as partial partitions with one filled shard. Differencing repeatedly
takes the two partial partitions with the largest spread and adds them in opposite order. Up to
``CHUNK`` groups are differenced in one task. More are split: groups above 1/``HEAVY`` of a chunk's
mean shard load are differenced first, among themselves (by the same rule if they are too many for
a task). Their loads, which no small group has evened out yet, enter every chunk of the other groups
as one more partial partition, each chunk taking the share of its bytes, so the small groups of all
chunks fill up the shards beside large ones. The last chunk is differenced against the exact loads
of everything else and evens out what the others left. No task sees more than a chunk.

Defined cases: a null text has no bytes (size 8) and falls into the group of empty texts; a null
doc_id is placed like any other; an empty table gives an empty result; repeated rows get slots of
their own; extra columns are ignored. A group is never divided, so a group above 1/shards of all
bytes bounds the balance that any method can reach.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_rank, table, text_or_empty, written

SHARDS = 24
CHUNK = 20_000
HEAVY = 16


def difference(loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of ``loads``, one column per shard).

    Returns ``place``, where ``place[i, j]`` is the final shard of partition i's shard j, and the
    final loads. Merging adds the largest shard of one to the smallest of the other.
    """
    n, k = loads.shape
    order = np.argsort(loads, axis=1, kind="stable")
    heap = []
    for i in range(n):
        row = loads[i, order[i]]
        heap.append((-int(row[-1] - row[0]), i, row))
    heapq.heapify(heap)
    # a merged partition's shard s holds the shards perm[s] of its left and right parents
    parents: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        total = x + y[::-1]
        perm = np.argsort(total, kind="stable")
        total = total[perm]
        parents.append((a, b, perm, k - 1 - perm))
        heapq.heappush(heap, (-int(total[-1] - total[0]), n + len(parents) - 1, total))
    final = heap[0][2] if heap else np.zeros(k, np.int64)
    where = np.empty((n + len(parents), k), np.int16)  # where[p, s]: final shard of p's s-th smallest
    if n:
        where[n + len(parents) - 1] = np.arange(k)
    for t in range(len(parents) - 1, -1, -1):
        a, b, left, right = parents[t]
        where[a][left] = where[n + t]
        where[b][right] = where[n + t]
    place = np.empty((n, k), np.int16)
    np.put_along_axis(place, order, where[:n], axis=1)
    return place, final


def _fill(leaf: np.ndarray, small: int | None, key: str, shards: int):
    """Differences a chunk's groups together with ``leaf``, or with the chunk's share of it by bytes.

    The leaf's shards keep their numbers; which of equal ones is first differs from chunk to chunk.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", key], ascending=False)
        share = 1.0 if small is None else float(pdf["size"].sum()) / small
        names = np.random.default_rng(int(pdf["chunk"].iloc[0])).permutation(shards)
        loads = np.zeros((len(pdf) + 1, shards), np.int64)
        loads[0] = leaf[names] if small is None else np.floor(leaf[names] * share)
        loads[1:, 0] = pdf["size"]
        place, _ = difference(loads)
        back = np.empty(shards, np.int64)
        back[place[0]] = names
        return pd.DataFrame({key: pdf[key], "size": pdf["size"], "shard": back[place[1:, 0]].astype(np.int32)})

    return run


def _loads(placed: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros(shards, np.int64)
    for row in placed.groupBy("shard").agg(F.sum("size").alias("size")).collect():  # one row per shard
        out[row.shard] = row["size"]
    return out


def assign_groups(sizes: DataFrame, key: str, shards: int = SHARDS, chunk: int = CHUNK) -> DataFrame:
    """(key, shard) for a table of distinct keys with ``size``."""
    return _assign(sizes.select(key, F.col("size").cast("long").alias("size")), key, shards, chunk).select(key, "shard")


def _assign(sizes: DataFrame, key: str, shards: int, chunk: int) -> DataFrame:
    all_ = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    chunks = -(-all_.n // max(chunk, 2 * shards * HEAVY))  # so that heavy groups are fewer than half
    made = f"{key} {dict(sizes.dtypes)[key]}, size long, shard int"
    dealt = sizes.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(max(1, chunks))))
    if chunks <= 1:
        return dealt.groupBy("chunk").applyInPandas(_fill(np.zeros(shards, np.int64), None, key, shards), made)
    limit = all_.bytes // (chunks * shards * HEAVY)
    heavy = written(_assign(written(sizes.where(F.col("size") > limit), "heavy"), key, shards, chunk), "heavy_placed")
    loads = _loads(heavy, shards)
    dealt = dealt.where(F.col("size") <= limit)
    fill = _fill(loads, all_.bytes - int(loads.sum()), key, shards)
    most = written(dealt.where("chunk > 0").groupBy("chunk").applyInPandas(fill, made), "chunks")
    loads = loads + _loads(most, shards)
    last = dealt.where("chunk = 0").groupBy("chunk").applyInPandas(_fill(loads, None, key, shards), made)
    return heavy.unionAll(most).unionAll(last)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"),
    )
    rows = written(rows, "sizes")  # the texts are read and hashed once
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    placed = rows.join(assign_groups(groups, "digest", shards), "digest")
    ranked = spread_rank(placed, ["shard"], ["doc_id", "text_crc32"], "slot", rows.count())
    return ranked.select(
        "doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
