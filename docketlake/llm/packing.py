"""Packing into optimal length buckets.

A dynamic program over the exact histogram of document lengths (whole corpus) chooses the bucket
boundaries with the least padding; the histogram has at most sqrt(2 x words of the corpus) rows, as
different lengths add up to no more than all words. Inside a bucket, documents fill batches of at most
``budget`` tokens, each padded to the bucket's length.

Defined cases: a null or empty text has length 0 and takes a place of length 0 in the first bucket
(its boundary is at least 1); a document longer than the budget forms a batch alone; an empty table
gives an empty result; repeated rows take places of their own; a null doc_id is packed like others;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_rank, table, written
from .wordblocks import word_counts

BUCKETS = 16
BUDGET = 16_384


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words of the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array(word_counts(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long")


def boundaries(tops: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket tops with the least total padding, by dynamic programming over the histogram.

    A bucket of lengths i+1..j costs a line in its top: slope -total[i], which falls with i. Tops
    grow with j, so each round walks once along the lower hull of the lines.
    """
    order = np.argsort(tops)
    tops, counts = tops[order].tolist(), counts[order].tolist()
    m = len(tops)
    if not m:
        return []
    total, weight = [0], [0]
    for top, n in zip(tops, counts):
        total.append(total[-1] + n)
        weight.append(weight[-1] + n * top)
    best: list[int | None] = [0, *[None] * m]
    cuts = []
    for _ in range(min(buckets, m)):
        new, cut = list(best), list(range(m + 1))
        hull: list[tuple[int, int, int]] = []  # slope, value at 0, i
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                slope, base = -total[j - 1], best[j - 1] + weight[j - 1]
                while len(hull) - at >= 2:
                    (s1, b1, _), (s2, b2, _) = hull[-2:]
                    if (base - b1) * (s1 - s2) > (b2 - b1) * (s1 - slope):
                        break
                    hull.pop()
                hull.append((slope, base, j - 1))
            top = tops[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * top + hull[at + 1][1] < hull[at][0] * top + hull[at][1]:
                at += 1
            cost = hull[at][0] * top + hull[at][1] + top * total[j] - weight[j]
            if new[j] is None or cost < new[j]:
                new[j], cut[j] = cost, hull[at][2]
        best = new
        cuts.append(cut)
    ends, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        if cut[j] != j:
            ends.append(int(tops[j - 1]))
            j = int(cut[j])
    return sorted(ends)


def pack(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_tokens, batch, place) of every row."""
    rows = written(lengths(docs), "lengths")
    # one row per length: at most sqrt(2 x words of the corpus)
    histogram = rows.groupBy(F.greatest("n_tokens", F.lit(1)).alias("top")).agg(F.count(F.lit(1)).alias("n")).collect()
    ends = boundaries(np.array([r.top for r in histogram]), np.array([r.n for r in histogram]), buckets)
    tops = F.array(*[F.lit(e).cast("long") for e in ends])
    rows = rows.withColumn("bucket", F.size(F.filter(tops, lambda top: top < F.col("n_tokens"))))
    ranked = spread_rank(rows, ["bucket"], ["doc_id", "n_tokens"], "rank", sum(r.n for r in histogram))
    ranked = ranked.withColumn("padded_tokens", F.get(tops, F.col("bucket")))
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_tokens"))).cast("long")
    return ranked.select(
        "doc_id", "n_tokens", "bucket", "padded_tokens", F.floor(F.col("rank") / size).alias("batch"), F.pmod("rank", size).alias("place")
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
