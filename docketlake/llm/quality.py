"""Quality classification by hierarchical empirical Bayes.

A document classifier (two logistic heads, good writing and toxicity, over binned style measures
and selected hashed words, fitted on at most ``SAMPLE`` labelled rows) gives each document's
evidence. Sums of that evidence per host (``source``) and per path (host and ``lang``) over all
documents give posteriors: a path is shrunk toward its host, a host toward the global prior, with
strengths estimated by the method of moments. A document's log odds are corrected by its path's.

Defined cases: a null or empty text is scored by its style measures like any other; null hosts and
languages form a group of their own; without labels, or with labels of one class only, that head is
neutral and rejects nothing; labels of unknown documents and rows with null labels are ignored, of
several labels of one document the largest counts, of several texts of one labelled doc_id the one with
the smallest hash is learned; an empty table gives an empty result; equal rows
get equal scores, and rows that share a doc_id but not the text are judged apart; a null doc_id is
scored and dropped like any other; extra columns are ignored (or carried by ``keep_good``), whatever
their names; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, text_tag, written
from .decontamination import _fold
from .wordblocks import Block, blocks, hash_block, text_array

SAMPLE = 8000
BUCKET_BITS = 18
WORDS_KEPT = 400
LEAST_Z = 6.0
BINS = 12
MARKS = "#$%&*|!.,@=/<>"
_KIND = np.full(256, len(MARKS) + 4)
for _i, _mark in enumerate(MARKS):
    _KIND[ord(_mark)] = _i
_KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[10] = len(MARKS) + np.arange(4)


def style(block: Block, at: np.ndarray) -> np.ndarray:
    """Measures of each row: shares of byte kinds, word shape, repetition, length."""
    rows = block.rows
    sizes = np.maximum(np.diff(at), 1).astype(float)
    words = np.maximum(block.counts(), 1).astype(float)
    data, owner = block.data, block.word_rows()

    kinds = len(MARKS) + 5  # the last kind is any other byte
    place = np.repeat(np.arange(rows) * kinds, np.diff(at)) + _KIND[data]
    shares = np.bincount(place, minlength=rows * kinds).reshape(rows, kinds) / sizes[:, None]
    by_row = lambda x: np.bincount(owner, weights=x, minlength=rows) / words
    cols = list(shares[:, :-1].T)
    lengths = block.ends - block.starts
    tail = data[block.ends - 1] if len(data) else np.zeros(0, np.uint8)
    symbol = ~(((tail >= 97) & (tail <= 122)) | ((tail >= 65) & (tail <= 90)) | (tail >= 128) | ((tail >= 48) & (tail <= 57)))
    low = np.uint64(64 - max(rows - 1, 1).bit_length())
    key = np.sort((owner.astype(np.uint64) << low) | (block.hashes & ((np.uint64(1) << low) - np.uint64(1))))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[first] >> low).astype(np.int64), minlength=rows) / words
    cols += [by_row(lengths), by_row(symbol), by_row(lengths == 1), distinct, np.log1p(words)]
    return np.stack(cols, axis=1)


def _row_bytes(block: Block, column: pa.Array) -> np.ndarray:
    lengths = pyarrow.compute.binary_length(text_array(column.slice(block.first_row, block.rows))).to_numpy()
    return np.concatenate([[0], np.cumsum(lengths)])


def _letters(block: Block) -> np.ndarray:
    """Bucket of each word."""
    return (block.hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Head:
    """One logistic output; ``bias`` alone where it was not fitted."""

    bias: float = 0.0
    edges: list = field(default_factory=list)
    style_weights: list = field(default_factory=list)
    word_weights: np.ndarray | None = None

    def logit(self, measures: np.ndarray, rows: int, owner: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        out = np.full(rows, self.bias)
        for j, (edge, w) in enumerate(zip(self.edges, self.style_weights)):
            out += w[np.searchsorted(edge, measures[:, j], "right")]
        if self.word_weights is not None:
            key = owner * (1 << BUCKET_BITS) + buckets
            key = np.unique(key[self.word_weights[buckets] != 0])
            out += np.bincount(key >> BUCKET_BITS, weights=self.word_weights[key & ((1 << BUCKET_BITS) - 1)], minlength=rows)
        return out


def choose_words(counts: DataFrame, n: int, side: str) -> np.ndarray:
    """Word buckets that tell the documents of a label apart, from their counts (word, n, quality, toxic)."""
    positive = f"{side}_all"
    row = counts.select(positive).first()
    if row is None or row[0] in (0, n):
        return np.zeros(0, np.int64)
    yes, no = F.lit(float(row[0])), F.lit(float(n - row[0]))
    p, q, both = F.col(side) / yes, (F.col("n") - F.col(side)) / no, F.col("n") / F.lit(float(n))
    z = F.abs(p - q) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * (1 / yes + 1 / no))
    top = counts.where("n >= 8").select("word", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "word").limit(WORDS_KEPT)
    return np.array([r.word for r in top.collect()], np.int64)  # at most WORDS_KEPT rows


def fit_head(measures: np.ndarray, words: list[np.ndarray], label: np.ndarray, chosen: np.ndarray, neutral: float, steps: int = 300) -> Head:
    """Ridge logistic regression over binned measures and the chosen words, by gradient steps with per-weight rates."""
    n = len(label)
    positive = label.sum()
    if positive in (0, n):
        return Head(bias=neutral)
    column = np.full(1 << BUCKET_BITS, -1)
    column[chosen] = np.arange(len(chosen))
    edges = [np.unique(np.quantile(measures[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(measures.shape[1])]
    sizes = [len(e) + 1 for e in edges]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    x = np.zeros((n, int(starts[-1]) + len(chosen)), np.float32)
    for j, e in enumerate(edges):
        x[np.arange(n), starts[j] + np.searchsorted(e, measures[:, j], "right")] = 1
    for i, w in enumerate(words):
        c = column[w]
        x[i, starts[-1] + c[c >= 0]] = 1
    weights, bias, rate = np.zeros(x.shape[1], np.float32), float(np.log(positive / (n - positive))), np.full(x.shape[1], 1e-6, np.float32)
    for _ in range(steps):
        error = (1 / (1 + np.exp(-(x @ weights + bias))) - label).astype(np.float32)  # keeps the products in single precision
        gradient = (x.T @ error + 1.0 * weights) / n
        rate += gradient**2
        weights -= 0.2 * gradient / np.sqrt(rate)
        bias -= 0.5 * float(error.mean())
    table_ = np.zeros(1 << BUCKET_BITS)
    table_[chosen] = weights[starts[-1] :]
    return Head(bias, edges, [weights[starts[j] : starts[j + 1]].astype(float) for j in range(len(edges))], table_)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        for block in blocks(text, lower=False):
            low = next(_lower(text, block))
            measures = style(block, _row_bytes(block, text))
            owner, buckets = low.word_rows(), _letters(low)
            key = np.unique(owner * (1 << BUCKET_BITS) + buckets)
            cut = np.searchsorted(key >> BUCKET_BITS, np.arange(block.rows + 1))
            ids = (key & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
            part = slice(block.first_row, block.first_row + block.rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("quality").to_numpy(zero_copy_only=False)[part]), pa.array(batch.column("toxic").to_numpy(zero_copy_only=False)[part]),
                    pa.array(list(measures), pa.list_(pa.float64())), pa.array([ids[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.list_(pa.int32())),
                ],
                ["quality", "toxic", "measures", "words"],
            )


def _lower(text: pa.Array, block: Block) -> Iterator[Block]:
    """The same rows, hashed without regard to case and to signs around a word."""
    at = _row_bytes(block, text)
    data, offsets = _fold(block.data, at)
    yield hash_block(data, offsets, block.first_row, lower=False)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Head, Head]:
    """Heads (good writing, toxic) from at most ``sample`` labelled documents, taken by hash order.

    Words are counted and chosen in Spark; the driver gets the measures of the sample and which of
    the chosen words each document has.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels of absent documents take no place
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    rows = rows.groupBy("doc_id", "quality", "toxic").agg(F.min(F.struct(text_tag().alias("tag"), "text")).alias("d")).select("doc_id", "quality", "toxic", "d.text")
    made = written(rows.select("text", "quality", "toxic").mapInArrow(_features, "quality int, toxic int, measures array<double>, words array<int>"), "features")
    sums = made.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic")).first()
    if not sums.n:
        return Head(bias=4.0), Head(bias=-4.0)
    counts = made.select(F.explode("words").alias("word"), "quality", "toxic").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))
    counts = written(counts.withColumns({f"{c}_all": F.lit(sums[c]) for c in ("quality", "toxic")}), "words")
    lists = [choose_words(counts, sums.n, side) for side in ("quality", "toxic")]
    wanted = F.array(*[F.lit(int(w)) for w in np.unique(np.concatenate(lists))]).cast("array<int>")
    got = made.select("quality", "toxic", "measures", F.array_intersect("words", wanted).alias("words")).toArrow()  # at most `sample` x 2 WORDS_KEPT words
    measures = np.array(got.column("measures").to_pylist(), float)
    words = [np.asarray(w, np.int64) for w in got.column("words").to_pylist()]
    good, toxic = (got.column(c).to_numpy().astype(float) for c in ("quality", "toxic"))
    return fit_head(measures, words, good, lists[0], 4.0), fit_head(measures, words, toxic, lists[1], -4.0)


def evidence(docs: DataFrame, heads: tuple[Head, Head]) -> DataFrame:
    """(doc_id, tag, host, path, p_document): probability of good and harmless text by the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, toxic = shared.value
        for batch in batches:
            text, out = batch.column("text"), np.zeros(batch.num_rows)
            for block in blocks(text, lower=False):
                low = next(_lower(text, block))
                measures, owner, buckets = style(block, _row_bytes(block, text)), low.word_rows(), _letters(low)
                g = good.logit(measures, block.rows, owner, buckets)
                t = toxic.logit(measures, block.rows, owner, buckets)
                out[block.first_row : block.first_row + block.rows] = 1 / (1 + np.exp(-np.clip(g, -30, 30))) / (1 + np.exp(np.clip(t, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "tag", "host", "path")), pa.array(out)], ["doc_id", "tag", "host", "path", "p_document"])

    names = {c.lower() for c in docs.columns}
    host = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in names else F.lit("")
    path = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in names else F.lit("")
    rows = docs.select("doc_id", text_tag().alias("tag"), "text", host.alias("host"), path.alias("path"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, tag long, host string, path string, p_document double")


def _strength(groups: DataFrame, of: Column, mean: Column, n: Column) -> float:
    """Prior sample size by moments: within against between variance of the group means."""
    row = groups.agg(
        F.sum(n).alias("n"), F.sum(n * F.pow(of - mean, 2)).alias("between"), F.sum(n * mean * (1 - mean)).alias("within"), F.count(F.lit(1)).alias("k")
    ).first()
    if not row.n or row.k < 2:
        return 100.0
    spread = max(row.between / row.n - row.within / row.n * row.k / row.n, 1e-6)
    return float(min(1e4, max(2.0, row.within / row.n / spread)))


def posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, p_host, p_path) and the global mean."""
    paths = written(scored.groupBy("host", "path").agg(F.sum("p_document").alias("s"), F.count(F.lit(1)).alias("n")), "paths")
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    overall = min(max((total.s or 0.0) / total.n, 1e-4), 1 - 1e-4) if total.n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    k = _strength(hosts, F.col("hs") / F.col("hn"), F.lit(overall), F.col("hn"))
    hosts = hosts.select("host", ((F.col("hs") + k * overall) / (F.col("hn") + k)).alias("p_host"))
    both = written(paths.join(hosts, "host"), "hosts")
    k = _strength(both, F.col("s") / F.col("n"), F.col("p_host"), F.col("n"))
    return both.select("host", "path", "p_host", ((F.col("s") + k * F.col("p_host")) / (F.col("n") + k)).alias("p_path")), overall


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """(doc_id, tag, p_document, p_host, p_path, p_good, kept) of every row."""
    scored = written(evidence(docs, fit(docs, labels, sample)), "evidence")
    sites, overall = posteriors(scored)
    logit = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    odds = logit(F.col("p_document")) + logit(F.col("p_path")) - logit(F.lit(overall))
    out = scored.join(sites, ["host", "path"]).withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "tag", "p_document", "p_host", "p_path", "p_good", (F.col("p_good") >= least).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """(doc_id, p_document, p_host, p_path, p_good, kept) of every row."""
    return judged(docs, labels, sample, least).drop("tag")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not rejected, with all their columns.

    Rows with equal id and text on different paths may be judged apart; then all of them stay.
    """
    marks = judged(docs, labels).groupBy("doc_id", "tag").agg(F.max("kept").alias("kept"))
    return dropped(docs, marks.where("not kept").select("doc_id", "tag"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
