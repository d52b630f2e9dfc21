"""Toxicity by a convolutional text classifier: hashed word embeddings, three filter widths, max pooling, all in numpy.

A word's embedding is the sum of hashed rows for the word and for some of its beginnings and its end, so an
unseen form of a known stem is near it. Filters over one, two and three words are pooled by their
maximum over the whole text, and a logistic layer reads the pooled values. Every labelled document is learned, in whole:
labelled documents are dealt by a hash of their id into units of about ``UNIT``. In each of ``ROUNDS`` rounds every unit
descends from the common network over its own documents, and the changes of all units are averaged (of an
embedding row, over the units that changed it). Changes are summed as integers, so the network depends neither on partitions nor
on the order of sums. The first coordinate of an embedding starts from the log odds of its row, counted over all units. A fifth of the labelled documents is held
back; their outputs, counted by steps of 1 / ``STEPS``, give the map from the network's output to a probability, and a threshold for each
language, drawn toward the common one where there are few toxic documents of that language. Every document is scored in whole.

Defined cases: a null or empty text has no words and gets the score of no evidence; words are runs of letters, digits and bytes
above 127, A-Z as a-z; null and unknown languages have the common threshold; language, source and doc_id are no inputs of
a score; labels that are null or of unknown documents are ignored, of several labels of one document the largest counts,
of several texts of one labelled doc_id the one with the smallest hash is learned; without labels of both kinds every score is the
share of toxic ones (0 without any); an empty table gives an empty result; equal texts get equal
scores; rows with a null doc_id are scored and not learned; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, written
from .wordblocks import _LOWER, _power_table, mix, slices

UNIT = 2000  # labelled documents
ROUNDS = 8
BATCH, BATCH_WORDS = 40, 1 << 16  # of one step: documents, words (one document may exceed it)
BITS = 17
WIDTH = 16  # coordinates of an embedding
FILTERS = 12  # of each width
SPANS = (1, 2, 3)
BEGINNINGS, ENDING = (4, 5, 6), 4
SLICE_BYTES = 1 << 17
ROWS = 2048  # embedding rows that are summed together
SLICES = -(-((1 << BITS) + 1) // ROWS)  # the other weights are one slice more
WEIGHT_SCALE, PAST_SCALE = float(1 << 17), float(1 << 34)
STEPS = 256
PREDICT = 0.7
DRAWN = 20.0  # toxic documents that weigh as much as the common threshold
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_COLUMNS = np.concatenate([[0], np.cumsum([s * FILTERS for s in SPANS])])


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of every word (words, 1 + beginnings + 1) and the bounds of each text in them.

    Each text ends with as many blank words (row 0) as a filter can reach beyond it. A beginning or
    end that is the whole word is blank.
    """
    rows, n, pad = len(offsets) - 1, len(data), max(SPANS) - 1
    solid = _WORD[data]
    start, stop = solid.copy(), solid.copy()
    if n:
        start[1:] &= ~solid[:-1]
        stop[:-1] &= ~solid[1:]
        heads, tails = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
        start[heads], stop[tails] = solid[heads], solid[tails]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _power_table(n)
    summed = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[:n], out=summed[1:])

    def bucket(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        key = mix((summed[b] - summed[a]) * down[a] + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64)))
        return np.where((kind == 0) | (b - a < ends - starts), (key >> np.uint64(64 - BITS)).astype(np.int32) + 1, 0).astype(np.int32)

    parts = [bucket(starts, ends, 0)]
    parts += [bucket(starts, np.minimum(starts + k, ends), k) for k in BEGINNINGS]
    parts.append(bucket(np.maximum(ends - ENDING, starts), ends, 16 + ENDING))
    cuts = np.searchsorted(starts, offsets)
    counts = np.diff(cuts)
    bounds = np.concatenate([[0], np.cumsum(counts + pad)])
    out = np.zeros((int(bounds[-1]), len(parts)), np.int32)
    place = np.arange(len(starts)) + pad * np.repeat(np.arange(rows), counts)
    out[place] = np.stack(parts, axis=1)
    return out, bounds


@dataclass
class Network:
    """Weights, the map of its output to a probability (slope, shift), and thresholds by language."""

    embeddings: np.ndarray
    filters: np.ndarray  # (WIDTH, columns): for each span, its words' weights side by side
    readout: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = PREDICT
    by_language: dict[str, float] = field(default_factory=dict)

    def embedded(self, words: np.ndarray) -> np.ndarray:
        x = self.embeddings.take(words[:, 0], axis=0)
        for j in range(1, words.shape[1]):
            x += self.embeddings.take(words[:, j], axis=0)
        return x

    def responses(self, x: np.ndarray, blank: np.ndarray) -> np.ndarray:
        """Response of each filter at each word (words, spans x FILTERS); 0 at the blank words."""
        z = x @ self.filters
        out = np.empty((len(x), len(SPANS) * FILTERS), np.float32)
        for i, span in enumerate(SPANS):
            y = out[:, i * FILTERS : (i + 1) * FILTERS]
            y[:] = z[:, _COLUMNS[i] : _COLUMNS[i] + FILTERS]
            for j in range(1, span):
                at = _COLUMNS[i] + j * FILTERS
                y[:-j] += z[j:, at : at + FILTERS]
        out[blank] = 0
        return out

    def pooled(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) < 2:
            return np.zeros((0, len(SPANS) * FILTERS), np.float32)
        y = self.responses(self.embedded(words), words[:, 0] == 0)
        return np.maximum.reduceat(y, bounds[:-1], axis=0)

    def output(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return (self.pooled(words, bounds) @ self.readout + self.bias).astype(np.float64)

    def probability(self, output: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * output + self.shift, -35, 35)))


def begun(seen: np.ndarray, n: np.ndarray, seed: int = 12) -> Network:
    """A network before training: log odds of each row in the first coordinate, small random weights elsewhere.

    ``seen`` counts the documents of either label that have a row, ``n`` all of them.
    """
    rng = np.random.default_rng(seed)
    share = (seen + 0.5) / (np.maximum(n, 1)[:, None] + 1)
    odds = np.clip(np.log(share[1] / share[0]), 0, 4) * (seen[1] / (seen[1] + 2))
    embeddings = rng.normal(0, 0.1, (seen.shape[1], WIDTH)).astype(np.float32)
    embeddings[:, 0] = odds / 2
    embeddings[0] = 0
    filters = rng.normal(0, 0.2, (WIDTH, int(_COLUMNS[-1]))).astype(np.float32)
    filters[0] = np.abs(filters[0]) + 0.1
    return Network(embeddings, filters, rng.normal(0.1, 0.05, len(SPANS) * FILTERS).astype(np.float32), bias=-1.0)


def gradients(net: Network, words: np.ndarray, blank: np.ndarray, error: np.ndarray, at: np.ndarray, x: np.ndarray):
    """Gradients of filters and of embedding rows. Only the words under each pooled maximum (``at``) count."""
    flow = (error[:, None] * net.readout[None, :]).astype(np.float32)
    flow[blank[at]] = 0  # nothing in the text was above the blank
    by_filter = np.zeros_like(net.filters)
    places, changes = [], []
    for i, span in enumerate(SPANS):
        part = slice(i * FILTERS, (i + 1) * FILTERS)
        for j in range(span):
            place = np.minimum(at[:, part] + j, len(x) - 1)
            columns = slice(_COLUMNS[i] + j * FILTERS, _COLUMNS[i] + (j + 1) * FILTERS)
            by_filter[:, columns] = np.einsum("rf,rfd->df", flow[:, part], x[place])
            places.append(place.reshape(-1))
            changes.append((flow[:, part, None] * net.filters[:, columns].T[None]).reshape(-1, WIDTH))
    hashed = words[np.concatenate(places)]
    row, inverse = np.unique(hashed, return_inverse=True)
    total = np.zeros((len(row), WIDTH), np.float32)
    np.add.at(total, inverse.reshape(hashed.shape), np.concatenate(changes)[:, None, :])
    return by_filter, row[row > 0], total[row > 0]


def peaks(net: Network, words: np.ndarray, blank: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of each filter's maximum in each text; a text longer than BATCH_WORDS is read in pieces."""
    if len(words) <= 2 * BATCH_WORDS:
        y = net.responses(net.embedded(words), blank)
        at = np.stack([a + y[a:b].argmax(axis=0) for a, b in zip(bounds[:-1], bounds[1:])])
        return at, y[at, np.arange(y.shape[1])]
    at = np.zeros((len(bounds) - 1, len(SPANS) * FILTERS), np.int64)
    value = np.full(at.shape, -np.inf, np.float32)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for lo in range(a, b, BATCH_WORDS):
            hi = min(lo + BATCH_WORDS, b)
            part = slice(lo, min(hi + max(SPANS) - 1, b))
            y = net.responses(net.embedded(words[part]), blank[part])[: hi - lo]
            place = y.argmax(axis=0)
            top = y[place, np.arange(y.shape[1])]
            more = top > value[i]
            at[i, more], value[i, more] = lo + place[more], top[more]
    return at, value


@dataclass
class Descent:
    """A network in training, with the sums of squared gradients by which its steps are scaled."""

    net: Network
    past_embeddings: np.ndarray
    past_filters: np.ndarray
    past_readout: np.ndarray

    @classmethod
    def of(cls, net: Network) -> Descent:
        return cls(net, np.full((len(net.embeddings), 1), 1e-4, np.float32), np.full_like(net.filters, 1e-4), np.full_like(net.readout, 1e-4))

    def copy(self) -> Descent:
        net = Network(self.net.embeddings.copy(), self.net.filters.copy(), self.net.readout.copy(), self.net.bias)
        return Descent(net, self.past_embeddings.copy(), self.past_filters.copy(), self.past_readout.copy())

    def step(self, documents: list[np.ndarray], label: np.ndarray, weight: np.ndarray, rng: np.random.Generator, rate: float = 0.02) -> np.ndarray:
        """One step of logistic loss; at times a word's own row is left out, so that its parts learn too. Returns the embedding rows changed."""
        net, pad = self.net, np.zeros((max(SPANS) - 1, documents[0].shape[1]), np.int32)
        words = np.concatenate([part for d in documents for part in (d, pad)])
        blank = words[:, 0] == 0
        words[:, 0] *= rng.random(len(words)) < 0.75
        at, pooled = peaks(net, words, blank, np.concatenate([[0], np.cumsum([len(d) + len(pad) for d in documents])]))
        p = 1 / (1 + np.exp(-np.clip(pooled @ net.readout + net.bias, -30, 30)))
        error = (weight * (p - label) / len(label)).astype(np.float32)
        need = np.unique(np.minimum(at[None] + np.arange(max(SPANS))[:, None, None], len(words) - 1))  # only words under a maximum have a gradient
        by_filter, row, by_row = gradients(net, words[need], blank[need], error, np.searchsorted(need, at), net.embedded(words[need]))
        by_readout = pooled.T @ error + 1e-4 * net.readout
        self.past_filters += by_filter**2
        self.past_readout += by_readout**2
        self.past_embeddings[row] += (by_row**2).mean(axis=1, keepdims=True)
        net.filters -= rate * by_filter / np.sqrt(self.past_filters)
        net.readout -= rate * by_readout / np.sqrt(self.past_readout)
        net.embeddings[row] -= rate * by_row / np.sqrt(self.past_embeddings[row])
        net.bias -= rate * float(error.sum())
        return row

    def others(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights outside the embeddings, and their sums of squares."""
        return np.concatenate([self.net.filters.ravel(), self.net.readout, [self.net.bias]]), np.concatenate([self.past_filters.ravel(), self.past_readout])


def best_threshold(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the widest gap between scores that gives the best F1."""
    s, place = np.unique(score, return_inverse=True)
    toxic = np.bincount(place, weights=weight * label)
    above = np.cumsum(np.bincount(place, weights=weight)[::-1])[::-1]
    f1 = 2 * np.cumsum(toxic[::-1])[::-1] / (above + toxic.sum())
    cuts = np.concatenate([[0.0], s])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = best[np.argmax(s[best] - cuts[best])]
    return float((s[i] + cuts[i]) / 2)


def calibrate(net: Network, output: np.ndarray, label: np.ndarray, weight: np.ndarray, languages: list[str | None]) -> None:
    """Fits slope and shift to weighted labels (drawn a little from 0 and 1), then the thresholds."""
    y1, y0 = (weight * label).sum(), (weight * (1 - label)).sum()
    target = np.where(label == 1, (y1 + 1) / (y1 + 2), 1 / (y0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(60):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(slope * output + shift, -35, 35)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        gradient = np.array([(g * output).sum() + 1e-3 * (slope - 1), g.sum()])
        curve = np.array([[(h * output**2).sum() + 1e-3, (h * output).sum()], [(h * output).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        slope, shift = slope - step[0], shift - step[1]
    net.slope, net.shift = max(float(slope), 1e-3), float(shift)
    score = net.probability(output)
    net.threshold = best_threshold(score, label, weight)
    for name in sorted({x for x in languages if x is not None}):
        mine = np.array([x == name for x in languages])
        toxic = float((weight * label)[mine].sum())
        if 0 < toxic < weight[mine].sum():
            net.by_language[name] = (toxic * best_threshold(score[mine], label[mine], weight[mine]) + DRAWN * net.threshold) / (toxic + DRAWN)


def constant(share: float) -> Network:
    """Gives every text the score ``share``."""
    odds = float(np.log(max(share, 1e-15) / max(1 - share, 1e-15)))
    return Network(np.zeros(((1 << BITS) + 1, WIDTH), np.float32), np.zeros((WIDTH, int(_COLUMNS[-1])), np.float32), np.zeros(len(SPANS) * FILTERS, np.float32), slope=0.0, shift=odds)


def known_texts(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """(unit, h, toxic, held, text, lang) of every labelled document that may be learned from, written in the order of unit and hash.

    Labels and texts meet in the shuffle that deals the units, so texts are shuffled once.
    """
    allowed = F.lit(True) if learn is None else learn
    marks = labels.where("doc_id is not null and toxic is not null").where(allowed).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    units = max(1, -(-marks.count() // UNIT))
    lang = F.col("lang").cast("string") if "lang" in {c.lower() for c in docs.columns} else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    texts = docs.where("doc_id is not null").where(allowed).select("doc_id", F.lit(None).cast("int").alias("toxic"), F.struct(F.xxhash64(text).alias("h"), text.alias("text"), lang.alias("lang")).alias("d"))
    rows = texts.unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn("unit", F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(units)).cast("int")).repartition(partitions(docs.sparkSession), "unit")
    known = rows.groupBy("unit", "doc_id").agg(F.max("toxic").alias("toxic"), F.min("d").alias("d")).where("toxic is not null and d is not null")
    known = known.withColumn("h", F.xxhash64("doc_id", F.lit(37))).sortWithinPartitions("unit", "h", "doc_id")
    return written(known.select("unit", "h", "toxic", (F.pmod("h", F.lit(5)) == 4).alias("held"), "d.text", "d.lang"), "labelled")


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int, str | None]]:
    """(unit, words, toxic, lang) of each row."""
    for batch in batches:
        unit, toxic, lang = (batch.column(c).to_pylist() for c in ("unit", "toxic", "lang"))
        for at, data, offsets in slices(batch.column("text"), SLICE_BYTES):
            words, bounds = word_rows(data, offsets)
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), at):
                yield unit[i], words[a : b - (max(SPANS) - 1)], toxic[i], lang[i]


def _batched(documents: Iterable[tuple[int, np.ndarray, int, str | None]]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    words, toxic, size = [], [], 0
    for _, w, y, _ in documents:
        if words and (len(words) == BATCH or size + len(w) > BATCH_WORDS):
            yield words, np.array(toxic, float)
            words, toxic, size = [], [], 0
        words.append(w)
        toxic.append(y)
        size += len(w)
    if words:
        yield words, np.array(toxic, float)


def _packed(values: np.ndarray) -> bytes:
    """Integers by planes of bytes: most of the upper ones are equal."""
    return zlib.compress(np.ascontiguousarray(values.reshape(-1).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(body), np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _sums(known: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], list[np.ndarray]]) -> list[np.ndarray]:
    """The sums over all tasks of the integers that ``run`` gives: one array of (SLICES * ROWS, columns), then flat ones."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, *others = run(batches)
        bodies = [_packed(x) for x in (*first.reshape(SLICES, -1), *others)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(bodies)), pa.int32()), pa.array(bodies, pa.binary())], ["slice", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch.column("slice").to_pylist(), batch.column("body")):
                now = _unpacked(body.as_py())
                total[i] = total[i] + now if i in total else now
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(x) for x in total.values()], pa.binary())], ["slice", "body"])

    kind = "slice int, body binary"
    parts = known.select("unit", "toxic", "lang", "text").mapInArrow(part, kind)
    got = parts.repartition(min(partitions(known.sparkSession), SLICES), "slice").mapInArrow(add, kind).toArrow().sort_by("slice")  # of fixed size
    made = [_unpacked(x) for x in got.column("body").to_pylist()]
    return [np.concatenate(made[:SLICES]).reshape(SLICES * ROWS, -1), *made[SLICES:]]


def _counted(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """Documents of either label with each embedding row."""
    seen = np.zeros((SLICES * ROWS, 2), np.int64)
    for _, words, toxic, _ in _documents(batches):
        seen[np.unique(words), toxic] += 1
    return [seen]


def _round(known: DataFrame, now: Descent, turn: int, weight: tuple[float, float]) -> Descent:
    """Every unit descends from ``now`` over its documents; the mean of what they change is added."""
    shared = known.sparkSession.sparkContext.broadcast(now)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        start = shared.value
        weights, past = start.others()
        rows = np.zeros((SLICES * ROWS, WIDTH + 2), np.int64)
        others = [np.zeros(len(weights), np.int64), np.zeros(len(past), np.int64), np.zeros(1, np.int64)]
        for unit, documents in groupby(_documents(batches), key=lambda d: d[0]):
            mine, rng, changed = start.copy(), np.random.default_rng((unit, turn)), np.zeros(len(start.net.embeddings), bool)
            for words, label in _batched(documents):
                changed[mine.step(words, label, np.where(label == 1, weight[1], weight[0]), rng)] = True
            at = np.flatnonzero(changed)
            rows[at, :WIDTH] += np.rint((mine.net.embeddings[at] - start.net.embeddings[at]) * WEIGHT_SCALE).astype(np.int64)
            rows[at, WIDTH] += np.rint((mine.past_embeddings[at, 0] - start.past_embeddings[at, 0]).astype(float) * PAST_SCALE).astype(np.int64)
            rows[at, WIDTH + 1] += 1
            for total, was, new, scale in zip(others, (weights, past), mine.others(), (WEIGHT_SCALE, PAST_SCALE)):
                total += np.rint((new - was).astype(float) * scale).astype(np.int64)
            others[2] += 1
        return [rows, *others]

    rows, weights, past, units = _sums(known.sortWithinPartitions("unit", F.xxhash64("h", F.lit(turn)), "h"), run)  # another order in each round
    shared.destroy()
    out, at = now.copy(), np.flatnonzero(rows[:, WIDTH + 1])
    n = rows[at, WIDTH + 1 :]
    out.net.embeddings[at] += (rows[at, :WIDTH] / (n * WEIGHT_SCALE)).astype(np.float32)
    out.past_embeddings[at] += (rows[at, WIDTH : WIDTH + 1] / (n * PAST_SCALE)).astype(np.float32)
    weights, past = weights / (units[0] * WEIGHT_SCALE), past / (units[0] * PAST_SCALE)
    size = out.net.filters.size
    out.net.filters += weights[:size].reshape(out.net.filters.shape).astype(np.float32)
    out.net.readout += weights[size:-1].astype(np.float32)
    out.net.bias += float(weights[-1])
    out.past_filters += past[:size].reshape(out.net.filters.shape).astype(np.float32)
    out.past_readout += past[size:].astype(np.float32)
    return out


def _outputs(known: DataFrame, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """(output in steps of 1 / STEPS, label, documents, lang): how many documents have each."""
    shared = known.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, data, offsets in slices(batch.column("text"), SLICE_BYTES):
                out[at : at + len(offsets) - 1] = model.output(*word_rows(data, offsets))
            step = np.rint(np.clip(out, -64, 64) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column("toxic"), batch.column("lang")], ["step", "toxic", "lang"])

    seen = known.select("toxic", "lang", "text").mapInArrow(run, "step int, toxic int, lang string")
    got = seen.groupBy("step", "toxic", "lang").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most 256 * STEPS rows for each language
    step, toxic, n = (got.column(c).to_numpy().astype(float) for c in ("step", "toxic", "n"))
    return step / STEPS, toxic, n, got.column("lang").to_pylist()


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Network:
    """The network, trained and calibrated on all labelled documents (those for which ``learn``, a condition on doc_id, holds)."""
    known = known_texts(docs, labels, learn)
    counts = {(r.toxic, r.held): r.n for r in known.groupBy("toxic", "held").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows at most
    of = lambda y, *held: sum(counts.get((y, h), 0) for h in held)
    if not of(0, False, True) or not of(1, False, True):
        return constant(float(of(1, False, True) > 0))
    apart = of(1, True) >= 10 and min(of(0, True), of(0, False), of(1, False)) > 0  # else too few to hold any back
    trained = known.where("not held") if apart else known
    n = np.array([of(y, False) if apart else of(y, False, True) for y in (0, 1)], float)
    (seen,) = _sums(trained, _counted)
    now = Descent.of(begun(seen[: (1 << BITS) + 1].T.astype(np.float32), n.astype(np.float32)))
    for turn in range(ROUNDS):
        now = _round(trained, now, turn, tuple(0.5 * n.sum() / n))
    calibrate(now.net, *_outputs(known.where("held") if apart else known, now.net))
    return now.net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang, score): probability that a text is toxic, by the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, data, offsets in slices(batch.column("text"), SLICE_BYTES):
                out[at : at + len(offsets) - 1] = model.probability(model.output(*word_rows(data, offsets)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(out)], ["doc_id", "lang", "score"])

    lang = F.col("lang").cast("string") if "lang" in {c.lower() for c in docs.columns} else F.lit(None).cast("string")
    return docs.select("doc_id", "text", lang.alias("lang")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, score double")


def flagged(scored: DataFrame, net: Network) -> DataFrame:
    """Adds the language's ``threshold`` and ``toxic``: whether the score reaches it."""
    by = F.lit(net.threshold)
    for name, t in net.by_language.items():
        by = F.when(F.col("lang") == name, F.lit(t)).otherwise(by)
    return scored.withColumn("threshold", by).withColumn("toxic", F.col("score") >= F.col("threshold"))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return flagged(score(docs, net), net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), "threshold", "toxic")
