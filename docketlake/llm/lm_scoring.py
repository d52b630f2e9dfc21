"""Hashed maximum-entropy language model with a class-factored softmax.

log p(word | context) = log p(class | context) + log p(word | class, context).

The class factor is a softmax over hashed features of the context: the previous word, the word
before it (skip) and both in order. The most frequent words are classes of their own, all others
are dealt over classes by hash. The word factor is a softmax over the words of the class: the log of
a word's smoothed relative frequency plus the weight of the feature (previous word, word). Only
words that were seen after the previous word have such a weight, so the sum over the class is the
unigram mass, corrected for those words: exact, and as cheap as the number of words seen.

Training. Class weights: every task takes mini-batch gradient steps from the shared weights on its
documents, the updates are averaged by token counts, and the mean goes into the next round; each
document is in one round. Word weights: one weight for each distinct pair of the training documents,
so their number grows with the corpus. They are never in one place: a pair belongs to the shard of
its context's hash. Every block of documents sends each shard its distinct pairs with their counts;
the shard adds the counts up, takes gradient steps (scaled by the curvature) on the penalised
likelihood and returns the weights, already normalised, in the order asked. A pair is asked for once
a block, so a very common pair makes no hot shard.

Word counts are exact over all training documents. Counts of at most ``FREQUENT`` frequent words are
sent to the tasks; rarer words are looked up by a join and have no weights of their own.

Defined cases: a null text is an empty one, whose only token is its end; a null doc_id is hashed as
an empty string; an empty table gives an empty result; repeated rows are scored (and learned) each;
with no training document at all every word is unknown; very long texts are blocks of their own.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, written
from .wordblocks import Block, blocks, mix

FREQUENT = 1_000_000
SINGLES = 24
CLASSES = 64
FEATURE_BITS = 14
ROUNDS = 3
BATCH = 4096
RATE = 0.3
COUNT_BYTES = 4 << 20
END = np.uint64(0x1D872B41C5A3F00D)
START = np.uint64(0x7F4A7C159E3779B9)
ROWS_PER_PIECE = 64
WORD_BITS, CLASS_BITS = 20, 6
VARIANCE = 1.5
STEPS = 5
SHARD_TOKENS = 3_000_000
BLOCK_TOKENS = 250_000


def held_out() -> Column:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(F.encode(key, "UTF-8")) % 7 == 2


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block with an end after each row, and the row bounds."""
    rows = block.rows
    bounds = block.row_words + np.arange(rows + 1)
    out = np.empty(len(block.hashes) + rows, np.uint64)
    at = np.arange(len(block.hashes)) + block.word_rows()
    out[at] = block.hashes
    out[bounds[1:] - 1] = END
    return out, bounds


def previous(toks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    one = np.empty_like(toks)
    one[1:] = toks[:-1]
    one[bounds[:-1]] = START
    return one


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): exact counts of hashed tokens, folded per block before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True, limit=COUNT_BYTES):
                words, counts = np.unique(tokens(block)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(words)), pa.array(counts.astype(np.int64))], ["word", "c"])

    made = docs.select("text").mapInArrow(run, "word long, c long")
    return made.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """What a task needs; every part is bounded by the parameters above."""

    total: int
    distinct: int
    words: np.ndarray  # frequent words, sorted by hash
    counts: np.ndarray
    singles: np.ndarray  # single-word classes, sorted by hash
    class_total: np.ndarray
    class_distinct: np.ndarray
    bias: np.ndarray
    weights: np.ndarray

    def classes(self, toks: np.ndarray) -> np.ndarray:
        return word_class(toks, self.singles)

    def listed(self, toks: np.ndarray) -> np.ndarray:
        """1 + number of each token among the frequent words, 0 where it is none of them."""
        if not len(self.words):
            return np.zeros(len(toks), np.int64)
        distinct, inverse = np.unique(toks, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
        return np.where(self.words[at] == distinct, at + 1, 0)[inverse]

    def features(self, toks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Three hashed features of each token's context."""
        one, two = previous(toks, bounds), np.empty_like(toks)
        two[2:] = toks[:-2]
        two[bounds[:-1]] = START
        second = bounds[:-1][np.diff(bounds) > 1] + 1
        two[second] = START
        shift = np.uint64(64 - FEATURE_BITS)
        out = np.empty((3, len(toks)), np.uint16)  # sorted by radix
        out[0] = one >> shift
        out[1] = mix(two ^ np.uint64(0x51ED2701)) >> shift
        out[2] = mix(one * np.uint64(3) + two) >> shift
        return out

    def class_odds(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp(z) of each class, scaled by the largest, with its logarithm."""
        z = self.weights[feats[0]]
        z += self.weights[feats[1]]
        z += self.weights[feats[2]]
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        return np.exp(z), z

    def class_scores(self, feats: np.ndarray) -> np.ndarray:
        """Log p(class | context)."""
        odds, z = self.class_odds(feats)
        z -= np.log(odds.sum(axis=1, keepdims=True))
        return z

    def word_share(self, number: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """p(word | class) of frequent words by frequency alone."""
        return (self.counts[number] + 1.0) / (self.class_total[kind] + self.class_distinct[kind] + 1)


def word_class(toks: np.ndarray, singles: np.ndarray) -> np.ndarray:
    out = (len(singles) + (mix(toks ^ np.uint64(0xC1A55)) % np.uint64(CLASSES - len(singles))).astype(np.int64)).astype(np.int64)
    if len(singles):
        at = np.minimum(np.searchsorted(singles, toks), len(singles) - 1)
        same = singles[at] == toks
        out[same] = at[same]
    return out


# class factor


def _step(weights: np.ndarray, seen: np.ndarray, column: np.ndarray, gradient: np.ndarray) -> None:
    """One gradient step on the rows of ``weights`` that a batch's tokens have as a feature.

    Rows of few tokens are updated token by token of the same rank, without repeats in one go;
    longer ones are summed first.
    """
    order = np.argsort(column, kind="stable")
    ordered = column[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(start, len(order)))
    rows = ordered[start]
    seen[rows] += size
    rate = (RATE / np.sqrt(seen[rows])).astype(np.float32)
    few = size <= 8
    for rank in range(int(size[few].max(initial=0))):
        pick = few & (size > rank)
        weights[rows[pick]] -= gradient[order[start[pick] + rank]] * rate[pick, None]
    for i in np.flatnonzero(~few):
        weights[rows[i]] -= gradient[order[start[i] : start[i] + size[i]]].sum(axis=0) * rate[i]


def _train_task(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights.copy()
        local = Model(**{**model.__dict__, "weights": weights})
        seen = np.ones(len(weights), np.float32)
        n = 0
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                toks, bounds = tokens(block)
                feats, target = local.features(toks, bounds), local.classes(toks)
                for lo in range(0, len(toks), BATCH):
                    f, t = feats[:, lo : lo + BATCH], target[lo : lo + BATCH]
                    gradient, _ = local.class_odds(f)
                    gradient /= gradient.sum(axis=1, keepdims=True)
                    gradient[np.arange(len(t)), t] -= 1
                    for column in f:
                        _step(weights, seen, column, gradient)
                n += len(toks)
        if n:
            change = (weights - model.weights).astype(np.float16)
            pieces = range(0, len(weights), ROWS_PER_PIECE)
            data = [change[p : p + ROWS_PER_PIECE].tobytes() for p in pieces]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(pieces), pa.int32()), pa.array([n] * len(data), pa.int64()), pa.array(data, pa.binary())], ["piece", "n", "change"]
            )

    return run


def _mean_change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean change of each piece, summed as the tasks' rows stream by."""
    sums: dict[int, np.ndarray] = {}
    share: dict[int, int] = {}
    for batch in batches:
        for piece, n, data in zip(*(batch.column(c).to_pylist() for c in ("piece", "n", "change"))):
            part = np.frombuffer(data, np.float16).astype(np.float64) * n
            sums[piece] = sums[piece] + part if piece in sums else part
            share[piece] = share.get(piece, 0) + n
    means = [(total / share[piece]).astype(np.float32).tobytes() for piece, total in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(means, pa.binary())], ["piece", "change"])


def train(docs: DataFrame, vocabulary: DataFrame, rounds: int = ROUNDS) -> Model:
    """The counts and the class weights of the documents given; ``vocabulary`` is their ``count_words``."""
    spark = docs.sparkSession
    sums = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    # words by order of magnitude: at most 64 rows
    sizes = vocabulary.groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()
    least, held = 64, 0
    for row in sorted(sizes, key=lambda r: -r.b):
        held += row.k
        if held > FREQUENT:
            break
        least = row.b
    frequent = vocabulary.where(F.col("c") >= 1 << min(least, 62)).toArrow()  # at most FREQUENT rows
    words, counts = frequent.column("word").to_numpy().view(np.uint64), frequent.column("c").to_numpy()
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    singles = np.sort(words[np.lexsort((words, -counts))[:SINGLES]])
    listed = spark.sparkContext.broadcast(singles)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        for batch in batches:
            k = word_class(batch.column("word").to_numpy().view(np.uint64), listed.value)
            n += np.bincount(k, weights=batch.column("c").to_numpy(), minlength=CLASSES)
            v += np.bincount(k, minlength=CLASSES)
        arrays = [pa.array(np.arange(CLASSES)), pa.array(n.astype(np.int64)), pa.array(v.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, ["k", "n", "v"])

    per = vocabulary.mapInArrow(by_class, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in per:
        class_total[row.k], class_distinct[row.k] = row.n, row.v
    share = (class_total + 1) / (class_total.sum() + CLASSES)
    weights = np.zeros((1 << FEATURE_BITS, CLASSES), np.float32)
    model = Model(sums.n or 0, sums.v, words, counts, singles, class_total, class_distinct, np.log(share).astype(np.float32), weights)
    part = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(rounds))
    for r in range(rounds):
        small = Model(**{**model.__dict__, "words": words[:0], "counts": counts[:0]})
        shared = spark.sparkContext.broadcast(small)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return _train_task(shared.value)(batches)

        moved = docs.where(part == r).select("text").mapInArrow(step, "piece int, n long, change binary")
        mean = moved.repartition(partitions(spark), "piece").mapInArrow(_mean_change, "piece int, change binary")
        # the weights' fixed size, whatever the corpus
        for row in mean.collect():
            change = np.frombuffer(row.change, np.float32).reshape(-1, CLASSES)
            model.weights[row.piece : row.piece + len(change)] += change
        shared.unpersist()
    return model


# word factor


def pair_keys(toks: np.ndarray, bounds: np.ndarray, kinds: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Context (previous word, class) in the upper bits, the word's number below; equal contexts of one class may share a hash."""
    context = mix(previous(toks, bounds)) >> np.uint64(WORD_BITS + CLASS_BITS)
    return (context << np.uint64(WORD_BITS + CLASS_BITS)) | ((kinds << WORD_BITS) | number).astype(np.uint64)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys, in order; a context is never divided."""
    return (((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def pack_keys(key: np.ndarray) -> bytes:
    """Sorted keys as differences of their upper halves (two bytes each if they fit) and lower halves."""
    upper = np.diff(key >> np.uint64(32), prepend=np.uint64(0))
    narrow = upper[1:].max(initial=np.uint64(0)) < 65_536
    return upper[:1].astype(np.uint32).tobytes() + upper[1:].astype(np.uint16 if narrow else np.uint32).tobytes() + key.astype(np.uint32).tobytes()


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    kind = np.uint16 if len(data) == 4 + (n - 1) * 2 + n * 4 else np.uint32
    upper = np.concatenate([np.frombuffer(data, np.uint32, 1), np.frombuffer(data, kind, n - 1, 4)]).astype(np.uint64)
    return (np.cumsum(upper) << np.uint64(32)) | np.frombuffer(data, np.uint32, n, len(data) - 4 * n)


def pair_weights(model: Model, key: np.ndarray, n: np.ndarray, variance: float = VARIANCE, steps: int = STEPS) -> np.ndarray:
    """log p(word | class, previous) - log p(word | class) of sorted distinct keys with training counts.

    A key with number 0 stands for every word without a weight. Weights maximise the likelihood of
    the counts less weight**2 / (2 variance); the probabilities sum to one whatever the weights.
    """
    number = (key & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    kind = ((key >> np.uint64(WORD_BITS)) & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64)
    context = key >> np.uint64(WORD_BITS)
    start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    size = np.diff(np.append(start, len(key)))
    total = np.repeat(np.add.reduceat(n, start).astype(float), size)
    free = (number > 0) & (n > 0)
    weight = np.zeros(len(key))
    if len(model.counts):
        share = np.where(number > 0, model.word_share(np.maximum(number, 1) - 1, kind), 0.0)
    else:
        share = np.zeros(len(key))
    ratio = np.log(np.maximum(n, 1e-9) / np.maximum(total * share, 1e-300))
    weight[free] = np.clip(np.minimum(variance * n[free], ratio[free]), 0, None)
    for step in range(steps + 1):
        odds = share * np.exp(weight)
        mass = np.repeat(np.maximum(1 + np.add.reduceat(odds - share, start), 1e-300), size)
        if step == steps:
            return weight - np.log(mass)
        p = odds / mass
        move = (n - total * p - weight / variance) / (total * p * (1 - p) + 1 / variance)
        weight[free] += np.clip(move[free], -1, 1)
    raise AssertionError


ROWS = "doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, rare array<struct<word:long,n:int>>"


def _rare_words(toks: np.ndarray, rows: np.ndarray, bounds_rows: int) -> pa.Array:
    """Per row the distinct words of (row, word) and how often each occurs; rows are in order."""
    order = np.lexsort((toks, rows))
    word, row = toks[order], rows[order]
    start = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])])) if len(word) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(word)))
    cuts = np.searchsorted(row[start], np.arange(bounds_rows + 1))
    items = pa.StructArray.from_arrays([pa.array(_signed(word[start])), pa.array(n.astype(np.int32))], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items)


MAIL = "dest long, block long, shard int, keys binary, counts binary"


def _ask(model: Model, shards: int):
    """Scores every row without the word weights, and asks the shards for them."""
    scale = np.log10(model.total + model.distinct + 1)
    single = np.arange(CLASSES) < len(model.singles)
    class_scale = np.where(single, 0, np.log10(model.class_total + model.class_distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                toks, bounds = tokens(block)
                rows = np.repeat(np.arange(block.rows), np.diff(bounds))
                kinds, number = model.classes(toks), model.listed(toks)
                known = number > 0
                logs = np.zeros(len(toks))
                if len(model.counts):
                    logs = np.where(known, np.log10(model.counts[np.maximum(number, 1) - 1] + 1.0), 0.0)
                inner = np.where(single[kinds], 0.0, logs - class_scale[kinds])
                feats, ahead = model.features(toks, bounds), np.empty(len(toks))
                for lo in range(0, len(toks), BATCH):
                    z = model.class_scores(feats[:, lo : lo + BATCH])
                    ahead[lo : lo + BATCH] = z[np.arange(len(z)), kinds[lo : lo + BATCH]]
                total = lambda x: np.bincount(rows, weights=x, minlength=block.rows)
                part = slice(block.first_row, block.first_row + block.rows)
                out = batch.column("held_out")[part]
                done = pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[part], out, pa.array(np.diff(bounds)), pa.array(total(known).astype(np.int64)), pa.array(np.full(block.rows, model.total, np.int64)),
                        pa.array(total(logs - scale)), pa.array(total(inner + ahead / np.log(10))), _rare_words(toks[~known], rows[~known], block.rows),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "rare"],
                )
                chosen = ~single[kinds]
                key = pair_keys(toks, bounds, kinds, number)[chosen]
                order = np.argsort(key, kind="stable")
                key, row = key[order], rows[chosen][order]
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                learn = (~out.to_numpy(zero_copy_only=False)).astype(np.int64)
                counts = np.add.reduceat(learn[row], start) if len(key) else np.zeros(0, np.int64)
                key, times = key[start], np.diff(np.append(start, len(key)))
                cuts = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
                asked = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, done.schema) as to:
                    to.write_batch(done)
                keys = [sink.getvalue().to_pybytes(), *(pack_keys(key[cuts[s] : cuts[s + 1]]) for s in asked)]
                places = row.astype(np.uint16 if block.rows <= 65_536 else np.uint32).tobytes()
                more = [len(places).to_bytes(8, "little") + places + times.astype(np.uint32).tobytes(), *(counts[cuts[s] : cuts[s + 1]].astype(np.uint32).tobytes() for s in asked)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([-1 - n_block, *asked], pa.int64()), pa.array([n_block] * (1 + len(asked)), pa.int64()), pa.array([-1, *asked], pa.int32()),
                        pa.array(keys, pa.binary()), pa.array(more, pa.binary()),
                    ],
                    ["dest", "block", "shard", "keys", "counts"],
                )
                n_block += 1

    return run


def _answer(model: Model):
    """Per shard: adds up the counts asked with, finds the weights, and answers each block in its order. Other mail passes."""

    def weigh(mail: list[tuple[int, int, bytes, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        counts = [np.frombuffer(c, np.uint32) for *_, c in mail]
        keys = [unpack_keys(k, len(c)) for (_, _, k, _), c in zip(mail, counts)]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct))
        found = (pair_weights(model, distinct, n) / np.log(10)).astype(np.float32)[inverse]
        at = 0
        for (block, shard, *_), k in zip(mail, keys):
            yield block, shard, found[at : at + len(k)].tobytes()
            at += len(k)

    def out(rows: list[tuple[int, int, bytes, bytes | None]]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["block", "shard", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for dest, block, shard, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("dest", "block", "shard", "keys", "counts"))):
                if dest < 0:
                    yield out([(block, shard, keys, counts)])
                    continue
                if held and held[0][1] != shard:
                    yield out([(*x, None) for x in weigh(held)])
                    held = []
                held.append((block, shard, keys, counts))
        if held:
            yield out([(*x, None) for x in weigh(held)])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each block with the answers of all shards added; the block's own row comes before them."""
    own, answers = None, []

    def done() -> pa.RecordBatch:
        rows, more = own
        batch = pa.ipc.open_stream(rows).read_next_batch()
        size = int.from_bytes(more[:8], "little")
        times = np.frombuffer(more, np.uint32, offset=8 + size)
        row = np.frombuffer(more[8 : 8 + size], np.uint16 if size == 2 * int(times.sum()) else np.uint32)
        found = np.frombuffer(b"".join(answers), np.float32).astype(float)
        score = batch.column("score").to_numpy() + np.bincount(row, weights=np.repeat(found, times), minlength=batch.num_rows)
        return batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(score))

    for batch in batches:
        for shard, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "counts"))):
            if shard < 0:
                if own:
                    yield done()
                own, answers = (keys, counts), []
            else:
                answers.append(keys)
    if own:
        yield done()


def score(docs: DataFrame, vocabulary: DataFrame, model: Model) -> DataFrame:
    """Counts and log10 scores of every row of (doc_id, text, held_out); rows held out teach no word weights."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    n_shards = max(partitions(spark), -(-model.total // SHARD_TOKENS))
    n_tasks = max(partitions(spark), -(-model.total // (8 * BLOCK_TOKENS)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _ask(shared.value, n_shards)(batches)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _answer(shared.value)(batches)

    mail = docs.select("doc_id", "held_out", "text").mapInArrow(ask, MAIL)
    mail = mail.repartition(n_shards, "dest").sortWithinPartitions("dest", "block")
    answers = mail.mapInArrow(answer, "block long, shard int, keys binary, counts binary")
    answers = answers.repartition(n_tasks, "block").sortWithinPartitions("block", "shard").select("shard", "keys", "counts")
    first = answers.mapInArrow(_add_up, ROWS.format(kind=dict(docs.dtypes)["doc_id"]))
    first = written(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    left = vocabulary.where(F.col("c") < int(model.counts.min()) if len(model.counts) else F.lit(True))
    late = rare.join(left, "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("add"))
    return first.join(late, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), "train_tokens",
        (F.col("base_score") + F.coalesce("add", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("add", F.lit(0.0))).alias("score"),
    )


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    training = rows.where(~F.col("held_out"))
    vocabulary = written(count_words(training), "vocabulary")
    return score(rows, vocabulary, train(training, vocabulary, rounds))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
