"""Exact n-gram Jaccard join by T-occurrence search.

A document's set holds its distinct 5-word shingles. Equal sets are one class, represented by its
smallest doc_id. Two sets with similarity t share a shingle among the first ``n - ceil(t n) + 1`` of
each in any common order; the order puts frequent shingles last, by counters over all documents and
by an exact list of the most frequent. Classes that share such a prefix shingle are candidates. To avoid all pairs inside a group of near copies, the first pass tries every
class only against the smallest and largest class of each of its shingles; the second pass tries the
pairs that still lie in different components, so no link between components is lost.

A pair must pass an upper bound on its overlap from parity bitmaps. What is left goes to the
T-occurrence search: the query's inverted lists over its candidates are split by length, the short
ones merged by counting, the long ones probed by binary search for the candidates that can still
reach the overlap (DivideSkip), and the exact overlap decides.

Defined cases: null and empty texts have an empty set, link with nothing and are their own
component; fewer words than five form one shingle; rows repeated with one doc_id are rows of their
own, also with different texts; rows with a null doc_id get a null component_id and link with
nothing; an empty table gives an empty result; extra columns are ignored (or carried by
``keep_one_each``), whatever their names; texts are read whole, however long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, dropped, partitions, small_batches, table, text_tag, written
from .recurrent import class_of, frequency_classes, hot_keys, recurring
from .wordblocks import Block, blocks, mix, shingle_hashes

K = 5
PERCENT = 80
CHUNK = 256
JOIN_CHUNK = 2048
PACK = 1 << 31


def shingle_sets(block: Block, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle), each once, sorted by row and shingle."""
    counts, rows = block.counts(), block.word_rows()
    whole = shingle_hashes(block.hashes, k)
    at = np.arange(len(whole))
    inside = at + k <= block.row_words[1:][rows[: len(whole)]] if len(whole) else np.zeros(0, bool)
    row, key = [rows[: len(whole)][inside]], [whole[inside]]
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        h = np.full(len(short), m, np.uint64)
        for j in range(m):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + block.hashes[block.row_words[short] + j])
        row.append(short)
        key.append(h)
    row, key = np.concatenate(row), np.concatenate(key)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[keep], key[keep]


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest overlap of sets of a and b elements that reaches the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def _bitmaps(row: np.ndarray, key: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity bitmaps, a power of two of at least 2n bits (64 at least) for n shingles."""
    bits = 1 << np.ceil(np.log2(np.maximum(sizes * 2, 64))).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(bits)])
    spot = start[row] + (mix(key ^ np.uint64(0xB17)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(spot, minlength=start[-1]) & 1).astype(np.uint8))
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(start[:-1].tolist(), start[1:].tolist())]


def overlap_bound(a: bytes, n: int, b: bytes, m: int) -> int:
    """No pair with these bitmaps and sizes shares more shingles."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    # the spot is hash mod size, so folding a longer bitmap on itself gives the shorter one
    return (n + m - int(np.bitwise_count(x ^ y).sum())) // 2


def profiles(docs: DataFrame, hot: np.ndarray, classes: np.ndarray, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, tag, n, h1, h2, bits, prefix) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, classes))  # 0.5 MB and 4 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, classes = shared.value  # rarest first
        by_key = np.argsort(hot)
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                row, key = shingle_sets(block, k)
                n = np.bincount(row, minlength=block.rows)
                start = np.concatenate([[0], np.cumsum(n)])
                sums = np.zeros((2, block.rows), np.uint64)
                for j, salt in enumerate((0, 0x5A17)):
                    np.add.at(sums[j], row, mix(key ^ np.uint64(salt)))
                rank = class_of(classes, key)  # at most 64
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, key, sorter=by_key), len(hot) - 1)
                    same = hot[by_key[at]] == key
                    rank[same] = by_key[at][same] + 65
                order = np.lexsort((key, rank, row))
                take = n - -(-percent * n // 100) + 1
                take[n == 0] = 0
                place = np.arange(len(key)) - start[row]
                ordered = key[order][place < take[row]].view(np.int64)
                cuts = np.concatenate([[0], np.cumsum(take)])
                prefix = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ordered))
                part, tag = (batch.column(c).slice(block.first_row, block.rows) for c in ("doc_id", "tag"))
                yield pa.RecordBatch.from_arrays(
                    [part, tag, pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(_bitmaps(row, key, n), pa.binary()), prefix],
                    ["doc_id", "tag", "n", "h1", "h2", "bits", "prefix"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), text_tag().alias("tag"), "text")
    return rows.mapInArrow(run, "doc_id long, tag long, n long, h1 long, h2 long, bits binary, prefix array<long>")


def bounded_pairs(pairs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            need = least_overlap(n, m, percent)
            good = np.minimum(n, m) >= need
            x, y = batch.column("xa"), batch.column("xb")
            for i in np.flatnonzero(good):
                good[i] = overlap_bound(x[i].as_buffer(), int(n[i]), y[i].as_buffer(), int(m[i])) >= need[i]
            yield batch.select(["a", "b"]).filter(pa.array(good))

    side = lambda s: reps.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"x{s}"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(fits)
    return joined.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def divide_skip(query: np.ndarray, sizes: np.ndarray, owner: np.ndarray, key: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Numbers of the candidates whose overlap with the query reaches the similarity.

    ``query`` is sorted; candidate shingles are (owner, key) with ``sizes`` per candidate.
    """
    if not len(query) or not len(sizes):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(query, key), len(query) - 1)
    hit = query[at] == key
    lists, member = at[hit], owner[hit]
    order = np.lexsort((member, lists))
    lists, member = lists[order], member[order]
    length = np.bincount(lists, minlength=len(query))
    need = least_overlap(len(query), sizes, percent)
    t = int(need.min())
    longest = int(length.max()) if len(length) else 0
    many = min(t - 1, int(t / (0.0085 * np.log2(max(longest, 2)) + 1)), len(query) - 1)
    is_long = np.zeros(len(query), bool)
    is_long[np.argsort(-length, kind="stable")[: max(many, 0)]] = True
    count = np.bincount(member[~is_long[lists]], minlength=len(sizes))
    alive = np.flatnonzero(count >= need - int(is_long.sum()))
    start = np.concatenate([[0], np.cumsum(length)])
    for j in np.flatnonzero(is_long & (length > 0)):
        rows = member[start[j] : start[j + 1]]
        spot = np.minimum(np.searchsorted(rows, alive), len(rows) - 1)
        count[alive] += rows[spot] == alive
    return alive[count[alive] >= need[alive]]


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes that link. A query's candidates are dealt in chunks of about CHUNK.

    ``nodes`` (node, doc_id, tag) tells which row has a node's text.
    """
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    chunk = F.pmod(F.xxhash64("b", F.lit(5)), F.ceil(F.col("size") / CHUNK)).cast("int")
    dealt = written(pairs.join(sizes, "a").select("a", chunk.alias("chunk"), "b"), "pairs")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_tag().alias("tag"), "text")
    asked = dealt.select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("node")).distinct()
    rows = asked.unionAll(dealt.select("a", "chunk", F.lit(1), "b")).join(nodes, "node").join(texts, ["doc_id", "tag"])
    rows = rows.repartition(partitions(docs.sparkSession), "a", "chunk").sortWithinPartitions("a", "chunk", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, name = np.zeros(0, np.uint64), (None, None)
        for batch in batches:
            a, c = batch.column("a").to_numpy(), batch.column("chunk").to_numpy()
            role, doc = batch.column("role").to_numpy(), batch.column("node").to_numpy()
            for block in blocks(batch.column("text"), lower=True):
                row, key = shingle_sets(block, k)
                start = np.searchsorted(row, np.arange(block.rows + 1))
                part = slice(block.first_row, block.first_row + block.rows)
                ba, bc, br, bd = a[part], c[part], role[part], doc[part]
                new = np.concatenate([[True], (ba[1:] != ba[:-1]) | (bc[1:] != bc[:-1])])
                edges = np.append(np.flatnonzero(new), block.rows)
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if br[lo] == 0:
                        query, name = key[start[lo] : start[lo + 1]], (ba[lo], bc[lo])
                    at = lo + int((br[lo:hi] == 0).sum())
                    if at == hi or name != (ba[lo], bc[lo]):
                        continue
                    span = slice(start[at], start[hi])
                    won = divide_skip(query, np.diff(start[at : hi + 1]), row[span] - at, key[span], percent)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(won), ba[lo])), pa.array(bd[at:hi][won])], ["a", "b"])

    return rows.select("a", "chunk", "role", "node", "text").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _cross(placed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of rows (key, node, n, c) with one key, different components and sizes and places that allow the similarity.

    Rows meet by key and band of sizes only, and a long list is dealt in chunks of about JOIN_CHUNK. Of two components one is
    not the key's largest, so only rows of the others look for partners: many near copies that share a shingle with a few other rows
    make as many pairs as there are such rows for each, not pairs among themselves. The lists are written on the way: one plan of all
    of it would have its many stages, and what the driver keeps of their tasks, at once.
    """
    size = F.expr(f"n div {PACK}")
    band = F.floor(F.log(size.cast("double")) / math.log(100 / percent)).cast("int")
    rows = placed.select("key", "node", "c", size.alias("size"), (F.col("n") % PACK).alias("at"), band.alias("band"))
    counts = rows.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / JOIN_CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")
    largest = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "c")).alias("top"))
    tops = written(counts.join(largest.select("key", F.col("top.c").alias("top")), "key"), "tops")  # one row for each row of counts
    x = rows.join(tops, ["key", "band"]).where("c <> top").select("key", "band", chunk.alias("chunk"), *[F.col(c).alias(f"x_{c}") for c in ("node", "c", "size", "at")])
    # one band more on either side against rounding
    near = rows.withColumn("band", F.explode(F.sequence(F.col("band") - 2, F.col("band") + 2))).join(tops, ["key", "band"])
    y = near.select("key", "band", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), *[F.col(c).alias(f"y_{c}") for c in ("node", "c", "size", "at")])
    # after their first common shingle two sets share at most the rest of either
    rest = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    fits = (F.least("x_size", "y_size") * 100 >= F.greatest("x_size", "y_size") * percent) & (rest * (100 + percent) >= (F.col("x_size") + F.col("y_size")) * percent)
    pairs = x.join(y, ["key", "band", "chunk"]).where((F.col("x_c") != F.col("y_c")) & fits)
    return pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def linked_rows(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, tag, n, label, component_id) of every row; equal labels are one component."""
    with small_batches(docs.sparkSession):
        return _linked_rows(docs, k, percent)


def _linked_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    keys = lambda block: shingle_sets(block, k)
    few, hot = hot_keys(docs, keys, lower=True)
    frequent = frequency_classes(docs, keys, lower=True)
    every = written(profiles(docs, hot, frequent, k, percent).withColumn("set", F.xxhash64("h1", "h2", "n")), "profiles")
    named = every.where("doc_id is not null and n > 0")
    nodes = named.groupBy("set").agg(F.min(F.struct("doc_id", "tag")).alias("r")).select("set", "r.doc_id", "r.tag")
    # a class is known by its smallest doc_id; if that has several texts, the others get numbers above 2**61
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("tag"))
    number = F.when(nth == 1, F.col("doc_id")).otherwise(F.col("set").bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 61)))
    nodes = written(nodes.withColumn("node", number), "nodes")
    sides = named.join(nodes, ["set", "doc_id", "tag"]).dropDuplicates(["node"])
    sides = written(sides.select("node", "n", "bits", "prefix"), "sides")
    # size and place of a shingle in the prefix, packed into one number
    entries = sides.select(F.posexplode("prefix").alias("i", "key"), "node", "n")
    entries = entries.select("key", F.col("node").alias("doc_id"), F.col("node").alias("tag"), (F.col("n") * PACK + F.col("i")).alias("n"))
    common = written(entries.join(F.broadcast(few), "key"), "common")  # at most HOT_KEYS keys
    ends = common.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
    shared = recurring(entries.join(F.broadcast(few), "key", "left_anti")).unionByName(common.join(F.broadcast(ends), "key"))
    shared = written(shared.withColumnRenamed("doc_id", "node"), "shared")
    stars = shared.select(F.explode(F.array("low", "high")).alias("a"), F.col("node").alias("b")).where("a <> b")
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = written(bounded_pairs(stars, sides, percent), "tried")
    places = nodes.select("node", "doc_id", "tag")
    links = written(verified(tried, places, docs, k, percent), "links")
    first = written(components(links), "first")
    placed = shared.join(first, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
    placed = written(placed, "placed")
    split = placed.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("key")
    mixed = written(placed.join(split, "key", "left_semi"), "mixed")
    cross = written(_cross(mixed, percent), "cross")
    late = written(bounded_pairs(cross.join(tried, ["a", "b"], "left_anti"), sides, percent), "late")
    # the first components stand for their links
    final = components(first.select("node", "component").unionAll(verified(late, places, docs, k, percent)), "node", "component")
    member = written(nodes.join(final, "node", "left").select("set", "doc_id", F.coalesce("component", "node").alias("label")), "member")
    least = member.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    member = member.join(least, "label").select("set", "label", "component_id")
    apart = F.col("doc_id").isNull() | (F.col("n") == 0)
    found = every.join(member.withColumnRenamed("label", "found"), "set", "left")
    return found.select("doc_id", "tag", "n", F.when(~apart, F.col("found")).alias("label"), F.when(apart, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return linked_rows(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: a row with the smallest doc_id. Rows that link with nothing stay."""
    rows = written(linked_rows(docs).where("label is not null"), "linked")
    heads = rows.where("doc_id = component_id")
    first = heads.groupBy("label").agg(F.min("tag").alias("first"))
    others = heads.join(first, "label").where("tag <> first").select("doc_id", "tag")
    gone = rows.where("doc_id <> component_id").select("doc_id", "tag").unionAll(others).distinct()
    return dropped(docs, gone, once=True)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
