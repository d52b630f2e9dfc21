"""Substring deduplication by matching statistics over a sharded FM-index.

A window is 13 consecutive words. Every window has an anchor, the least-hashed 5-word shingle in
it, so equal windows have equal anchors wherever they stand. Anchors that occur in two different
texts or more are found first; only the stretches of words around them (the windows of one anchor,
together) are fragments. Fragments are dealt to shards by anchor, equal ones once, and each shard
builds an FM-index over its fragments, streams them against it, and reports for each position that
matches 13 words or more the smallest doc_id that has this window. A word goes if a window that
covers it is owned by a smaller doc_id than its own.

Windows of an anchor from the hot list are dealt one by one, by the whole window, so that a passage
of a large share of the corpus meets in no single shard. Documents with one word sequence are one
query: all windows of the first of them are searched, and what the index reports for it holds for the
others, which lose the words of every window that it says begins in the first one or before.

Defined cases: null and empty texts have no words and the digest of an empty text; fewer than 13
words: nothing goes; repeated rows with one doc_id, of one text or several, are judged against other
ids only, each by its own words; a null doc_id owns no window and loses none; very long texts are
fragments like others; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, text_tag, written
from .fmindex import FMIndex
from .recurrent import hot_keys, recurring
from .wordblocks import Block, blocks, mix, shingle_hashes

WINDOW = 13
ANCHOR = 5
SHARD_FRAGMENTS = 40_000
STRETCH = 64
EMPTY = hashlib.sha256(b"").hexdigest()


def window_anchors(words: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """Position of the anchor of each window (leftmost least shingle hash)."""
    h = shingle_hashes(words, anchor)
    w = window - anchor + 1
    if len(h) < w:
        return np.zeros(0, np.int64)
    n = len(h) - w + 1
    best, at = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        less = h[j : j + n] < best
        best[less] = h[j : j + n][less]
        at[less] = j
    return at + np.arange(n)


def _block_anchors(block: Block, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, window start, anchor position, anchor hash) of every window of a block."""
    at = window_anchors(block.hashes, window, anchor)
    start = np.arange(len(at))
    row = block.word_rows()[: len(at)]
    inside = start + window <= block.row_words[1:][row] if len(at) else np.zeros(0, bool)
    row, start, at = row[inside], start[inside], at[inside]
    return row, start, at, shingle_hashes(block.hashes, anchor)[at]


def _row_keys(window: int, anchor: int):
    def keys(block: Block) -> tuple[np.ndarray, np.ndarray]:
        row, _, _, h = _block_anchors(block, window, anchor)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        return row[keep], h[keep]

    return keys


def summaries(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_words, tag, tag2, whole_sha256) of every row; the tags stand for the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), lower=False):
                tags = _sequence_tags(block)
                shas = [hashlib.sha256(b" ".join(w)).hexdigest() for w in _row_word_bytes(block)]
                part = [batch.column(c).slice(block.first_row, block.rows) for c in ("doc_id", "row")]
                arrays = [*part, pa.array(block.counts()), pa.array(tags[0]), pa.array(tags[1]), pa.array(shas, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "n_words", "tag", "tag2", "whole_sha256"])

    return docs.mapInArrow(run, "doc_id long, row long, n_words long, tag long, tag2 long, whole_sha256 string")


def _sequence_tags(block: Block) -> np.ndarray:
    out = np.zeros((2, block.rows), np.uint64)
    row = block.word_rows()
    place = (np.arange(len(row)) - block.row_words[row]).astype(np.uint64)
    for j, salt in enumerate((1, 7)):
        np.add.at(out[j], row, mix(block.hashes + mix(place + np.uint64(salt << 40))))
    return out.view(np.int64)


def _row_word_bytes(block: Block) -> Iterator[list[bytes]]:
    body = block.data.tobytes()
    starts, ends = block.starts.tolist(), block.ends.tolist()
    for a, b in zip(block.row_words[:-1].tolist(), block.row_words[1:].tolist()):
        yield [body[starts[i] : ends[i]] for i in range(a, b)]


def anchor_entries(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, doc_id, tag, n): the anchors of each row, each once; n is not used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _row_keys(window, anchor)
        for batch in batches:
            for block in blocks(batch.column("text"), lower=False):
                row, key = keys(block)
                doc = batch.column("doc_id").slice(block.first_row, block.rows).to_numpy()
                tag = _sequence_tags(block)[0]
                arrays = [pa.array(key.view(np.int64)), pa.array(doc[row]), pa.array(tag[row]), pa.array(np.zeros(len(row), np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "tag", "n"])

    return docs.mapInArrow(run, "key long, doc_id long, tag long, n long")


def fragments(rows: DataFrame, hot: np.ndarray, window: int, anchor: int) -> DataFrame:
    """(shard_key, body, doc_id, row, start) of rows (doc_id, row, text, keys, whole): stretches around the listed anchors.

    Of a row that is searched as a whole the stretches between them are fragments too, of ``STRETCH``
    windows at most, as a shard searches all its fragments word by word side by side.

    A body holds the words as text, one space between them, which packs far better than hashes.
    """
    shared = rows.sparkSession.sparkContext.broadcast(np.sort(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            for block in blocks(batch.column("text"), lower=False, tidy=True):
                row, start, at, key = _block_anchors(block, window, anchor)
                part = slice(block.first_row, block.first_row + block.rows)
                listed = [np.asarray(x, np.int64).view(np.uint64) for x in batch.column("keys")[part].to_numpy(zero_copy_only=False)]
                known_row = np.repeat(np.arange(block.rows), [len(x) for x in listed])
                known = np.concatenate(listed) if listed else np.zeros(0, np.uint64)
                # a (row, key) pair is looked up by a mixed code; the codes of one block do not meet but by a 64-bit accident, which only adds work
                code = lambda r, k: mix(k ^ mix(r.astype(np.uint64) + np.uint64(1)))
                pick = np.isin(code(row, key), code(known_row, known))
                is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key if len(hot) else np.zeros(len(key), bool)
                pick |= is_hot
                alone = ~pick & batch.column("whole")[part].to_numpy(zero_copy_only=False)[row]
                pick |= alone
                row, start, at, key, is_hot, alone = row[pick], start[pick], at[pick], key[pick], is_hot[pick], alone[pick]
                new = np.ones(len(at), bool)
                new[1:] = (start[1:] != start[:-1] + 1) | is_hot[1:] | (alone[1:] != alone[:-1]) | (~alone[1:] & (at[1:] != at[:-1]))
                place = np.arange(len(at))
                new |= alone & ((place - np.maximum.accumulate(np.where(new, place, 0))) % STRETCH == 0)
                head = np.flatnonzero(new)
                last = np.append(head[1:], len(at)) - 1
                doc, number = (batch.column(c).slice(block.first_row, block.rows).to_numpy() for c in ("doc_id", "row"))
                words = block.hashes
                lo, hi = start[head], start[last] + window if len(at) else start[head]
                data = block.data.tobytes()
                body = [data[a:b] for a, b in zip(block.starts[lo].tolist(), block.ends[hi - 1].tolist())]
                route = key[head].copy()
                single = is_hot[head]
                if single.any():
                    route[single] = shingle_hashes(words, window)[lo[single]]
                offset = lo - block.row_words[row[head]]
                arrays = [pa.array(route.view(np.int64)), pa.array(body, pa.binary()), pa.array(doc[row[head]]), pa.array(number[row[head]]), pa.array(offset.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["shard_key", "body", "doc_id", "row", "start"])

    return rows.select("doc_id", "row", "text", "keys", "whole").mapInArrow(run, "shard_key long, body binary, doc_id long, row long, start int")


def shard_owners(distinct: DataFrame, shards: int, window: int) -> DataFrame:
    """(shard_key, fragment, owners): per window of a fragment the smallest doc_id that has it.

    A fragment is known by the hash of its anchor and the hash of its bytes.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pa.array(list(pdf["body"]), pa.large_binary()).view(pa.large_string())
        bodies = [w for block in blocks(texts, lower=False) for w in np.split(block.hashes, block.row_words[1:-1])]
        index = FMIndex(bodies, pdf["owner"].to_numpy(), window)
        _, owner = index.matching(bodies)
        cut = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        owners = [owner[a : b - window + 1] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return pd.DataFrame({"shard_key": pdf["shard_key"], "fragment": pdf["fragment"], "owners": owners})

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("shard_key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "shard_key long, fragment long, owners array<long>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag().alias("row"), text_or_empty().alias("text"))
    known = docs.where("doc_id is not null")
    every = written(summaries(docs), "summaries")
    first = every.where("doc_id is not null").groupBy("tag", "tag2", "n_words").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.max("doc_id").alias("last_id"))
    first = first.select("tag", "tag2", "n_words", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"), (F.col("last_id") > F.col("first.doc_id")).alias("whole"))
    every = written(every.join(first, ["tag", "tag2", "n_words"], "left"), "firsts")
    few, hot = hot_keys(docs, _row_keys(window, anchor), lower=False)
    shared = recurring(anchor_entries(known, window, anchor).join(F.broadcast(few), "key", "left_anti"))  # at most HOT_KEYS rows
    lists = shared.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # rows of one id share a list; what a row does not have is not found in it
    asked = every.where("doc_id = first_id and row = first_row").where(F.col("n_words") >= window).select("doc_id", "row", "whole").distinct()
    # a document without recurring anchors of its own may still have hot ones
    asked = asked.join(lists, "doc_id", "left").select("doc_id", "row", "whole", F.coalesce("keys", F.array().cast("array<long>")).alias("keys"))
    made = fragments(known.join(asked, ["doc_id", "row"]), hot, window, anchor).withColumn("fragment", F.xxhash64("body"))
    made = written(made, "fragments")
    distinct = made.groupBy("shard_key", "fragment").agg(F.min("doc_id").alias("owner"), F.first("body").alias("body"))
    shards = max(64, -(-made.count() // SHARD_FRAGMENTS))
    owners = written(shard_owners(distinct, shards, window), "owners")
    hits = made.select("shard_key", "fragment", "doc_id", "row", "start").join(owners, ["shard_key", "fragment"])
    starts = F.expr("transform(filter(sequence(0, size(owners) - 1), i -> owners[i] < doc_id), i -> start + i)")
    found = F.size(F.filter("owners", lambda o: o >= 0))
    cuts = hits.select("doc_id", "row", found.alias("found"), starts.alias("s")).groupBy("doc_id", "row")
    cuts = written(cuts.agg(F.sum("found").alias("found"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("starts")), "cuts")
    touched = cut_rows(known.join(cuts.where("size(starts) > 0").select("doc_id", "row", "starts"), ["doc_id", "row"]), window).dropDuplicates(["doc_id", "row"])
    of_first = cuts.select(F.col("doc_id").alias("first_id"), F.col("row").alias("first_row"), "found")
    touched = touched.select(F.col("doc_id").alias("first_id"), F.col("row").alias("first_row"), "n_removed", "kept_sha256")
    out = every.join(of_first, ["first_id", "first_row"], "left").join(touched, ["first_id", "first_row"], "left")
    # every window of the first document was found, so each begins in it or before
    gone = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window) & (F.col("found") >= F.col("n_words") - (window - 1))
    same = F.col("doc_id") == F.col("first_id")
    return out.select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce(F.when(same, F.col("n_removed")), F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce(F.when(same, F.col("kept_sha256")), "whole_sha256")).alias("kept_sha256"),
    )


def cut_rows(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, n_removed, kept_sha256) of rows (doc_id, row, text, starts) without the words of the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("starts")
            for block in blocks(batch.column("text"), lower=False):
                gone, shas = [], []
                for i, words in enumerate(_row_word_bytes(block)):
                    at = lists[block.first_row + i].values.to_numpy().astype(np.int64)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    drop = np.cumsum(edge)[:-1] > 0
                    gone.append(int(drop.sum()))
                    shas.append(hashlib.sha256(b" ".join(w for w, d in zip(words, drop.tolist()) if not d)).hexdigest())
                part = [batch.column(c).slice(block.first_row, block.rows) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*part, pa.array(gone, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "row", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "row", "text", "starts").mapInArrow(run, "doc_id long, row long, n_removed long, kept_sha256 string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
