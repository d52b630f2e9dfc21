"""Search by pattern in pages, with an index of trigrams."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matches import literals
from ..sources import staging

GRAM = 3
BLOCK_PAGES, BLOCK_BYTES = 8192, 4 << 20  # pages of a block of the index, and bytes of their texts, at most


def _packing(most_pages: int, most_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches (key..., text): for each block of pages a row with its keys (gram is null), and one for each gram with a bit for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1).cast(pa.binary())
            keys = pa.StructArray.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            first = 0
            while first < len(text):
                last = max(first + 1, min(first + most_pages, int(np.searchsorted(ends, ends[first] + most_bytes, "right")) - 1))
                n, at = last - first, ends[first : last + 1] - ends[first]
                body = data[ends[first] : ends[last]].astype(np.int32)
                page = np.repeat(np.arange(n), np.diff(at))
                # three bytes of ASCII in one page: no other gram is ever looked up
                inside = (body[:-2] < 128) & (body[1:-1] < 128) & (body[2:] < 128) & (page[:-2] == page[2:])
                gram = (body[:-2] << 14 | body[1:-1] << 7 | body[2:]).astype(np.int64)
                places = np.unique((gram * n + page[:-2])[inside])
                grams, row = np.unique(places // n, return_inverse=True)
                width = -(-n // 8)
                bits = np.zeros(len(grams) * width, np.uint8)
                byte = row * width + places % n // 8  # in ascending order, as the places are
                starts = np.flatnonzero(np.diff(byte, prepend=-1))
                if len(starts):
                    bits[byte[starts]] = np.bitwise_or.reduceat((1 << places % n % 8).astype(np.uint8), starts)
                names = [None, *(bytes((g >> 14, g >> 7 & 127, g & 127)).decode() for g in grams.tolist())]
                rows = pa.array([None, *map(bytes, bits.reshape(len(grams), width))], pa.binary())
                own = pa.ListArray.from_arrays(pa.array([0] + [n] * len(names), pa.int32()), keys.slice(first, n), mask=pa.array([False] + [True] * len(grams)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([uuid.uuid4().hex] * len(names)), rows, own], names=["gram", "block", "bits", "keys"])
                first = last

    return run


def trigram_index(pages: DataFrame, key: list[str], text: str, path: str | None = None) -> DataFrame:
    """The lower-cased trigrams (of ASCII) of each page, packed by blocks of pages: (gram, block, bits, keys). Kept at ``path``, or for this run.

    A gram's row has a bit for each page of the block; the row without a gram has the block's keys. Blocks are made where the pages are, so
    nothing is shuffled, and each file is in order of grams, so that a lookup reads few row groups of it.
    """
    lowered = F.lower(text)
    rows = pages.where(F.length(text) >= GRAM).select(*key, lowered.alias("_text"))
    keys = rows.drop("_text").schema.simpleString()
    rows = rows.mapInArrow(_packing(BLOCK_PAGES, BLOCK_BYTES), f"gram string, block string, bits binary, keys array<{keys}>").sortWithinPartitions("gram", "block")
    if path is None:
        return staging.staged(rows, "grams")
    rows.write.mode("overwrite").option("compression", "zstd").option("parquet.bloom.filter.enabled#gram", "true").parquet(path)
    return pages.sparkSession.read.schema(rows.schema).parquet(path)


def required(pattern: str) -> list[str]:
    """Lower-cased trigrams that each text matching the pattern (in any case) contains; none for patterns with choices or groups."""
    if re.search(r"[|(]", pattern) or not pattern.isascii():
        return []
    return sorted({r[j : j + GRAM] for r in literals(pattern) for j in range(len(r) - GRAM + 1)})


def candidates(index: DataFrame, key: list[str], grams: list[str]) -> DataFrame:
    """Keys of the pages that have all of the grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bits, keys in zip(batch.column("bits"), batch.column("keys")):
                every = np.bitwise_and.reduce([np.frombuffer(b.as_buffer(), np.uint8) for b in bits.values])
                own = keys.values.take(pa.array(np.flatnonzero(np.unpackbits(every, bitorder="little"))))
                yield pa.RecordBatch.from_arrays(own.flatten(), names=[f.name for f in own.type])

    found = index.where(F.col("gram").isin(grams)).groupBy("block").agg(F.collect_list("bits").alias("bits")).where(F.size("bits") == len(grams))
    rows = found.join(index.where("gram is null").select("block", "keys"), "block").select("bits", "keys")
    return rows.mapInArrow(run, index.schema["keys"].dataType.elementType).select(*key)


def search(pages: DataFrame, text: str, key: list[str], pattern: str, window: int = 200, index: DataFrame | None = None) -> DataFrame:
    """key..., context: the pages that match the pattern (in any case), with the text around the first place where it stands literally (null if nowhere).

    With an ``index`` of the pages only those are read that have all trigrams that the pattern requires; a pattern that requires none is
    searched everywhere.
    """
    grams = required(pattern)
    if index is not None and grams:
        pages = pages.join(candidates(index, key, grams), key, "left_semi")
    rows = pages.where(F.col(text).rlike(f"(?i){pattern}")).withColumn("_at", F.locate(pattern.lower(), F.lower(text)))
    low, high = F.greatest(F.col("_at") - 1 - window, F.lit(0)), F.least(F.col("_at") - 1 + len(pattern) + window, F.length(text))
    body = F.concat(F.when(low > 0, "...").otherwise(""), F.substring(F.col(text), low + 1, high - low), F.when(high < F.length(text), "...").otherwise(""))
    return rows.select(*key, F.when(F.col("_at") > 0, body).alias("context"))
