"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping segments. A segment with at most ``e`` edits shares at
least ``length - q + 1 - q * e`` character q-grams with its copy, all on diagonals within ``e`` of
each other; q-gram hits are therefore counted per document, segment and overlapping diagonal band,
and the bands that reach the bound are verified by banded alignment. A document is contaminated by
an item when verified segments cover at least ``coverage`` of the item, or ``RUN`` normalised
characters of it in a row (two full segments), whatever their share of the item.

Both sides are compared lower-cased, with every run of ASCII characters other than letters
and digits as one space. The benchmark is read to the driver in blocks of about
``BLOCK_BYTES``, whose index is broadcast; a larger benchmark takes one pass over the documents per block, written
before the next block is indexed. The documents never are read to the driver.

A gram that many segments share is expanded last: a band must reach its bound with the other grams
of its segment, of which at most ``q e`` can be missing, so of the grams of a segment only its rarest
``length - bound + 1`` decide where to look, and all of them are counted there.

Defined cases: a null or empty text is clean; an item of fewer than q normalised characters cannot
be located and matches nothing; an empty benchmark leaves all clean; item ids may be of any type
that sorts, come back as they are in order, nulls last, and several items may share one; repeated
rows get equal answers; very long texts are searched whole; extra columns are ignored (or carried by
``drop_contaminated``), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .wordblocks import _BYTE, _power_table, mix, one_space, slices, text_array

Q = 10
SEGMENT = 80
ERROR = 0.08
COVERAGE = 0.5
RUN = SEGMENT + SEGMENT // 2
BLOCK_BYTES = 1 << 20  # some 70 MB of index
ENTRIES = 4 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _a, _b in ((48, 58), (97, 123)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[65:91] = np.arange(97, 123)


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    if len(data) < q:
        return np.zeros(0, np.uint64)
    up, down = _power_table(len(data))
    summed = np.empty(len(data) + 1, np.uint64)
    summed[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=summed[1:])
    return mix((summed[q:] - summed[:-q]) * down[: len(data) - q + 1])


def _fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return one_space(_FOLD[data], offsets)


@dataclass
class Index:
    """Segments of a block of items and the sorted table of their q-grams."""

    items: list
    lengths: np.ndarray
    seg_item: np.ndarray
    seg_from: np.ndarray
    seg_size: np.ndarray
    edits: np.ndarray
    needed: np.ndarray
    text: np.ndarray
    grams: np.ndarray
    gram_from: np.ndarray
    gram_seg: np.ndarray
    gram_pos: np.ndarray
    rare: np.ndarray  # numbers of the entries that are among the rarest of their segment
    rare_from: np.ndarray
    present: np.ndarray

    def entries(self, place: np.ndarray, rare: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number in ``place``, table entry) of the segments that have the grams at ``place``, some millions at a time."""
        start = self.rare_from if rare else self.gram_from
        many = start[place + 1] - start[place]
        total = np.cumsum(many)
        cuts = np.unique(np.searchsorted(total, np.arange(0, int(total[-1]) if len(total) else 0, ENTRIES), "right"))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(place)]):
            n = many[lo:hi]
            hit = np.repeat(np.arange(lo, hi), n)
            which = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[place[lo:hi]], n)
            yield hit, self.rare[which] if rare else which


def build_index(items: list[tuple[object, str]], q: int = Q, segment: int = SEGMENT, error: float = ERROR) -> Index:
    folded = []
    for _, text in items:
        raw = np.frombuffer((text or "").lower().encode(), np.uint8)
        body, _ = _fold(raw, np.array([0, len(raw)]))
        folded.append(np.frombuffer(body.tobytes().strip(), np.uint8))
    size = max([segment, *map(len, folded)])
    seg, grams, pos, owner, bodies = [], [], [], [], []
    for i, body in enumerate(folded):
        if len(body) < q:
            continue
        last = max(0, len(body) - segment)
        for at in sorted({*range(0, last, max(1, segment // 2)), last}):
            piece = body[at : at + segment]
            h = _grams(piece, q)
            grams.append(h)
            pos.append(np.arange(len(h), dtype=np.int32))
            owner.append(np.full(len(h), len(seg), np.int32))
            seg.append((i, at, len(piece)))
            bodies.append(np.pad(piece, (0, segment - len(piece))))
    shape = np.array(seg, np.int64).reshape(-1, 3)
    edits = np.floor(shape[:, 2] * error).astype(np.int64)
    edits = np.minimum(edits, np.maximum(0, (shape[:, 2] - q) // q))
    g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    order = np.argsort(g, kind="stable")
    g = g[order]
    distinct, start = np.unique(g, return_index=True)
    present = np.zeros(1 << 22, bool)
    present[(distinct >> np.uint64(42)).astype(np.int64)] = True
    cat = lambda xs: np.concatenate(xs)[order] if xs else np.zeros(0, np.int64)
    needed, gram_seg = shape[:, 2] - q + 1 - q * edits, cat(owner)
    # a copy lacks at most q * edits grams of its segment, so it has one of the q * edits + 1 rarest
    often = np.repeat(np.diff(np.append(start, len(g))), np.diff(np.append(start, len(g))))
    by_rarity = np.lexsort((often, gram_seg))
    head = np.searchsorted(gram_seg[by_rarity], np.arange(len(seg)))
    rare = np.zeros(len(g), bool)
    rare[by_rarity] = np.arange(len(g)) - head[gram_seg[by_rarity]] <= q * edits[gram_seg[by_rarity]] if len(g) else False
    return Index(
        [k for k, _ in items], np.array([len(b) for b in folded]), shape[:, 0], shape[:, 1], shape[:, 2], edits,
        needed, np.array(bodies, np.uint8).reshape(len(seg), segment if size else 0),
        distinct, np.append(start, len(g)), gram_seg, cat(pos), np.flatnonzero(rare).astype(np.int32), np.searchsorted(np.flatnonzero(rare), np.append(start, len(g))), present,
    )


def align(pieces: np.ndarray, sizes: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least edits of each piece against any stretch of its region, inside the region's band.

    ``regions`` has one row per piece: piece length + band bytes, zero where the document ends.
    """
    n, length = pieces.shape
    band = regions.shape[1] - length
    if not n:
        return np.zeros(0, np.int32)
    steps = np.arange(band + 1, dtype=np.int32)
    cost = np.zeros((n, band + 1), np.int32)
    out = np.full(n, 1 << 20, np.int32)
    for i in range(length):
        differs = regions[:, i : i + band + 1] != pieces[:, i : i + 1] if i + band + 1 <= regions.shape[1] else None
        if differs is None:
            window = np.zeros((n, band + 1), np.uint8)
            window[:, : regions.shape[1] - i] = regions[:, i:]
            differs = window != pieces[:, i : i + 1]
        new = cost + differs
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - steps, axis=1) + steps
        done = sizes == i + 1
        if done.any():
            out[done] = cost[done].min(axis=1)
    return out


def _longest(mask: np.ndarray) -> int:
    """Length of the longest run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def find(data: np.ndarray, offsets: np.ndarray, index: Index, q: int = Q, coverage: float = COVERAGE) -> dict[int, list[tuple[int, float]]]:
    """Per row number: (item number, covered share) of the items that contaminate it."""
    if not len(index.grams):
        return {}
    data, offsets = _fold(data, offsets)
    h = _grams(data, q)
    at = np.flatnonzero(index.present[(h >> np.uint64(42)).astype(np.int64)])
    place = np.searchsorted(index.grams, h[at])
    place[place == len(index.grams)] = 0
    ok = index.grams[place] == h[at]
    at, place = at[ok], place[ok]
    row = np.searchsorted(offsets, at, "right") - 1
    ok = at + q <= offsets[row + 1]  # a gram lies inside one row
    at, place, row = at[ok], place[ok], row[ok]
    row_n, width = len(index.seg_item), int(index.edits.max()) + 1
    span = (len(data) + 4 * SEGMENT) // width + 3

    def bands(hit: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Keys of (row, segment, band): each hit counts in the two bands over its diagonal."""
        seg, r = index.gram_seg[which], row[hit]
        band = (at[hit] - offsets[r] - index.gram_pos[which] + SEGMENT) // width
        base = (r * row_n + seg) * span
        return np.concatenate([base + band, base + np.maximum(band - 1, 0)])

    keys = [np.unique(bands(hit, which)) for hit, which in index.entries(place, rare=True)]
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    if not len(keys):
        return {}
    # all grams are counted, but only in rows and bands that a rare one asks for
    inside = np.isin(row, np.unique(keys // span // row_n))
    at, place, row = at[inside], place[inside], row[inside]
    counts = np.zeros(len(keys), np.int64)
    for hit, which in index.entries(place, rare=False):
        found_keys, n = np.unique(bands(hit, which), return_counts=True)
        spot = np.minimum(np.searchsorted(keys, found_keys), len(keys) - 1)
        same = keys[spot] == found_keys
        counts[spot[same]] += n[same]
    group, band = keys // span, keys % span
    row, seg = group // row_n, group % row_n
    good = counts >= index.needed[seg]
    row, seg, band = row[good], seg[good], band[good]
    found: dict[int, list[tuple[int, float]]] = {}
    cover: dict[tuple[int, int], np.ndarray] = {}
    for lo in range(0, len(row), 4096):
        r, s = row[lo : lo + 4096], seg[lo : lo + 4096]
        first = offsets[r] + band[lo : lo + 4096] * width - SEGMENT - width
        reach = index.text.shape[1] + 4 * width
        cells = first[:, None] + np.arange(reach)
        inside = (cells >= offsets[r][:, None]) & (cells < offsets[r + 1][:, None])
        regions = np.where(inside, data[np.clip(cells, 0, len(data) - 1)], 0).astype(np.uint8)
        edits = align(index.text[s], index.seg_size[s], regions)
        for a, b in zip(r[edits <= index.edits[s]].tolist(), s[edits <= index.edits[s]].tolist()):
            item = int(index.seg_item[b])
            mask = cover.setdefault((a, item), np.zeros(index.lengths[item], bool))
            mask[index.seg_from[b] : index.seg_from[b] + index.seg_size[b]] = True
    for (a, item), mask in cover.items():
        if mask.mean() >= coverage or _longest(mask) >= RUN:
            found.setdefault(a, []).append((item, float(mask.mean())))
    return found


def _indexes(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """An index of each block of the benchmark, and whether it is the last one. Items are dealt by a hash; a block has about BLOCK_BYTES of text."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    rows = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    for b in range(blocks):
        yield build_index([(r.item_id, r.text) for r in rows.where(F.col("block") == b).orderBy("item_id", "text").collect()]), b == blocks - 1


def _batch_hits(batch: pa.RecordBatch, index: Index) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(batch.num_rows)]
    for first, data, offsets in slices(pyarrow.compute.utf8_lower(text_array(batch.column("text")))):
        for row, got in find(data, offsets, index).items():
            out[first + row] = [index.items[i] for i, _ in sorted(got)]
    return out


def _in_order(ids: set) -> list:
    return [*sorted(x for x in ids if x is not None), *([None] if None in ids else [])]


def _passed(rows: DataFrame, shared: Broadcast, last: bool) -> DataFrame:
    """The rows after a block. All passes but the last are written, so that one index at a time is broadcast."""
    if last:
        return rows
    rows = written(rows, "passed")
    shared.destroy()
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_ids) of every row."""
    item = dict(benchmark.dtypes)["item_id"]
    rows = docs.select("doc_id", "text", F.array().cast(f"array<{item}>").alias("item_ids"))
    for index, last in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def mark(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = batch.column("item_ids")
                ids = [_in_order({*a, *b}) for a, b in zip(before.to_pylist(), _batch_hits(batch, shared.value))]
                arrays = [batch.column("doc_id"), batch.column("text"), pa.array(ids, before.type)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "item_ids"])

        rows = _passed(rows.mapInArrow(mark, rows.schema), shared, last)
    return rows.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean rows with all their columns; no shuffle."""
    for index, last in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not x for x in _batch_hits(batch, shared.value)], pa.bool_()))

        docs = _passed(docs.mapInArrow(clean, docs.schema), shared, last)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
