"""Compression of vectors into codes: one codebook for each part position, searched by vantage-point trees.

Components are integers (``floor(scale * x)``), a vector is cut into equal parts, and each part is
replaced by the index of the nearest entry of its position's codebook. Codebooks are refined in a fixed number of rounds; a
round sends only the trees to the tasks and only sums for each entry back. A tree node holds a vantage
entry and the rounded distances of the entries on either side: the least is rounded down, the greatest
up, and so is the distance of the query. By the triangle inequality a side cannot hold a nearer entry if the bound so made is greater
than the best squared distance; sides whose bound is equal are visited, as they may hold an entry
of lower index. What is visited is compared by exact integers.

Defined cases: vectors that are null or hold null or non-finite components are left out; a null
vec_id comes after all others, rows of one vec_id are ordered by their components, and repeated rows are rows of their
own; fewer vectors than entries make a smaller codebook; a null label is a label of its own; an
empty table gives an empty result; vectors of different lengths, or of a length that the parts do not
divide, are an error (there is no common codebook), and so are components of 2**62 or more and squared distances
beyond 64 bits; columns other than the three named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_hot, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LEAF = 3  # entries that are compared one by one
SMALL = 1 << 28  # below this, squared distances of a part fit into 64 bits


@dataclass
class Node:
    """Entries of a leaf, or a vantage entry with two sides and the range of distances (rounded outwards) of each."""

    entries: np.ndarray
    near: Node | None = None
    far: Node | None = None
    near_range: tuple[int, int] = (0, 0)
    far_range: tuple[int, int] = (0, 0)


def _squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = points - entry
    return (gap * gap).sum(axis=-1)


def _outwards(squares: np.ndarray) -> tuple[int, int]:
    low, high = math.isqrt(int(squares.min())), math.isqrt(int(squares.max()))
    return low, high + (high * high < int(squares.max()))


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots rounded down and up."""
    if squares.dtype == object:
        low = np.frompyfunc(math.isqrt, 1, 1)(squares)
    else:
        low = np.sqrt(squares.astype(np.float64)).astype(np.int64)
        low -= low * low > squares
        low += (low + 1) * (low + 1) <= squares
    return low, low + (low * low < squares)


def tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """Vantage-point tree over the rows of ``book``; the vantage entry is the one whose distances spread most."""
    entries = np.arange(len(book)) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(entries)
    squares = np.stack([_squared(book[entries], book[e]) for e in entries])
    spread = [int(row.max()) - int(row.min()) for row in squares]
    at = int(np.argmax(np.array(spread, dtype=float)))
    left, of = np.delete(entries, at), np.delete(squares[at], at)
    order = np.argsort(of, kind="stable")
    half = len(order) // 2
    near, far = order[:half], order[half:]
    return Node(entries[at : at + 1], tree(book, left[near]), tree(book, left[far]), _outwards(of[near]), _outwards(of[far]))


class Search:
    """Nearest entries of many points by one tree."""

    def __init__(self, root: Node, book: np.ndarray, points: np.ndarray):
        self.book, self.points = book, points
        self.best = np.full(len(points), -1, points.dtype)  # -1: nothing seen
        self.code = np.zeros(len(points), np.int64)
        self.compared = 0
        self._visit(root, np.arange(len(points)))

    def _compare(self, entry: int, rows: np.ndarray) -> np.ndarray:
        found = _squared(self.points[rows], self.book[entry])
        best = self.best[rows]
        better = (best < 0) | (found < best) | ((found == best) & (entry < self.code[rows]))
        self.best[rows[better]], self.code[rows[better]] = found[better], entry
        self.compared += len(rows)
        return found

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.near is None:
            for e in node.entries.tolist():
                self._compare(e, rows)
            return
        low, high = roots(self._compare(int(node.entries[0]), rows))
        sides = [(node.near, node.near_range), (node.far, node.far_range)]
        bounds = [np.maximum(np.maximum(low - top, bottom - high), 0) for _, (bottom, top) in sides]
        first = bounds[0] <= bounds[1]
        for mask, order in ((first, (0, 1)), (~first, (1, 0))):
            for side in order:  # the nearer side first, then the other one if it still may hold as near an entry
                may = rows[mask][bounds[side][mask] ** 2 <= self._limit(rows[mask], bounds[side][mask])]
                self._visit(sides[side][0], may)

    def _limit(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        best = self.best[rows]
        return np.where(best < 0, bounds**2, best)


@dataclass
class Codebooks:
    """Entries by part: array (parts, entries, size) of integers."""

    entries: np.ndarray

    def trees(self) -> list[Node]:
        large = self.entries.size and int(np.abs(self.entries).max()) >= SMALL
        return [tree(book.astype(object) if large else book) for book in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.reshape(-1)).encode()).hexdigest()

    def assign(self, points: np.ndarray, trees: list[Node]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), both (rows, parts), of points (rows, parts, size)."""
        books = self.entries
        if points.dtype != object and len(points) and max(int(np.abs(points).max()), int(np.abs(books).max())) >= SMALL:
            points, books = points.astype(object), books.astype(object)
        found = [Search(t, book, points[:, p]) for p, (t, book) in enumerate(zip(trees, books))]
        return np.stack([s.code for s in found], axis=1), np.stack([s.best for s in found], axis=1)


def integers(vectors: DataFrame, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): the vectors that can be coded, as integer components."""
    x = F.col(vector)
    finite = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**62, F.floor(c.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large to be coded")).cast("bigint"))
    return vectors.where(finite).select("vec_id", "label", F.transform(x, whole).alias("v"))


def _points(column: pa.ListArray, parts: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def refined(rows: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    """One round: each entry becomes the mean (rounded down) of the parts nearest to it; unused entries stay."""
    trees = books.trees()
    shape = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(shape, object), np.zeros(shape[:2], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _points(batch.column("v"), parts)
            codes, _ = books.assign(points, trees)
            for p in range(parts):
                for e in range(shape[1]):
                    mine = points[codes[:, p] == e, p]
                    if len(mine):
                        n[p, e] += len(mine)
                        total[p, e] += (mine.astype(object) if int(np.abs(mine).max()) >= SMALL else mine).sum(axis=0).astype(object)
        p, e, at = np.nonzero(np.broadcast_to((n > 0)[:, :, None], shape))
        sums = pa.array([Decimal(x) for x in total[p, e, at]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(at, pa.int32()), sums, pa.array(n[p, e])], ["p", "e", "at", "total", "n"])

    sums = rows.select("v").mapInArrow(add, "p int, e int, at int, total decimal(38,0), n long")
    entries = books.entries.copy()
    for r in sums.groupBy("p", "e", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # as many rows as components in all codebooks
        entries[r.p, r.e, r.at] = int(r.total) // r.n
    return Codebooks(entries)


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``rows`` (see ``integers``), begun with the first vectors by vec_id; None without rows."""
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least is None:
        return None
    if least != most or least % parts:
        raise ValueError(f"vectors of {least} to {most} components cannot be cut into {parts} equal parts each")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = Codebooks(np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = refined(rows, books, parts)
    return books


def encode(rows: DataFrame, books: Codebooks, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distance to what the code stands for."""
    trees = books.trees()
    names = ["vec_id", "label", "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = books.assign(_points(batch.column("v"), parts), trees)
            text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            exact = errors if errors.dtype == object or int(errors.max()) < (1 << 62) // parts else errors.astype(object)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(exact.sum(axis=1).tolist(), pa.int64())], names)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(code: str, books: Codebooks, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for."""
    at = np.frombuffer(bytes.fromhex(code), np.uint8)
    return books.entries[np.arange(len(at)), at].reshape(-1) / scale


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all vectors (vec_id, code, error, label_error), and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    rows = written(integers(vectors, scale), "integers")
    books = codebooks(rows, parts, entries, rounds)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")).limit(0), None
    known, name = F.col("label").isNotNull(), F.coalesce(F.col("label").cast("string"), F.lit(""))
    coded = written(encode(rows, books, parts).select("vec_id", "code", "error", known.alias("known"), name.alias("name")), "codes")
    sums = coded.groupBy("known", "name").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    return joined_hot(coded, sums, ["known", "name"], "rows", coded.count()).select("vec_id", "code", "error", "label_error"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(books.sha256() if books else ""))


def _sql() -> str:
    rounds = []
    for i in range(ROUNDS + 1):
        distance = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
        rounds.append(f"""a{i} AS MATERIALIZED (
  SELECT r, part, min({{'d': d, 'e': e}}) AS m FROM (SELECT p.r, p.part, c.e, {distance}::BIGINT AS d FROM p JOIN c{i} c USING (part)) GROUP BY r, part
)""")
        if i < ROUNDS:
            rounds.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.part, c.e, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
      SELECT part, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT part, m.e AS e, unnest(p.x) AS v, unnest(range(len(p.x))) AS i FROM a{i} JOIN p USING (r, part)) GROUP BY ALL
    ) GROUP BY part, e
  ) n ON n.part = c.part AND n.e = c.e
)""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), p AS MATERIALIZED (
  SELECT r, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS x FROM (SELECT r, v, unnest(range({PARTS})) AS part FROM k)
), c0 AS MATERIALIZED (SELECT part, r - 1 AS e, x FROM p WHERE r <= {ENTRIES}
), {", ".join(rounds)}, f AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS h FROM c{ROUNDS}
), o AS (
  SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM o JOIN k USING (r), f
"""


SQL_OP13 = _sql()
