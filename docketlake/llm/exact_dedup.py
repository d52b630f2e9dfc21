"""Exact deduplication against an immutable snapshot screened by static binary-fuse filters.

A snapshot keeps one row per distinct text (its digest, the smallest doc_id, the row count), dealt
into buckets by digest, and one filter per bucket. Incoming rows are first grouped among
themselves; their digests are screened by the bucket's filter, and only positives go to the exact
join, where the digest and then the bytes of the two representatives are compared.

Defined cases: a null text counts as empty; a null doc_id never becomes keep_id while its group has
another id; rows repeated with the smallest doc_id of their group are all marked as kept, and
``keep_first`` leaves one of them; one doc_id may have several texts, which are rows of their own; an
empty table gives an empty result; columns other than doc_id and text are ignored (or carried by
``keep_first``), whatever their names; texts of any length are digested whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import binaryfuse
from .common import BLANKS, dropped, joined_hot, table, text_or_empty, written
from .wordblocks import one_space, slices

BUCKET_TEXTS = 500_000
LEAST_BUCKETS = 16


def _digests(column: pa.Array) -> pa.Array:
    """Digests of the normalised texts."""
    out = []
    for _, data, offsets in slices(column):
        body, cuts = one_space(data, offsets)
        view = memoryview(body.tobytes())
        out += [hashlib.sha256(view[i:j]).hexdigest() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return pa.array(out, pa.string())


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of the normalised texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _digests(batch.column("text"))], ["doc_id", "text_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_sha256 string")


def with_digest(docs: DataFrame, name: str) -> DataFrame:
    """All columns and the digest of the normalised text as one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _digests(batch.column("text"))], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())]))


def normalised(column: str = "text") -> Column:
    """Every run of blanks as one space; null as empty."""
    return F.regexp_replace(text_or_empty(column), BLANKS, " ")


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct digest; partial aggregation folds a hot digest before the shuffle."""
    return rows.groupBy("text_sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def _keyed(df: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("text_sha256")
    return df.withColumn("key", key).withColumn("bucket", F.pmod(F.shiftright(key, 17), F.lit(buckets)).cast("int"))


@dataclass
class Snapshot:
    """Distinct texts of earlier rows (text_sha256, first_id, n, key, bucket) and the bucket filters."""

    exact: DataFrame
    filters: DataFrame
    buckets: int


def build_snapshot(rows: DataFrame, buckets: int | None = None) -> Snapshot:
    """From digests of immutable rows; a bucket holds about ``BUCKET_TEXTS`` digests unless their number is given."""
    exact = groups(rows)
    if buckets is None:
        exact = written(exact, "groups")
        buckets = max(LEAST_BUCKETS, -(-exact.count() // BUCKET_TEXTS))
    exact = written(_keyed(exact, buckets), "snapshot")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1].to_numpy(), "filter": [binaryfuse.build(keys)]})

    filters = exact.select("bucket", "key").groupBy("bucket").applyInPandas(one, "bucket int, filter binary")
    return Snapshot(exact, written(filters, "filters"), buckets)


def screen(incoming: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Incoming distinct digests with ``maybe``: false means surely new."""

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = left["key"].to_numpy(np.int64).view(np.uint64)
        found = binaryfuse.contains(right["filter"].iloc[0], keys) if len(right) else np.zeros(len(left), bool)
        return left.assign(maybe=found)

    schema = ", ".join(f"{c} {t}" for c, t in incoming.dtypes) + ", maybe boolean"
    return incoming.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(probe, schema)


def _bodies(docs: DataFrame, wanted: DataFrame, side: str) -> DataFrame:
    """(text_sha256, side_id, side_body) of the rows that have a wanted doc_id, each text once."""
    ids = wanted.select(F.col(f"{side}_id").alias("id")).where("id is not null").distinct()
    body = normalised()
    rows = docs.select("doc_id", body.alias("body"), F.sha2(F.encode(body, "UTF-8"), 256).alias("text_sha256"))
    rows = rows.join(ids, rows.doc_id == ids.id, "left_semi").dropDuplicates(["doc_id", "text_sha256"])
    return rows.select("text_sha256", F.col("doc_id").alias(f"{side}_id"), F.col("body").alias(f"{side}_body"))


def dedup_batch(batch: DataFrame, batch_docs: DataFrame, snapshot: Snapshot, old_docs: DataFrame) -> DataFrame:
    """Groups over snapshot and batch (digests of incoming rows, and the rows themselves): (text_sha256, arrives, keep_id, group_size).

    One row per text and side (``arrives``: of the batch). Only digests that pass the filter are
    joined with the snapshot, and only their bytes are read; should two texts share a digest and
    differ, each side keeps its own group.
    """
    fresh = written(screen(_keyed(groups(batch), snapshot.buckets), snapshot), "screened")
    old = snapshot.exact.select("text_sha256", F.col("first_id").alias("old_id"), F.col("n").alias("old_n"))
    maybe = fresh.where("maybe").select("text_sha256", F.col("first_id").alias("new_id"), F.col("n").alias("new_n"))
    hits = written(maybe.join(old, "text_sha256"), "hits")
    checked = hits.join(_bodies(batch_docs, hits, "new"), ["text_sha256", "new_id"], "left").join(_bodies(old_docs, hits, "old"), ["text_sha256", "old_id"], "left")
    # a text without any id cannot be fetched by id; its digest stands for it
    same = F.col("new_body").eqNullSafe(F.col("old_body")) | F.col("old_id").isNull() | F.col("new_id").isNull()
    both = checked.where(same).select("text_sha256", F.least("new_id", "old_id").alias("both_id"), (F.col("new_n") + F.col("old_n")).alias("both_n"))
    both = written(both, "both")
    sides = fresh.select("text_sha256", F.lit(True).alias("arrives"), "first_id", "n").unionAll(snapshot.exact.select("text_sha256", F.lit(False), "first_id", "n"))
    return sides.join(both, "text_sha256", "left").select(
        "text_sha256", "arrives", F.when(F.col("both_n").isNull(), F.col("first_id")).otherwise(F.col("both_id")).alias("keep_id"), F.coalesce("both_n", "n").alias("group_size")
    )


def mark_duplicates(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every row with its group: half of the rows (by a hash of the id) form the snapshot, the others arrive.

    Rows of the largest groups are joined where they are (``joined_hot``), so that no group of copies is one task's.
    """
    docs = docs.select("doc_id", "text")
    arrives = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    rows = written(digests(docs).withColumn("arrives", arrives), "digests")
    found = dedup_batch(rows.where("arrives"), docs.where(arrives), build_snapshot(rows.where("not arrives"), buckets), docs.where(~arrives))
    found = written(found.withColumn("copies", F.col("group_size")), "found")
    # copies of both sides are counted, so twice as many keys as ``joined_hot`` names may be broadcast
    marked = joined_hot(rows, found, ["text_sha256", "arrives"], "copies", rows.count())
    return marked.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: a row that has the smallest doc_id."""
    marks = mark_duplicates(docs)
    gone = marks.where("not kept").select("doc_id", F.col("text_sha256").alias("tag")).distinct()
    name = f"digest_{uuid.uuid4().hex}"
    return dropped(with_digest(docs, name), gone, F.col(name), once=True).drop(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents"))


SQL_OP1 = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
