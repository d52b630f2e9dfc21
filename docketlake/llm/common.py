"""Shared pieces of the training-data operators: scratch tables, spread ranks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORDS = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
SUBGROUP = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A folder of our own only where none is set and all runs on one machine."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docketlake-")
        context.setCheckpointDir(found)
    return found


_scratch: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. The table stays until ``drop_scratch``."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For the actions within, an Arrow batch ends at BATCH_BYTES, too, not at a number of rows alone.

    The executor builds a batch outside its heap, in buffers of doubling size, and the worker holds it again; long texts that
    lie side by side would make batches of Spark's 64 MB.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables that this process wrote on the way; call it when all results are stored."""
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_rank(df: DataFrame, groups: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Gapless 0-based rank inside each group without sending a group to one task.

    Rows are dealt over sub-groups of about ``SUBGROUP`` rows (64 at least, for ``rows`` in all) by a
    hash of ``order``; a prefix sum over the sub-group counts gives each sub-group its offset. ``groups`` must have few
    values. Repeated rows get different ranks.
    """
    spread = max(64, -(-rows // SUBGROUP))
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int"))
    counts = df.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets = offsets.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_part").alias("_p"), "_offset")
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    inside = Window.partitionBy(*groups, "_part").orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = ranked.join(F.broadcast(offsets), same)  # groups x max(64, rows / SUBGROUP) rows
    return joined.withColumn(name, (F.col("_rank") + F.col("_offset")).cast("long")).drop(
        "_rank", "_offset", "_part", "_p", *[f"_{g}" for g in groups]
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 60) -> DataFrame:
    """Connected components of an undirected edge table by alternating large-star and small-star.

    Returns (node, component) with the smallest reachable node; nodes without an edge do not occur.
    Every round is written to the shared folder, so a lost executor costs one round at most.
    """
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both_of = lambda df, *pairs: df.select(F.explode(F.array(*pairs)).alias("e")).select("e.u", "e.v")

    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        mark = Observation()
        df = df.where("u <> v").distinct().observe(mark, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        return written(df, "edges"), mark.get

    # a star forest is left as it is, so edges that are one already take a single round
    now, seen = settled(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    for _ in range(limit):
        both = both_of(now, pair("u", "v"), pair("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        before = seen
        now, seen = settled(both_of(large.join(low, "u"), pair("v", "m"), pair("u", "m")))
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    ends = both_of(now, pair("u", "v"), pair("v", "v"))
    return ends.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def text_tag() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64("text")


def dropped(docs: DataFrame, gone: DataFrame, tag: Column | None = None, once: bool = False) -> DataFrame:
    """``docs`` without the rows listed in ``gone`` (doc_id, tag), with all their columns; null ids are compared as equal.

    With ``once`` only one row of equal doc_id and tag stays. Rows meet by two hashes of both, so the
    texts are shuffled once.
    """
    names = [f"row_{i}_{uuid.uuid4().hex}" for i in (1, 2)]
    keys = lambda t: dict(zip(names, (F.xxhash64("doc_id", t), F.xxhash64(F.lit(53), t, F.col("doc_id").isNull(), "doc_id"))))
    out = gone.withColumns(keys(F.col("tag"))).select(*names)
    left = docs.withColumns(keys(text_tag() if tag is None else tag)).join(out, names, "left_anti")
    if once:
        left = left.dropDuplicates(names)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


FEW = 4096


def joined_hot(big: DataFrame, small: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row for each key), whose column ``rows`` counts the key's rows in ``big``.

    A key with more than 1/FEW of all ``total`` rows is joined without a shuffle of its rows: there
    are fewer than FEW such keys, whatever the data, so their rows of ``small`` are broadcast. The
    other keys meet by hash, and none of them holds more than 1/FEW of the rows.
    """
    hot = F.col(rows) * F.lit(FEW) > F.lit(total)
    often = F.broadcast(small.where(hot).drop(rows))
    few = F.broadcast(small.where(hot).select(*keys))
    return big.join(often, keys).unionByName(big.join(few, keys, "left_anti").join(small.where(~hot).drop(rows), keys))


def in_order(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Written in the total order given: column ``part`` (ascending ranges), each part sorted. A long run of equal leading keys spans several parts."""
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return written(dealt.withColumn("part", F.spark_partition_id()), name)
