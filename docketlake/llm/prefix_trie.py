"""Prefix trie of conversations by preorder intervals, with what a shared prefix saves.

A node is a distinct sequence of first turns. Nodes are keyed by 128-bit digests that are prefix
combinations (exclusive or) of position-salted digests of the turns, so a long conversation is
keyed in blocks. Each node has a short path key: the conversation's way from the root, told by the
places where it leaves the child with most conversations. As such a step halves the members, a key has at
most log2(conversations) entries, however deep the node is. The lexicographic order of the keys
is a preorder in which the fullest child comes last, so the last node of a subtree is the bottom of
that chain of fullest children, which gives the subtree's end. Leaves and savings of a subtree are
then differences of prefix sums at both ends of its interval.

Defined cases: rows without conv_id belong to no conversation and are left out; turns of equal
number are ordered by role, then by the digest of the text; repeated rows are turns of their own; null role or
text counts as empty; texts of any length are digested whole; an empty table has no node, not
even a root; columns other than conv_id, turn, role and text are ignored, whatever their names.
Siblings are in the order of their digests, not of their texts; no result depends on that order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_order, joined_hot, partitions, table, written

BLOCK = 4096  # turns of one conversation that one task may see in a row
IDS = 512  # ids that are joined at a time on the way to a digest
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
KEY = ["k1", "k2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, digest, bytes): the turns in order, numbered from 1. The texts are digested before any shuffle.

    Turns are sorted by ranges that may cut through a conversation; counts of the ranges before give each
    range its first number.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = in_order(rows, ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"], "turns")
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "digest"))
    counts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    out = rows.withColumn("n", inside).join(starts, ["conv_id", "part"])
    return out.select("conv_id", (F.col("n") + F.col("start")).alias("n"), "digest", "bytes")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, last, bytes, k1, k2, p1, p2) of turns (conv_id, depth, last, digest, bytes): the key of each prefix and of the one before it."""
    salted = turns.select(
        "conv_id", "depth", "last", "bytes", F.floor((F.col("depth") - 1) / BLOCK).alias("block"),
        F.xxhash64("depth", "digest").alias("t1"), F.xxhash64(F.lit(29), "digest", "depth").alias("t2"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = salted.select("*", F.bit_xor("t1").over(inside).alias("x1"), F.bit_xor("t2").over(inside).alias("x2"))
    totals = salted.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"s{i}") for i in (1, 2)])
    keyed = own.join(starts, ["conv_id", "block"]).withColumns({f"k{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"s{i}")) for i in (1, 2)})
    return keyed.select("conv_id", "depth", "last", "bytes", *KEY, *[F.col(f"k{i}").bitwiseXOR(F.col(f"t{i}")).alias(f"p{i}") for i in (1, 2)])


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, conv_id): digest of the ascending ids of each key, joined by commas.

    Ids are sorted in ranges that may cut through a key and joined in pieces there; a key's pieces
    then stream through its digest, which takes one piece at a time.
    """
    columns = "k1 long, k2 long, first long, ids string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], 0
            k1, k2, ids = (batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id"))
            for i in range(1, len(ids) + 1):
                if i == len(ids) or i - at == IDS or k1[i] != k1[at] or k2[i] != k2[at]:
                    rows.append((k1[at], k2[at], ids[at], ",".join(map(str, ids[at:i]))))
                    at = i
            parts = list(zip(*rows)) or [(), (), (), ()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, types)], ["k1", "k2", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if (a, b) == key:
                    state.update(b"," + text.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(text.encode())
            yield digests(out)
        yield digests([(*key, state.hexdigest())] if key else [])

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        parts = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.int64(), pa.int64(), pa.string()))], [*KEY, "ends_sha256"])

    n = partitions(ends.sparkSession)
    sorted_ids = ends.repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = sorted_ids.mapInArrow(join, columns).repartition(n, *KEY).sortWithinPartitions(*KEY, "first")
    return pieces.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _hex(value: Column, width: int) -> Column:
    return F.lpad(F.hex(value), width, "0")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, depth from 1, last, digest, bytes); ``members`` (conv_id, length) has turnless conversations too.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    interval of the subtree in preorder: preorder, subtree_end (both counted from 1, inclusive).
    """
    steps = written(prefixes(turns), "steps")
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    grouped = steps.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_convs")
    )
    nodes = written(grouped, "nodes")
    n_steps, n_nodes = steps.count(), nodes.count()

    # of each parent: its children, the fullest of them, and its own first conversation
    root = top.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    children = nodes.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", *KEY)).alias("full"))
    parents = nodes.select(*KEY, "conv_id").unionByName(root).join(children.withColumnsRenamed({"p1": "k1", "p2": "k2"}), KEY)
    parents = written(parents.select(*KEY, "n_children", F.col("conv_id").alias("parent_conv_id"), F.col("full.k1").alias("f1"), F.col("full.k2").alias("f2")), "parents")
    below = joined_hot(nodes, parents.withColumnRenamed("n_children", "rows").withColumnsRenamed({"k1": "p1", "k2": "p2"}), ["p1", "p2"], "rows", n_nodes)
    below = below.withColumn("light", (F.col("k1") != F.col("f1")) | (F.col("k2") != F.col("f2"))).select(*KEY, "conv_id", "depth", "bytes", "n_convs", "parent_conv_id", "light")
    placed = top.select(
        F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"),
        "n_convs", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(False).alias("light"),
    ).unionByName(below)
    placed = placed.join(parents.select(*KEY, "n_children"), KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    placed = written(placed, "placed")

    # where a conversation leaves the fullest child; at most log2(conversations) places
    left = joined_hot(steps.select("conv_id", "depth", *KEY), placed.where("light").select(*KEY, F.col("n_convs").alias("rows")), KEY, "rows", n_steps)
    exits = left.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", *KEY))).alias("exits"))
    named = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows")).join(exits, "conv_id", "left")
    keyed = joined_hot(placed.drop("light"), named, ["conv_id"], "rows", n_nodes + 1)
    above = F.filter("exits", lambda x: x["depth"] <= F.col("depth"))
    keyed = keyed.withColumn("exits", F.coalesce(above, F.array().cast("array<struct<depth:bigint,k1:bigint,k2:bigint>>")))
    step = lambda x: F.concat(_hex(x["depth"] - 1, 10), F.lit("1"), _hex(x["k1"], 16), _hex(x["k2"], 16))
    path = F.concat(F.array_join(F.transform("exits", step), ""), _hex(F.col("depth"), 10), F.lit("0"))
    last = F.try_element_at("exits", F.lit(-1))
    keyed = keyed.withColumns({"path": path, "c1": F.coalesce(last["k1"], F.lit(0)), "c2": F.coalesce(last["k2"], F.lit(0))}).drop("exits")
    keyed = keyed.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saves": (F.col("n_convs") - 1) * F.col("bytes")})

    # ranks and prefix sums: inside a range, then over the ranges
    ordered = in_order(keyed.drop("bytes"), ["path"], "preorder")
    totals = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("leaf").alias("l"), F.sum("saves").alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "l", "s")])
    inside = Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ordered.withColumns({"n": F.row_number().over(Window.partitionBy("part").orderBy("path")), "l": F.sum("leaf").over(inside), "s": F.sum("saves").over(inside)})
    ranked = ranked.join(F.broadcast(starts), "part").drop("part", "path")  # as many rows as partitions
    ranked = ranked.withColumns({c: F.col(c) + F.col(f"{c}0") for c in ("n", "l", "s")}).drop("n0", "l0", "s0")
    ranked = written(ranked, "ranked")
    ends = ranked.groupBy("c1", "c2").agg(F.max(F.struct("n", "l", "s")).alias("end"), F.count(F.lit(1)).alias("rows"))
    whole = joined_hot(ranked, ends, ["c1", "c2"], "rows", n_nodes + 1)

    stops = steps.where("last").select(*KEY, "conv_id").unionByName(members.where("length = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id"))
    return whole.join(end_digests(stops), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("end.l") - F.col("l") + F.col("leaf")).alias("n_leaves"),
        (F.col("end.s") - F.col("s") + F.col("saves")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        F.col("n").alias("preorder"), F.col("end.n").alias("subtree_end"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table of conversations (conv_id, turn, role, text) as they are."""
    turns = written(numbered(conversations), "numbered")
    members = lengths(turns)
    rows = joined_hot(turns, members.withColumn("rows", F.col("length")), ["conv_id"], "rows", turns.count())
    return trie(rows.select("conv_id", F.col("n").alias("depth"), (F.col("n") == F.col("length")).alias("last"), "digest", "bytes"), members)


FIRST = 8  # turns that a conversation can take from another


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and members after each conversation's first turns are replaced by those of the first of its five."""
    sizes = written(lengths(turns), "lengths")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    plan = sizes.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 5})
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length")), "base", "left")
    taken = F.least("h", F.coalesce("base_length", F.lit(0)))
    plan = written(plan.select("conv_id", "base", "h", taken.alias("taken"), F.col("length").alias("own"), (taken + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")), "plan")
    heads = turns.where((F.col("n") <= FIRST) & (F.col("conv_id") % 5 == 0)).select(F.col("conv_id").alias("base"), "n", "digest", "bytes")
    heads = heads.join(plan, "base").where("n <= taken")
    tails = joined_hot(turns, plan.withColumn("rows", F.col("own")), ["conv_id"], "rows", turns.count()).where("n > h")
    tails = tails.withColumn("n", F.col("n") - F.col("h") + F.col("taken"))
    rows = heads.select(*tails.columns).unionByName(tails)
    return rows.select("conv_id", F.col("n").alias("depth"), (F.col("n") == F.col("length")).alias("last"), "digest", "bytes"), plan.select("conv_id", "length")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(written(numbered(table(spark, sf_dir, "conversations")), "numbered"))).drop("preorder", "subtree_end")


# the checksum of a text of digits, bit by bit
_CRC = """(list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda j: 0::BIGINT)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
SQL_OP11 = f"""
WITH o AS (
  SELECT conv_id, role, text, sha256(octet_length(encode(role)) || ':' || role || text) AS g,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(octet_length(encode(role)) || ':' || role || text)) AS n
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, count(*) AS len, xor({_CRC}, 4294967295) % 9 AS h, conv_id - conv_id % 5 AS b FROM o GROUP BY conv_id
), r AS (
  SELECT c.conv_id, o.n AS d, g, text FROM c JOIN o ON o.conv_id = c.b AND o.n <= c.h
  UNION ALL
  SELECT c.conv_id, o.n - c.h + least(c.h, coalesce(x.len, 0)), g, text FROM c JOIN o ON o.conv_id = c.conv_id LEFT JOIN c x ON x.conv_id = c.b WHERE o.n > c.h
), p AS (
  SELECT conv_id, d, text, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
  UNION ALL SELECT conv_id, 0, '', '' FROM c
), e AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, path, row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) AS i FROM p) WHERE i = 1 GROUP BY path
), n AS (
  SELECT path, min(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, min(octet_length(encode(text))) AS bytes, left(path, (min(d) - 1) * 64) AS up FROM p GROUP BY path
), k AS (SELECT up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up
), s AS (
  SELECT left(path, i * 64) AS path, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM (SELECT n.path, n_convs, bytes, n_children, unnest(range(0, d + 1)) AS i FROM n LEFT JOIN k ON k.up = n.path) GROUP BY 1
)
SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN m.conv_id END AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN n m ON m.path = n.up AND n.d > 0 LEFT JOIN k ON k.up = n.path JOIN s ON s.path = n.path LEFT JOIN e ON e.path = n.path
"""
