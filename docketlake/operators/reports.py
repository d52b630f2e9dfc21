"""Reporting tables: crosstabs, totals, shares, tag co-occurrence, samples, ranks, link edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import staging

PROCESSES = ["CE", "EA", "EIS"]


def crosstab(df: DataFrame, key: str, column: str = "process_type", values: list[str] = PROCESSES) -> DataFrame:
    """Counts of key by column with a Total; a fixed value list keeps the columns stable."""
    wide = df.groupBy(key).pivot(column, values).agg(F.count(F.lit(1)))
    cells = [F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values]
    total = sum((F.coalesce(F.col(v), F.lit(0)) for v in values[1:]), F.coalesce(F.col(values[0]), F.lit(0)))
    return wide.select(key, *cells, total.alias("Total"))


def crosstab_with(df: DataFrame, key: str, keep: list[str], column: str = "process_type") -> DataFrame:
    """A crosstab with the sorted distinct values of other columns joined per key."""
    texts = df.groupBy(key).agg(*[F.array_join(F.array_sort(F.collect_set(c)), " | ").alias(c) for c in keep])
    return crosstab(df, key, column).join(texts, key)


def crosstab_with_total(df: DataFrame, key: str, column: str = "process_type", values: list[str] = PROCESSES, label: str = "Total", on_top: bool = False) -> DataFrame:
    """A crosstab and its row of sums by grouping sets, from one scan and one shuffle of partial counts; ``is_total`` sorts the sums last (or first)."""
    cells = [F.count_if(F.col(column) == v).alias(v) for v in values]
    every = F.count_if(F.col(column).isin(values)).alias("Total")
    rows = df.rollup(key).agg(*cells, every, F.grouping(key).cast("int").alias("_g"))
    return rows.select(F.when(F.col("_g") == 1, label).otherwise(F.col(key)).alias(key), *values, "Total", (1 - F.col("_g") if on_top else F.col("_g")).alias("is_total"))


def share(n: Column, *groups: str) -> Column:
    """Percent of the group's sum (of the grand total without groups)."""
    return n / F.sum(n).over(Window.partitionBy(*groups)) * 100


def counts_with_share(df: DataFrame, groups: list[str], within: list[str]) -> DataFrame:
    n = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(share(F.col("n"), *within), 4))


def conditional_counts(df: DataFrame, groups: list[str], **conditions: Column) -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def quantiles(df: DataFrame, groups: list[str], column: str, shares: list[float]) -> DataFrame:
    """Exact percentiles (interpolated between ranks) of each group: groups..., q (an array in the order of ``shares``). Nulls do not count.

    Values are counted first, so equal ones are one row; the rows are then sorted in ranges that may cut
    through a group, and counts of the ranges before give the ranks. No task holds the values of a group.
    """
    key = F.struct(*groups) if groups else F.struct(F.lit(1).alias("all"))
    counts = df.where(F.col(column).isNotNull()).groupBy(key.alias("_g"), F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = counts.repartitionByRange("_g", "_v").sortWithinPartitions("_g", "_v").withColumn("_part", F.spark_partition_id())
    rows = staging.staged(dealt, "values")
    parts = rows.groupBy("_g", "_part").agg(F.sum("_n").alias("_sum"))
    order = Window.partitionBy("_g").orderBy("_part")  # as many rows as ranges
    parts = parts.select("_g", "_part", (F.sum("_sum").over(order) - F.col("_sum")).alias("_start"), F.sum("_sum").over(Window.partitionBy("_g")).alias("_all"))
    inside = F.sum("_n").over(Window.partitionBy("_g", "_part").orderBy("_v")) - F.col("_n")
    ranked = rows.withColumn("_at", inside).join(parts, ["_g", "_part"]).withColumn("_at", F.col("_at") + F.col("_start"))
    at = {p: (F.col("_all") - 1) * F.lit(p) for p in shares}
    holds = lambda i: (F.col("_at") <= i) & (i < F.col("_at") + F.col("_n"))
    sides = [F.max(F.when(holds(rank(place)), F.struct("_v", place.alias("at")))).alias(f"{name}{j}") for j, place in enumerate(at.values()) for name, rank in (("low", F.floor), ("high", F.ceil))]
    found = ranked.groupBy("_g").agg(*sides)
    between = lambda j: F.col(f"low{j}._v") + (F.col(f"high{j}._v") - F.col(f"low{j}._v")) * (F.col(f"low{j}.at") - F.floor(f"low{j}.at"))
    return found.select(*[F.col(f"_g.{g}").alias(g) for g in groups], F.array(*[between(j).cast("double") for j in range(len(shares))]).alias("q"))


def statistics(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    c = F.col(column)
    plain = df.groupBy(*groups).agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.round(F.stddev_samp(c), 6).alias("sd"))
    q = quantiles(df, groups, column, [0.25, 0.5, 0.75]).select(F.struct(*groups).alias("_g"), "q")
    at = lambda i: F.round(F.get("q", F.lit(i)), 6)
    return plain.withColumn("_g", F.struct(*groups)).join(q, "_g", "left").select(*groups, "n", "mean", at(1).alias("median"), "least", "most", "sd", at(0).alias("q1"), at(2).alias("q3"))


def quantile_tiers(df: DataFrame, column: str) -> DataFrame:
    cut = quantiles(df, [], column, [0.4, 0.7, 0.9]).withColumnRenamed("q", "_cut")
    c = F.col(column)
    tier = F.when(c >= F.get("_cut", F.lit(2)), "top").when(c >= F.get("_cut", F.lit(1)), "high").when(c >= F.get("_cut", F.lit(0)), "medium").otherwise("low")
    return df.join(F.broadcast(cut), how="left").withColumn("tier", tier).drop("_cut")  # one row


def tag_rows(df: DataFrame, tags: str, key: str = "project_id") -> DataFrame:
    return df.select(key, F.explode(F.array_distinct(tags)).alias("tag"))


def tag_pairs(df: DataFrame, tags: str, listed: list[str] | None = None, key: str = "project_id") -> DataFrame:
    """(key, tag, other) for each listed tag of a row and every other tag of it, from the row's own array: no join, no shuffle."""
    every = F.array_distinct(tags)
    rows = df.select(key, every.alias("_all"), F.explode(every).alias("tag"))
    if listed is not None:
        rows = rows.where(F.col("tag").isin(listed))
    return rows.select(key, "tag", F.explode("_all").alias("other")).where("tag <> other")


def cooccurrence(df: DataFrame, tags: str, listed: list[str], least: float = 5.0) -> DataFrame:
    """For each listed tag the other tags of its projects: count and percent of the tag's projects above ``least``."""
    total = tag_rows(df, tags).where(F.col("tag").isin(listed)).groupBy("tag").agg(F.count(F.lit(1)).alias("total"))
    n = tag_pairs(df, tags, listed).groupBy("tag", "other").agg(F.count(F.lit(1)).alias("n"))
    out = n.join(total, "tag").withColumn("pct", F.round(F.col("n") * 100.0 / F.col("total"), 1))
    return out.where(F.col("pct") > least)


def cooccurrence_top(df: DataFrame, tags: str, listed: list[str], k: int = 3) -> DataFrame:
    """One row per listed tag with its k most frequent partners side by side."""
    pairs = cooccurrence(df, tags, listed, least=-1.0)
    best = Window.partitionBy("tag").orderBy(F.col("n").desc(), "other")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    wide = ranked.groupBy("tag").pivot("rank", list(range(1, k + 1))).agg(F.first("other").alias("other"), F.first("n").alias("n"))
    names = df.sparkSession.createDataFrame([(t,) for t in listed], "tag string")
    renamed = [F.col(f"{r}_{c}").alias(f"{c}_{r}") for r in range(1, k + 1) for c in ("other", "n")]
    return names.join(wide, "tag", "left").select("tag", *renamed)


def frequent_first(df: DataFrame, key: str, values: str, sep: str = ", ") -> DataFrame:
    """Per key its values in falling frequency, ties by name, joined."""
    n = df.select(key, F.explode(values).alias("v")).groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "v")))
    return n.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["v"]), sep).alias("values"))


def nested_places(df: DataFrame, state: str, counties: str, process: str = "process_type") -> DataFrame:
    """States and their counties as one labelled table with process counts."""
    rows = df.select(F.col(state).alias("state"), F.explode_outer(counties).alias("county"), process)
    label = F.when(F.col("county").isNull(), F.col("state")).otherwise(F.concat(F.lit("  └─ "), "county"))
    level = F.when(F.col("county").isNull(), "State").otherwise("County")
    wide = rows.select("state", label.alias("label"), level.alias("level"), process).groupBy("state", "label", "level").pivot(process, PROCESSES).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumn("Total", sum((F.col(p) for p in PROCESSES[1:]), F.col(PROCESSES[0])))


def sample(df: DataFrame, key: str, n: int, seed: int = 42, strata: list[str] | None = None) -> DataFrame:
    """n rows (of each stratum) in the order of a seeded md5 of the key."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    if not strata:
        return df.orderBy(draw, key).limit(n)
    w = Window.partitionBy(*strata).orderBy(draw, key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def top_with_ties(df: DataFrame, column: str, n: int) -> DataFrame:
    """The rows whose value is not below the n-th largest; only n values meet in one task."""
    least = df.select(column).orderBy(F.col(column).desc_nulls_last()).limit(n).agg(F.min(column).alias("_least"))
    return df.join(F.broadcast(least), F.col(column) >= F.col("_least")).drop("_least")  # one row


def sorted_crosstab(df: DataFrame, key: str, column: str = "process_type", values: list[str] = PROCESSES) -> DataFrame:
    """A crosstab with the largest totals first, ties by key, and a row of sums at the end."""
    return crosstab_with_total(df, key, column, values).orderBy("is_total", F.col("Total").desc(), key)


def tag_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Words of list texts such as '["a", "b"]', split at every comma, the most frequent first."""
    bare = F.regexp_replace(column, r'[\[\]"]', "")
    rows = df.select(F.explode(F.split(bare, ",")).alias("tag")).select(F.trim("tag").alias("tag")).where("tag <> ''")
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "tag")


def strict_against_broad(df: DataFrame, broad: str = "project_energy_type", strict: str = "project_energy_type_strict") -> DataFrame:
    """One row: clean projects by both rules, how many the strict one leaves out, and the percent."""
    row = df.agg(F.count_if(F.col(broad) == "Clean").alias("broad"), F.count_if(F.col(strict) == "Clean").alias("strict"))
    return row.select("broad", "strict", (F.col("broad") - F.col("strict")).alias("excluded"), F.round(F.try_divide((F.col("broad") - F.col("strict")) * 100, "broad"), 4).alias("pct"))


def timeline_quality(df: DataFrame) -> DataFrame:
    """One row of counts and percents over timelines: dates, year, duration, long ones, flagged."""
    days = F.col("duration_days")
    parts = {
        "with_dates": F.col("earliest").isNotNull(), "with_year": F.col("year").isNotNull(), "with_duration": days > 0, "over_5_years": days > 5 * 365,
        "over_10_years": days > 10 * 365, "flagged": F.col("needs_review"),
    }
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in parts.items()])
    return row.select("n", *parts, *[F.round(F.try_divide(F.col(k) * 100, "n"), 4).alias(f"pct_{k}") for k in parts])


def sample_documents(projects: DataFrame, documents: DataFrame, pages: DataFrame, preview: int = 500) -> DataFrame:
    """Documents of the given projects with their number of pages and the beginning of the first one."""
    own = documents.join(projects.select("project_id").distinct(), "project_id", "left_semi")
    rows = pages.join(own.select("document_id").distinct(), "document_id", "left_semi")
    n = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"), F.min(F.struct("page_number", F.substring("page_text", 1, preview).alias("t"))).alias("f"))
    return own.join(n, "document_id", "left").select("project_id", "document_id", "document_type", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.col("f.t").alias("preview"))


def tag_candidates(df: DataFrame, tags: str, both: tuple[str, str], but: Column | None = None, order: str = "project_department") -> DataFrame:
    """Projects whose tags contain both words (in any case) and that a flag does not leave out, by department."""
    text = F.lower(F.array_join(tags, "; "))
    rows = df.where(F.contains(text, F.lit(both[0].lower())) & F.contains(text, F.lit(both[1].lower())))
    return (rows if but is None else rows.where(~F.coalesce(but, F.lit(False)))).orderBy(order, "project_id")


def eligible_group(df: DataFrame, key: str, least: int, n: int = 1, seed: int = 42) -> DataFrame:
    """``n`` keys of those with at least ``least`` rows, in a seeded order."""
    return sample(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), key, n, seed)


def per_project_strata(documents: DataFrame) -> DataFrame:
    """Projects by number of documents in strata 1, 2, 3-5, 6+: count and percent."""
    n = documents.groupBy("project_id").agg(F.count(F.lit(1)).alias("d"))
    stratum = F.when(F.col("d") == 1, "1").when(F.col("d") == 2, "2").when(F.col("d") <= 5, "3-5").otherwise("6+")
    out = n.select(stratum.alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("projects"))
    return out.withColumn("pct", F.round(share(F.col("projects")), 4))


def match_rates(compared: DataFrame, columns: list[str]) -> DataFrame:
    """Of ``compare``: per column how many keys have both values, how many agree, and the percent."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"match_{c}").alias("m")) for c in columns]
    rows = compared.select(F.explode(F.array(*parts)).alias("x")).select("x.column", "x.m")
    n = rows.groupBy("column").agg(F.count("m").alias("both"), F.count_if("m").alias("agree"))
    return n.withColumn("pct", F.round(F.try_divide(F.col("agree") * 100, "both"), 4))


def multi_value_table(df: DataFrame, column: str, sep: str = ", ") -> DataFrame:
    """Crosstab of rows with several values by the list of them, largest first, without the first row; labelled by the values."""
    rows = df.where(F.size(column) > 1).withColumn("_list", F.to_json(column))
    table = crosstab(rows, "_list").join(rows.select("_list", F.array_join(column, sep).alias("label")).distinct(), "_list")
    ranked = table.withColumn("_r", F.row_number().over(Window.orderBy(F.col("Total").desc(), "_list")))  # one row for each list
    return ranked.where("_r > 1").select("label", *PROCESSES, "Total")


def places_by_latitude(lists: DataFrame, places: DataFrame, key: str = "list_id", values: str = "states", weight: str = "n") -> DataFrame:
    """Per list its places from south to north and its weight, which is the same in all of its rows."""
    rows = lists.select(key, weight, F.explode(values).alias("name")).join(F.broadcast(places), "name")  # a table of places
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("lat", "name"))), lambda x: x["name"])
    return rows.groupBy(key).agg(ordered.alias("ordered"), F.max(weight).alias(weight))


def top_connections(df: DataFrame, column: str, kinds: str, n: int = 10, sep: str = " - ") -> DataFrame:
    """The ``n`` most frequent lists of several values: label, process counts, and their kinds in falling frequency."""
    rows = df.where(F.size(column) > 1).withColumn("label", F.array_join(column, sep))
    top = crosstab(rows, "label").orderBy(F.col("Total").desc(), "label").limit(n)
    return top.join(frequent_first(rows, "label", kinds).withColumnRenamed("values", "kinds"), "label", "left")


def compare(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Two sources side by side with equality flags, null unless both are there."""
    joined = left.alias("l").join(right.alias("r"), key)
    out = [key]
    for c in columns:
        a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
        out.append(F.when(a.isNotNull() & b.isNotNull(), a == b).alias(f"match_{c}"))
    return joined.select(*out)


def link_edges(lists: DataFrame, places: DataFrame, values: str = "states", weight: str = "n", key: str = "list_id") -> DataFrame:
    """Weighted edges between neighbours of each list, ordered from south to north by latitude."""
    rows = lists.select(key, weight, F.explode(values).alias("name")).join(F.broadcast(places), "name")  # a table of places
    order = Window.partitionBy(key).orderBy("lat", "name")
    rows = rows.withColumn("to", F.lead("name").over(order)).where("to is not null")
    edges = rows.groupBy(F.col("name").alias("from"), "to").agg(F.sum(weight).alias("n"))
    at = lambda s: places.select(F.col("name").alias(s), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))
    edges = edges.join(F.broadcast(at("from")), "from", "left").join(F.broadcast(at("to")), "to", "left")
    return edges.withColumn("lon_mid", (F.col("lon_from") + F.col("lon_to")) / 2)


def in_box(edges: DataFrame, lon: tuple[float, float] = (-130, -66), lat: tuple[float, float] = (20, 50)) -> DataFrame:
    ok = F.lit(True)
    for s in ("from", "to"):
        ok &= F.col(f"lon_{s}").between(*lon) & F.col(f"lat_{s}").between(*lat)
    return edges.where(ok)
