"""Generation capacity from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.matches import Pattern, all_hits, around, clean, first_of, generated, has_any, holds_any, let, pieces, strip

PATTERNS = [Pattern(str(i), f"(?i){p}", (1, 2, 3)) for i, p in enumerate(fixed.CAPACITY_PATTERNS)]


def number(text: Column) -> Column:
    # an empty group is no number; a cast that fails would make an exception for each
    return F.when(text != "", F.replace(text, F.lit(","), F.lit("")).try_cast("double"))


def unit_of(text: Column) -> Column:
    """Standard unit of a spelling; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in fixed.UNITS.items() for x in kv])
    return F.coalesce(table[F.lower(text)], table[F.regexp_replace(F.lower(strip(text)), r"\s+", " ")])


def confidence(near: Column) -> Column:
    def scored(low: Column) -> Column:
        score = F.when(holds_any(low, fixed.PROJECT_WORDS), 2).otherwise(0)
        score -= F.when(holds_any(low, fixed.HISTORICAL_WORDS), 2).otherwise(0)
        return score - F.when(holds_any(low, fixed.AMBIGUOUS_WORDS), 1).otherwise(0)

    return let(let(F.lower(near), scored), lambda score: F.when(score >= 2, "high").when(score >= 0, "medium").otherwise("low"))


def to_megawatts(value: Column, unit: Column) -> Column:
    return F.when(unit == "GW", value * 1000).when(unit == "kW", value / 1000).otherwise(value)


def extract_capacity(df: DataFrame, text: str, keep: list[str], title: bool = False) -> DataFrame:
    """One row per distinct match text: keep..., match, value, unit, is_energy, confidence, context, ordinal. No shuffle."""
    body, parts = F.col("_text"), F.col("_parts")
    rows = df.select(*keep, F.col(text).alias("_text")).where(body.rlike(rf"(?i)\d\s*-?\s*{fixed.UNIT}"))
    rows = generated(rows, _parts=pieces(body), _hits=all_hits(clean(body), PATTERNS))
    told = lambda h: F.struct(*[h[f].alias(f) for f in ("priority", "start", "match", "groups")], around(parts, h["start"], h["end"], 80).alias("near"))
    found = rows.select(*keep, F.explode(F.transform(first_of(F.col("_hits"), "match"), told)).alias("_h")).select(*keep, "_h.*").where(~has_any(F.col("match"), fixed.INVALID_CAPACITY))
    low, high, spelled = (F.get("groups", F.lit(i)) for i in range(3))
    near = F.col("near")
    # computed once each, as the filter below and is_energy read them, too
    found = generated(found, value=F.greatest(number(low), number(high)), unit=unit_of(spelled))
    found = found.select(
        *keep, "match", "value", "unit",
        (F.lit("high") if title else confidence(near)).alias("confidence"), F.replace(near, F.lit("\n"), F.lit(" ")).alias("context"),
        (F.col("priority").cast("long") * 1_000_000_000 + F.col("start")).alias("ordinal"),
    )
    return found.where("unit is not null and value is not null").withColumn("is_energy", F.col("unit").isin("MWh", "GWh", "kWh"))


def unit_rank(unit: Column) -> Column:
    return F.when(unit.startswith("GW"), 3).when(unit.startswith("MW"), 2).otherwise(1)


def primary(found: DataFrame, key: list[str], tie: list[str]) -> DataFrame:
    """Per key the match with the largest unit, then value, then the first."""
    order = Window.partitionBy(*key).orderBy(unit_rank(F.col("unit")).desc(), F.col("value").desc(), *tie)
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def project_capacity(projects: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Per project: power value and unit, energy value and unit, the first five matches of both, source, confidence, context.

    A title with a capacity decides alone; else main documents, else the others. Pages are read
    once; one shuffle by project settles which stage and which match counts.
    """
    titles = extract_capacity(projects, "project_title", ["project_id"], title=True)
    rest = documents.join(titles.select("project_id").distinct(), "project_id", "left_anti")
    stage = F.when(F.col("main_document").eqNullSafe("YES"), 1).otherwise(2).alias("stage")
    rows = pages.join(rest.select("project_id", "document_id", stage), "document_id")
    found = extract_capacity(rows, "page_text", ["project_id", "document_id", "page_number", "stage"])
    titles = titles.withColumns({"document_id": F.lit(""), "page_number": F.lit(0).cast("long"), "stage": F.lit(0)})
    every = titles.unionByName(found)
    one = Window.partitionBy("project_id")
    every = every.withColumn("_best", F.min("stage").over(one)).where("stage = _best")
    place = ["document_id", "page_number", "ordinal"]
    every = every.withColumn("_i", F.row_number().over(Window.partitionBy("project_id", "is_energy").orderBy(*place)))
    rank = F.struct((-unit_rank(F.col("unit"))).alias("r"), (-F.col("value")).alias("v"), *place, "value", "unit", "confidence", "context")

    def matches(kind) -> Column:
        first = F.collect_list(F.when(kind & (F.col("_i") <= 5), F.struct("_i", "match")))
        return F.transform(F.array_sort(first), lambda x: x["match"])

    power, energy = ~F.col("is_energy"), F.col("is_energy")
    best = every.groupBy("project_id").agg(
        F.min(F.when(power, rank)).alias("p"), F.min(F.when(energy, rank)).alias("e"), matches(power).alias("matches"), matches(energy).alias("energy_matches"), F.min("stage").alias("stage")
    )
    has = documents.select("project_id").distinct().withColumn("has_documents", F.lit(True))
    out = projects.select("project_id").join(best, "project_id", "left").join(has, "project_id", "left")
    source = F.when(F.col("stage") == 0, "title").when(F.col("stage").isNotNull(), "document").when(F.col("has_documents"), "none").otherwise("no_documents")
    empty = F.array().cast("array<string>")
    return out.select(
        "project_id", F.col("p.value").alias("value"), F.col("p.unit").alias("unit"), F.col("e.value").alias("energy_value"), F.col("e.unit").alias("energy_unit"),
        F.coalesce("matches", empty).alias("matches"), F.coalesce("energy_matches", empty).alias("energy_matches"), source.alias("source"),
        F.coalesce("p.confidence", "e.confidence", F.lit("low")).alias("confidence"), F.coalesce("p.context", "e.context").alias("context"),
    )


def sampled(projects: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` projects drawn by a hash of their ids and the seed: the same ones in each run, whatever the layout."""
    return projects.orderBy(F.xxhash64("project_id", F.lit(seed)), "project_id").limit(n)


def run_capacity(projects: DataFrame, documents: DataFrame, pages: DataFrame, clean_only: bool = True, sample: int | None = None, source: str | None = None) -> DataFrame:
    """Projects (of one source, clean ones, a seeded ``sample``) with their capacity columns (``project_gencap_...``)."""
    if clean_only:
        projects = projects.where("project_energy_type = 'Clean'")
    if source:
        projects = projects.where(F.col("dataset_source") == source.upper())
    if sample:
        projects = sampled(projects, sample)
    wanted = documents.join(projects.select("project_id").distinct(), "project_id", "left_semi")
    found = project_capacity(projects.select("project_id", "project_title"), wanted, pages)
    return projects.join(found.withColumnsRenamed({c: f"project_gencap_{c}" for c in found.columns if c != "project_id"}), "project_id", "left")


def capacity_bucket(mw: Column) -> Column:
    return F.when(mw < 10, "Small").when(mw < 100, "Medium").when(mw < 500, "Large").when(mw.isNotNull(), "Utility-scale")


def best_sentences(text: Column, terms: list[str] | None = None, top: int = 10, more: Column | None = None) -> Column:
    """array<struct<sentence,score,sentence_no>>: a number with a unit 5, else a term 1; project words 2; at least 3, best first.

    ``more`` has further terms of the row, as those of its project's type.
    """
    single = [t for t in (terms or fixed.CAPACITY_TERMS) if t.isalpha()]
    parts = F.transform(F.split(text, fixed.SENTENCE_SPLIT), lambda s, i: F.struct(strip(s).alias("sentence"), i.alias("no")))
    parts = F.filter(parts, lambda x: F.length(x["sentence"]).between(20, 600))

    def scored(x: Column) -> Column:
        word = lambda ws: F.lower(x["sentence"]).rlike(r"\b(?:" + "|".join(ws) + r")\b(?<![0-9_])")
        base = F.when(x["sentence"].rlike(f"(?i){fixed.NUMBER_UNIT}"), 5).when(word(single), 1)
        if more is not None:
            words = F.regexp_extract_all(F.lower(x["sentence"]), F.lit(r"\b[a-z]+\b(?![0-9_])"), F.lit(0))
            some = F.exists(more, lambda m: F.contains(F.lower(x["sentence"]), m))  # cheaper than the words
            base = base.when(F.coalesce(some & F.arrays_overlap(words, more), F.lit(False)), 1)
        base = base.otherwise(0)
        score = F.when(base > 0, base + F.when(word(fixed.SENTENCE_WORDS), 2).otherwise(0)).otherwise(0)
        return F.struct((-score).alias("less"), x["no"].alias("no"), x["sentence"].alias("sentence"))

    best = F.slice(F.array_sort(F.filter(F.transform(parts, scored), lambda x: x["less"] < 0)), 1, top)
    out = F.transform(best, lambda x: F.struct(x["sentence"].alias("sentence"), (-x["less"]).cast("long").alias("score"), x["no"].alias("sentence_no")))
    return F.filter(out, lambda x: x["score"] >= 3)


def sentence_candidates(df: DataFrame, text: str, keep: list[str], terms: list[str] | None = None, top: int = 10) -> DataFrame:
    """The best sentences of each text, one row each."""
    rows = df.select(*keep, F.explode(best_sentences(F.col(text), terms, top)).alias("s"))
    return rows.select(*keep, "s.sentence", "s.score")


def page_budget(documents: DataFrame, pages: DataFrame, max_documents: int = 3, max_pages: int = 25, per_document: int = 50, enough: int = 15, per_page: int = 5) -> DataFrame:
    """Pages a model may read: project_id, document_id, page_number, page_rank, page_text, sentences.

    Documents come by type, main flag and whether they have more than 50 pages; the first pages of
    the first documents are read until ``enough`` candidate sentences were found. A column ``terms`` of
    the documents has the search terms of their project's type.
    """
    kinds = F.create_map(*[F.lit(x) for kv in fixed.TYPE_PRIORITY.items() for x in kv])
    rank = F.coalesce(kinds[F.coalesce("document_type", F.lit("none"))], F.lit(10))
    main = F.coalesce(F.create_map(*[F.lit(x) for kv in {"YES": 0, "NO": 1, "": 2}.items() for x in kv])[F.coalesce("main_document", F.lit("none"))], F.lit(3))
    large = F.when(F.col("total_pages").cast("string").try_cast("int") > 50, 0).otherwise(1)
    order = Window.partitionBy("project_id").orderBy(rank, main, large, "document_id")
    chosen = documents.withColumn("_d", F.row_number().over(order)).where(F.col("_d") <= max_documents)
    terms = F.col("terms") if "terms" in documents.columns else F.lit(None).cast("array<string>")
    rows = pages.join(chosen.select("project_id", "document_id", "_d", terms.alias("_terms")), "document_id")
    inside = Window.partitionBy("project_id", "_d").orderBy("page_number")
    rows = rows.withColumn("_p", F.row_number().over(inside)).where(F.col("_p") <= per_document)
    first = Window.partitionBy("project_id").orderBy("_d", "page_number")
    rows = rows.withColumn("page_rank", F.row_number().over(first)).where(F.col("page_rank") <= max_pages)
    rows = rows.withColumn("sentences", best_sentences(F.coalesce("page_text", F.lit("")), top=per_page, more=F.col("_terms")))
    before = F.coalesce(F.sum(F.size("sentences")).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).where(F.col("_before") < enough)
    return rows.select("project_id", "document_id", "page_number", F.col("page_rank").cast("long").alias("page_rank"), "page_text", "sentences")


def first_page_coverage(documents: DataFrame, pages: DataFrame, n: int = 20) -> DataFrame:
    """Per project whether the first ``n`` pages of its first main document have a sentence with a number and a power unit."""
    one = Window.partitionBy("project_id").orderBy("document_id")
    main = documents.where("main_document = 'YES'").withColumn("_d", F.row_number().over(one)).where("_d = 1")
    rows = pages.join(main.select("project_id", "document_id"), "document_id")
    rows = rows.withColumn("_p", F.row_number().over(Window.partitionBy("project_id").orderBy("page_number"))).where(F.col("_p") <= n)
    hit = F.count_if(F.size(F.filter(best_sentences(F.col("page_text")), lambda s: s["score"] >= 5)) > 0)
    return rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_pages"), (hit > 0).alias("has_capacity"))
