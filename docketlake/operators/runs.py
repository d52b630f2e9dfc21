"""End-to-end runs over the tables of a corpus: timelines, maintained date candidates, model timelines and capacities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.tags import capacity_terms, non_power, words
from ..sources import staging
from .asking import Asking, ask_model
from .capacity import page_budget, sampled
from .dates import extract_dates, merge_dates, paged_candidates, priority_documents, timelines
from .replies import parse_capacity, parse_classification, parse_dates
from .snippets import capacity_prompt, date_prompt, document_prompt, reduce_texts


@dataclass(frozen=True)
class Options:
    """Which projects and documents a run reads. The sample is drawn by a hash of the ids and the seed."""

    sample: int | None = None
    seed: int = 42
    clean_only: bool = False
    ce_only: bool = False
    decision_docs_only: bool = True
    main_docs_only: bool = False

    def projects(self, projects: DataFrame) -> DataFrame:
        if self.ce_only:
            projects = projects.where("dataset_source = 'CE'")
        if self.clean_only:
            projects = projects.where("project_energy_type = 'Clean'")
        return sampled(projects, self.sample, self.seed) if self.sample else projects

    def documents(self, documents: DataFrame, projects: DataFrame) -> DataFrame:
        """The documents of the projects, before any is left out."""
        return documents.join(projects.select("project_id").distinct(), "project_id", "left_semi")

    def readable(self, documents: DataFrame) -> DataFrame:
        """The documents whose pages are read."""
        if self.decision_docs_only:
            documents = priority_documents(documents)
        return documents.where("main_document = 'YES'") if self.main_docs_only else documents


def run_timelines(projects: DataFrame, documents: DataFrame, pages: DataFrame, options: Options = Options()) -> DataFrame:
    """Projects with their timeline columns (``project_timeline_...``) from dates found by patterns."""
    projects = options.projects(projects)
    documents = options.documents(documents, projects)
    chosen = options.readable(documents).select("project_id", "document_id")
    rows = pages.join(chosen, "document_id")
    found = extract_dates(rows, "page_text", ["project_id", "document_id", "page_number"])
    made = timelines(projects, documents, merge_dates(found))
    return projects.join(made.withColumnsRenamed({c: f"project_timeline_{c}" for c in made.columns if c != "project_id"}), "project_id", "left")


def project_texts(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(project_id, text, n_chars): all pages of a project in order, with a blank line between; blank ones left out."""
    rows = pages.where("page_text is not null").join(documents.select("project_id", "document_id"), "document_id")
    listed = F.array_sort(F.collect_list(F.struct("document_id", "page_number", "page_text")))
    texts = rows.groupBy("project_id").agg(F.array_join(F.transform(listed, lambda x: x["page_text"]), "\n\n").alias("text"))
    return texts.withColumn("n_chars", F.length("text")).where(F.col("text").rlike(r"\S"))


CANDIDATES = Options(clean_only=True, ce_only=True, decision_docs_only=False, main_docs_only=True)


def _paged(documents: DataFrame, pages: DataFrame) -> DataFrame:
    rows = pages.join(documents.select("project_id", "document_id"), "document_id")
    return paged_candidates(rows, "page_text", ["project_id"], ["document_id", "page_number"])


def date_candidates(projects: DataFrame, documents: DataFrame, pages: DataFrame, options: Options = CANDIDATES) -> DataFrame:
    """(project_id, date, match, context, position, position_pct) of all projects chosen, to be written and used again."""
    return _paged(options.readable(options.documents(documents, options.projects(projects))), pages)


BUCKETS = 64


def maintained_candidates(projects: DataFrame, documents: DataFrame, pages: DataFrame, path: str, options: Options = CANDIDATES) -> DataFrame:
    """As ``date_candidates``, kept in a table at ``path`` that is brought up to date.

    ``documents`` has a ``content_digest`` of each document's pages (``ingest.documents`` makes one). A project
    whose readable documents and digests are those of the last run is not read again. The buckets of
    changed, new and dropped projects are replaced, each in one commit together with the state that it rests on; without any
    change no page is read and nothing is written.
    """
    spark = projects.sparkSession
    chosen = options.readable(options.documents(documents, options.projects(projects)))
    stamp = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "document_id", "content_digest"))), ","), 256)
    now = staging.staged(chosen.groupBy("project_id").agg(stamp.alias("stamp")), "stamps")
    kinds = "project_id string, stamp string, date date, match string, context string, position int, position_pct double, bucket int"
    old = spark.read.schema(kinds).parquet(path) if staging.exists(spark, path) else spark.createDataFrame([], kinds)
    before = old.select("project_id", F.col("stamp").alias("was")).distinct()
    both = now.join(before, "project_id", "full").where(~F.col("stamp").eqNullSafe(F.col("was")))
    bucket = F.pmod(F.xxhash64("project_id"), F.lit(BUCKETS)).cast("int")
    changed = staging.staged(both.select("project_id", "stamp", bucket.alias("bucket")), "changed")
    columns = ["project_id", "date", "match", "context", "position", "position_pct"]
    if not changed.isEmpty():
        fresh = changed.where("stamp is not null")
        found = _paged(chosen.join(fresh.select("project_id"), "project_id", "left_semi"), pages)
        rows = fresh.join(found, "project_id", "left").select("project_id", "stamp", *columns[1:], "bucket")
        kept = old.join(F.broadcast(changed.select("bucket").distinct()), "bucket", "left_semi").join(changed.select("project_id"), "project_id", "left_anti")  # at most BUCKETS rows
        whole = staging.staged(rows.unionByName(kept), "candidates")
        gone = changed.select("bucket").distinct().join(whole.select("bucket").distinct(), "bucket", "left_anti")
        # a bucket that is left without projects is replaced by a row without one
        empty = gone.select(*[F.lit(None).cast(t).alias(n) for n, t in whole.drop("bucket").dtypes], "bucket")
        out = whole.unionByName(empty).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "project_id")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path)
    return spark.read.schema(kinds).parquet(path).where("date is not null").select(*columns) if staging.exists(spark, path) else old.select(*columns)


def text_sizes(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(project_id, n_chars) of ``project_texts``, without making them."""
    rows = pages.where("page_text is not null").join(documents.select("project_id", "document_id"), "document_id")
    sizes = rows.groupBy("project_id").agg((F.sum(F.length("page_text").cast("long")) + 2 * (F.count(F.lit(1)) - 1)).alias("n_chars"), F.max(F.col("page_text").rlike(r"\S")).alias("some"))
    return sizes.where("some").drop("some")


def model_timelines(
    projects: DataFrame, documents: DataFrame, pages: DataFrame, how: Asking | Callable[[str], str], options: Options = CANDIDATES, candidates: DataFrame | None = None, hybrid: bool = False,
) -> DataFrame:
    """Projects with model timeline columns (``llm_...``).

    Full run: each project's text, cut down to its snippets, goes to the model, which lists dates.
    Hybrid: date candidates (those given, or found here page by page) are classified by it. A project without
    documents, pages or dates is not sent; ``llm_error`` tells why. Prompts and replies are tables before they are read, so
    that no action asks again.
    """
    projects = options.projects(projects)
    every = options.documents(documents, projects)
    counts = every.groupBy("project_id").agg(F.count(F.lit(1)).alias("document_count"), F.count_if(F.col("main_document") == "YES").alias("main_document_count"))
    readable = options.readable(every)
    if hybrid:
        found = candidates if candidates is not None else _paged(readable, pages)
        found = found.join(projects.select("project_id").distinct(), "project_id", "left_semi")
        listed = F.array_sort(F.collect_list(F.struct("date", "context")))
        asked = found.groupBy("project_id").agg(listed.alias("asked")).withColumn("prompt", date_prompt(F.col("asked")))
    else:
        cut = reduce_texts(project_texts(readable, pages), "text", ["project_id"])
        asked = cut.select("project_id", "reduction_pct", F.length("processed").alias("processed_chars"), document_prompt(F.col("processed")).alias("prompt"))
    asked = staging.staged(asked, "prompts")
    replies = ask_model(asked, "project_id", "prompt", how).withColumnRenamed("error", "failed").join(asked.withColumn("prompt_chars", F.length("prompt")).drop("prompt"), "project_id")
    read = parse_classification(replies, "reply", "asked").drop("asked") if hybrid else parse_dates(replies, "reply")
    read = read.withColumn("error", F.coalesce("failed", "parse_error")).drop("reply", "parse_error", "failed")
    read = read.withColumn("dates", F.to_json("dates")).withColumnsRenamed({c: f"llm_{c}" for c in read.columns if c != "project_id"})
    sizes = text_sizes(readable, pages).withColumnRenamed("n_chars", "total_chars")
    out = projects.join(counts, "project_id", "left").join(sizes, "project_id", "left").join(read, "project_id", "left")
    none = F.when(F.col("document_count").isNull(), "no_documents").when(F.col("total_chars").isNull(), "no_pages").when(F.col("llm_n_dates_found").isNull(), "no_dates")
    return out.withColumns({"llm_error": F.coalesce("llm_error", none), "document_count": F.coalesce("document_count", F.lit(0)), "main_document_count": F.coalesce("main_document_count", F.lit(0))})


def unsettled(projects: DataFrame) -> DataFrame:
    """Projects whose capacity by patterns (``project_gencap_...``, where there) is neither sure nor from the title."""
    names = set(projects.columns)
    if "project_gencap_confidence" in names:
        projects = projects.where(F.lower(F.coalesce("project_gencap_confidence", F.lit("low"))).isin("low", "medium"))
    if "project_gencap_source" in names:
        projects = projects.where(~F.coalesce("project_gencap_source", F.lit("")).isin("title", "skipped_transmission_only"))
    return projects


def model_capacities(
    projects: DataFrame, documents: DataFrame, pages: DataFrame, how: Asking | Callable[[str], str], max_pages: int = 25, top: int = 5, only_unsettled: bool = True, options: Options = Options(),
) -> DataFrame:
    """(project_id, capacity_value, capacity_unit, confidence, source_quote, extraction_method, n_candidates, pages_scanned).

    Projects that patterns have settled are left out unless told otherwise. Those whose type has other measures than power are
    skipped; without documents or candidate sentences nothing is asked. Sentences are searched for the terms of the project's type too.
    """
    projects = options.projects(unsettled(projects) if only_unsettled else projects)
    kind = F.array_join("project_type", " ")
    skip = F.coalesce(non_power(kind), F.lit(False))
    # the terms of all types are searched anyway; only the others travel with the pages
    terms = F.array_except(capacity_terms(F.coalesce(kind, F.lit(""))), words(fixed.CAPACITY_TERMS))
    wanted = projects.where(~skip).select("project_id", terms.alias("terms"))
    budget = page_budget(documents.join(wanted, "project_id"), pages, max_pages=max_pages)
    # best sentences of all pages read, ties by place
    place = lambda s: F.struct((-s["score"]).alias("less"), F.col("page_rank").alias("page"), s["sentence_no"].alias("no"), s["sentence"].alias("sentence"))
    per = budget.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("pages_scanned"), F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("sentences", place)))), 1, top).alias("best"), F.sum(F.size("sentences")).alias("n_candidates"),
    )
    per = staging.staged(per, "sentences")
    title = projects.select("project_id", "project_title", kind.alias("kind")) if "project_title" in projects.columns else projects.select("project_id", F.lit(None).cast("string").alias("project_title"), kind.alias("kind"))
    asked = per.where("n_candidates > 0").join(title, "project_id").withColumn("prompt", capacity_prompt(F.transform("best", lambda x: x["sentence"]), F.col("project_title"), F.col("kind")))
    replies = ask_model(asked, "project_id", "prompt", how).select("project_id", parse_capacity(F.col("reply")).alias("r"), F.col("error").alias("failed"))
    has = documents.select("project_id").distinct().withColumn("has_documents", F.lit(True))
    rows = projects.select("project_id", skip.alias("skip")).join(has, "project_id", "left").join(per, "project_id", "left").join(replies, "project_id", "left")
    method: Column = F.when(F.col("skip"), "skipped_non_power").when(F.col("has_documents").isNull(), "no_documents").when(F.coalesce("n_candidates", F.lit(0)) == 0, "no_candidates")
    method = method.when(F.col("failed").isNotNull(), "call_error").when(F.col("r.parse_error"), "parse_error").otherwise("llm")
    return rows.select(
        "project_id", F.col("r.capacity_value").alias("capacity_value"), F.col("r.capacity_unit").alias("capacity_unit"), F.coalesce("r.confidence", F.lit("low")).alias("confidence"),
        F.col("r.source_quote").alias("source_quote"), method.alias("extraction_method"), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"), F.coalesce("pages_scanned", F.lit(0)).alias("pages_scanned"),
    )
