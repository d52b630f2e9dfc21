"""Keyword windows, search in context, and the prompts for a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.matches import Pattern, all_hits, around, clean, generated, literals, pieces, strip

SEPARATOR = "\n\n[...]\n\n"


WINDOW = "struct<start:int,end:int,first:int,n:int>"


def keyword_bank() -> list[tuple[str, str]]:
    return [(c, f"(?i){p}") for c, ps in fixed.SNIPPET_PATTERNS.items() for p in ps]


def _hits(df: DataFrame, text: str, keep: list[str], bank: list[tuple[str, str]] | None) -> DataFrame:
    """keep..., _text, _hits: all matches of the bank inside each row.

    A pattern reads only texts that contain its longest literal stretch; where no pattern has one, a text is first read by all of them joined.
    """
    longest = lambda p: max(literals(p), key=len, default=None)
    patterns = [Pattern(n, p, literal=longest(p)) for n, p in bank or keyword_bank()]
    rows = df.select(*keep, F.col(text).alias("_text"))
    body = F.col("_text")
    hits = all_hits(clean(body), patterns)
    if all(p.literal is None for p in patterns):
        joined = "|".join(f"(?i:{p.regex[4:]})" if p.regex.startswith("(?i)") else f"(?:{p.regex})" for p in patterns)
        none = F.array().cast("array<struct<priority:int,name:string,start:int,end:int,match:string,groups:array<string>>>")
        hits = F.when(body.rlike(joined), hits).otherwise(none)
    return generated(rows, _hits=hits)


def windows(hits: Column, length: Column, window: int) -> Column:
    """Hits by place, each with ``low`` and ``high`` of its window."""
    sides = lambda h: (F.greatest(h["start"] - window, F.lit(0)).alias("low"), F.least(h["end"] + window, length).alias("high"))
    return F.array_sort(F.transform(hits, lambda h: F.struct(*sides(h), h["name"].alias("name"), h["match"].alias("match"))))


def swept(placed: Column) -> Column:
    """array<WINDOW>: overlapping or touching windows of hits in order of ``low`` become one, of ``n`` hits from the ``first``."""

    def step(s: Column, h: Column) -> Column:
        joins = (s["now"]["n"] > 0) & (h["low"] <= s["now"]["end"])
        one = lambda start, end, first, n: F.struct(start.alias("start"), end.alias("end"), first.alias("first"), n.alias("n"))
        grown = one(s["now"]["start"], F.greatest(s["now"]["end"], h["high"]), s["now"]["first"], s["now"]["n"] + 1)
        fresh = one(h["low"], h["high"], s["now"]["first"] + s["now"]["n"], F.lit(1))
        done = F.when(joins | (s["now"]["n"] == 0), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
        return F.struct(F.when(joins, grown).otherwise(fresh).alias("now"), done.alias("done"))

    zero = F.lit(0)
    none = F.struct(zero.alias("start"), zero.alias("end"), zero.alias("first"), zero.alias("n"))
    end = lambda s: F.when(s["now"]["n"] > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
    return F.aggregate(placed, F.struct(none.alias("now"), F.array().cast(f"array<{WINDOW}>").alias("done")), step, end)


def _snippets(df: DataFrame, text: str, keep: list[str], bank: list[tuple[str, str]] | None, window: int) -> DataFrame:
    """keep..., _text, _snippets: array<struct<start,end,snippet,categories,keywords>>. All inside the row; nothing is shuffled."""
    rows = _hits(df, text, keep, bank)
    rows = generated(rows, _placed=windows(F.col("_hits"), F.length("_text"), window), _parts=pieces(F.col("_text")))
    placed = F.col("_placed")

    def told(w: Column) -> Column:
        body = strip(around(F.col("_parts"), w["start"], w["end"], 0))
        body = F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), " {3,}", "  ")
        own = F.slice(placed, w["first"] + 1, w["n"])
        names, words = (F.array_sort(F.array_distinct(F.transform(own, of))) for of in (lambda h: h["name"], lambda h: h["match"]))
        return F.struct(w["start"].alias("start"), w["end"].alias("end"), body.alias("snippet"), names.alias("categories"), words.alias("keywords"))

    return generated(rows, _windows=swept(placed)).select(*keep, "_text", F.transform("_windows", told).alias("_snippets"))


def snippets(df: DataFrame, text: str, keep: list[str], bank: list[tuple[str, str]] | None = None, window: int = 250) -> DataFrame:
    """Merged keyword windows: keep..., start, end, snippet, categories (sorted), keywords (sorted). Rows are told apart by place, not by ``keep``."""
    return _snippets(df, text, keep, bank, window).select(*keep, F.inline("_snippets"))


def reduce_texts(df: DataFrame, text: str, keep: list[str], bank: list[tuple[str, str]] | None = None, window: int = 250, least: int = 200, most: int = 8000) -> DataFrame:
    """Each text cut down to its snippets: processed, n_snippets, reduction_pct. A null text is reduced to null."""
    rows = generated(_snippets(df, text, keep, bank, window), _joined=F.array_join(F.transform("_snippets", lambda x: x["snippet"]), SEPARATOR))
    joined = F.coalesce("_joined", F.lit(""))
    cap = lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n[...]"))).otherwise(c)
    rows = rows.withColumn("processed", F.when(F.length(joined) < least, cap(F.col("_text"))).otherwise(cap(joined)))
    pct = F.round((1 - F.length("processed") / F.greatest(F.length("_text"), F.lit(1))) * 100, 4)
    return rows.select(*keep, "processed", F.coalesce(F.size("_snippets"), F.lit(0)).cast("long").alias("n_snippets"), pct.alias("reduction_pct"))


def in_context(df: DataFrame, text: str, keep: list[str], term: str, window: int = 200) -> DataFrame:
    """Rows with the term (any case) and the text around its first place."""
    at = F.locate(term.lower(), F.lower(text))
    rows = df.withColumn("_at", at).where("_at > 0")
    lo = F.greatest(F.col("_at") - 1 - window, F.lit(0))
    hi = F.least(F.col("_at") - 1 + len(term) + window, F.length(text))
    body = F.concat(F.when(lo > 0, "...").otherwise(""), F.substring(F.col(text), lo + 1, hi - lo), F.when(hi < F.length(text), "...").otherwise(""))
    return rows.select(*keep, body.alias("context"))


def term_counts(df: DataFrame, text: str, category: str, least: int = 5) -> DataFrame:
    """Terms by category with their totals of ``least`` or more."""
    words = df.select(category, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0))).alias("term"))
    n = words.groupBy("term", category).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("term").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    return n.join(total, "term")


def keyword_table(spark: SparkSession) -> DataFrame:
    """The keyword bank: category, pattern, and the number of patterns of the category."""
    rows = [(c, p, len(ps)) for c, ps in fixed.SNIPPET_PATTERNS.items() for p in ps]
    return spark.createDataFrame(rows, "category string, pattern string, n_patterns int")


def keyword_matches(df: DataFrame, text: str, keep: list[str], bank: list[tuple[str, str]] | None = None) -> DataFrame:
    """All matches of a bank by category, in the order of its patterns, then places: keep..., category, matches. Nothing is shuffled."""
    rows = _hits(df, text, keep, bank)
    names = F.array_distinct(F.transform("_hits", lambda h: h["name"]))
    of = lambda n: F.struct(n.alias("category"), F.transform(F.filter("_hits", lambda h: h["name"] == n), lambda h: h["match"]).alias("matches"))
    return rows.select(*keep, F.inline(F.transform(names, of)))


def document_pages(documents: DataFrame, pages: DataFrame, document_id: str, first: int = 1, last: int | None = None) -> DataFrame:
    """The pages of one document in order, with its title and type; the filter reaches both scans."""
    own = pages.where(F.col("document_id") == document_id).where(F.col("page_number") >= first)
    if last is not None:
        own = own.where(F.col("page_number") <= last)
    about = documents.where(F.col("document_id") == document_id).select("document_id", "document_type", "file_name")
    return own.join(about, "document_id").select("document_id", "document_type", "file_name", "page_number", "page_text").orderBy("page_number")


def project_pages(documents: DataFrame, pages: DataFrame, project_id: str) -> DataFrame:
    """The pages of all documents of a project, main documents first."""
    own = documents.where(F.col("project_id") == project_id).select("project_id", "document_id", "main_document")
    rows = own.join(pages, "document_id").withColumn("is_main", F.col("main_document").eqNullSafe("YES"))
    return rows.select("project_id", "document_id", "is_main", "page_number", "page_text").orderBy(F.col("is_main").desc(), "document_id", "page_number")


DOCUMENT_SHAPE = '{"dates": [{"date": "2020-01-31", "type": "decision", "source": "words beside the date", "confidence": "high"}]}'
CLASSES_SHAPE = '{"classifications": [{"date": "2020-01-31", "type": "decision", "reason": "why"}]}'
CAPACITY_SHAPE = '{"capacity_value": 50, "capacity_unit": "MW", "confidence": "high", "source_quote": "words of the excerpt"}'
DOCUMENT_HEAD = (
    "The text below is from the review file of one project. List each date in it with its role:\n"
    "decision (an official signs or approves), application (a request comes in or the review begins), specialist_review (an expert reviews or is consulted), "
    "historical (something before this review), expiration (a permit or a term ends), other.\n"
    f"Write dates as YYYY-MM-DD and confidence as high, medium or low. Answer with JSON of this shape and nothing else:\n{DOCUMENT_SHAPE}\n\n"
)
CLASSES_HEAD = (
    "Each numbered line is a date from the review file of one project, with the words around it. Give each date one type: decision (the final signature or approval), "
    "initiation (the review, a consultation or a request begins), other.\n"
    f"Repeat the date as YYYY-MM-DD. Answer with JSON of this shape and nothing else:\n{CLASSES_SHAPE}\n"
)
CAPACITY_HEAD = (
    "What can the proposed project generate? Use the numbered excerpts only. Leave out alternatives, neighbouring plants and comparisons; of several values take "
    "the nameplate or rated one, of a range its upper end.\n"
    "capacity_unit is MW, GW, kW, MWh, GWh or kWh; confidence is high, medium or low; capacity_value, capacity_unit and source_quote are null, and confidence is low, if no excerpt tells.\n"
    f"Answer with JSON of this shape and nothing else:\n{CAPACITY_SHAPE}\n"
)


def document_prompt(text: Column) -> Column:
    """Prompt over a whole (reduced) document for all of its dates."""
    return F.concat(F.lit(DOCUMENT_HEAD), text)


def numbered(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")


def capacity_prompt(sentences: Column, title: Column | None = None, kind: Column | None = None) -> Column:
    """Prompt over the first five candidate sentences of a project."""
    about = [F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("unknown")), F.lit("\n")) for name, value in (("Project", title), ("Type", kind)) if value is not None]
    return F.concat(F.lit(CAPACITY_HEAD), *about, numbered(F.slice(sentences, 1, 5)))


def date_prompt(candidates: Column) -> Column:
    """Prompt over array<struct<date,context>>."""
    return F.concat(F.lit(CLASSES_HEAD), numbered(F.transform(candidates, lambda c: F.concat(c["date"].cast("string"), F.lit(": "), c["context"]))))
