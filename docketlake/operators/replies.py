"""Reading a language model's replies: dates, classifications, capacities, and the summaries made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import normalize_date

DATES = "array<struct<date:string,type:string,source:string,confidence:string>>"
STARTS = ["initiation", "application", "start"]


def outer_json(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def listed_json(text: Column, name: str) -> Column:
    """The innermost object with the list ``name``, else the text between the outer braces."""
    inner = F.regexp_extract(text, rf'(?s)\{{[^{{}}]*"{name}"\s*:\s*\[[^\]]*\][^{{}}]*\}}', 0)
    return F.coalesce(F.nullif(inner, F.lit("")), outer_json(text))


def _error(text: Column, body: Column) -> Column:
    # an object that is not JSON reads as null
    broken = F.try_parse_json(body).isNull()
    return F.when(text.isNull() | (text == ""), "empty_response").when(body.isNull(), "no_json_found").when(broken, "json_decode_error")


def _items(body: Column, name: str, fields: str) -> Column:
    """The list of objects ``name``; anything else reads as an empty one."""
    got = F.from_json(body, f"`{name}` array<struct<{fields}>>")[name]
    return F.filter(F.coalesce(got, F.array().cast(f"array<struct<{fields}>>")), lambda d: d.isNotNull())


def _dated(items: Column, source: str, sure: Column | str) -> Column:
    """Items with a readable date, as DATES."""

    def row(d: Column) -> Column:
        return F.struct(
            normalize_date(d["date"]).cast("string").alias("date"), F.coalesce(d["type"], F.lit("other")).alias("type"),
            F.substring(F.coalesce(d[source], F.lit("")), 1, 200).alias("source"), (F.coalesce(d[sure], F.lit("medium")) if isinstance(sure, str) else sure).alias("confidence"),
        )

    return F.filter(F.transform(items, row), lambda d: d["date"].isNotNull())


def read_dates(text: Column) -> tuple[Column, Column]:
    """(DATES, error) of a reply that lists dates. Without a readable object the list is empty."""
    body = listed_json(text, "dates")
    found = _dated(_items(body, "dates", "date:string,type:string,source:string,confidence:string"), "source", "confidence")
    return found, _error(text, body)


def read_classification(text: Column, asked: Column) -> tuple[Column, Column]:
    """(DATES, error) of a reply that classifies the dates of ``asked`` (array<struct<date,...>>).

    Dates without a class are added as other, low, unless the reply cannot be read.
    """
    body = listed_json(text, "classifications")
    found = _dated(_items(body, "classifications", "date:string,type:string,reason:string"), "reason", F.lit("high"))
    known = F.transform(found, lambda d: d["date"])
    left = F.filter(F.transform(asked, lambda a: a["date"].cast("string")), lambda d: ~F.array_contains(known, d))
    left = F.transform(left, lambda d: F.struct(d.alias("date"), F.lit("other").alias("type"), F.lit("not classified by LLM").alias("source"), F.lit("low").alias("confidence")))
    error = _error(text, body)
    return F.when(error.isNull(), F.concat(found, left)).otherwise(F.array().cast(DATES)), error


def date_summary(found: Column, starts: list[str]) -> dict[str, Column]:
    """Summary columns of DATES: latest decision, reviews, application, historical dates, expiration."""
    of = lambda *kinds: F.array_sort(F.transform(F.filter(found, lambda d: d["type"].isin(*kinds)), lambda d: d["date"]))
    decided = F.filter(found, lambda d: d["type"] == "decision")
    last = F.element_at(of("decision"), -1)
    decision = F.element_at(F.filter(decided, lambda d: d["date"] == F.array_max(of("decision"))), -1)
    pick = lambda a, first: F.when(F.size(a) > 0, F.array_min(a) if first else F.array_max(a))
    reviews, started, old, ends = of("specialist_review"), of(*starts), of("historical"), of("expiration")
    has = F.size(decided) > 0
    return {
        "n_dates_found": F.size(found).cast("long"), "decision_date": F.when(has, last), "decision_date_source": F.when(has, decision["source"]),
        "decision_confidence": F.when(has, decision["confidence"]), "earliest_review_date": pick(reviews, True), "latest_review_date": pick(reviews, False),
        "n_specialist_reviews": F.size(reviews).cast("long"), "application_date": pick(started, True), "inferred_application_date": F.coalesce(pick(started, True), pick(reviews, True)),
        "earliest_historical_date": pick(old, True), "n_historical_dates": F.size(old).cast("long"), "expiration_date": pick(ends, False),
    }


def parse_dates(df: DataFrame, reply: str) -> DataFrame:
    """The rows with ``dates`` (DATES), the summary columns, parse_error and the start of the reply."""
    found, error = read_dates(F.col(reply))
    rows = df.withColumns({"dates": found, "parse_error": error, "raw_response": F.substring(reply, 1, 500)})
    return rows.withColumns(date_summary(F.col("dates"), ["application"]))


def parse_classification(df: DataFrame, reply: str, asked: str) -> DataFrame:
    """As ``parse_dates``, for a reply that classifies the dates of the column ``asked``; an unread reply counts those as found."""
    found, error = read_classification(F.col(reply), F.col(asked))
    rows = df.withColumns({"dates": found, "parse_error": error, "raw_response": F.substring(reply, 1, 500)})
    rows = rows.withColumns(date_summary(F.col("dates"), STARTS))
    return rows.withColumn("n_dates_found", F.when(F.col("parse_error").isNotNull(), F.size(asked).cast("long")).otherwise(F.col("n_dates_found")))


def parse_capacity(text: Column) -> Column:
    """struct<capacity_value,capacity_unit,confidence,source_quote,parse_error> of a reply.

    The first object without inner braces counts; one that is no JSON is an error. Values may be
    numbers or quoted numbers.
    """
    flat = F.nullif(F.regexp_extract(text, r"\{[^{}]*\}", 0), F.lit(""))
    bad = F.try_parse_json(flat).isNull()
    got = F.from_json(flat, "capacity_value string, capacity_unit string, confidence string, source_quote string")
    none = F.lit(None)
    return F.struct(
        F.when(~bad, F.replace(got["capacity_value"], F.lit(","), F.lit("")).try_cast("double")).otherwise(none).alias("capacity_value"), F.when(~bad, got["capacity_unit"]).alias("capacity_unit"),
        F.coalesce(F.when(~bad, got["confidence"]), F.lit("low")).alias("confidence"), F.when(~bad, got["source_quote"]).alias("source_quote"), F.coalesce(bad, F.lit(True)).alias("parse_error"),
    )


def counts_by_type(df: DataFrame, key: str, found: str) -> DataFrame:
    """Per key how many dates of each type its DATES hold: the list is unnested, then counted."""
    rows = df.select(key, F.explode(found).alias("d")).select(key, "d.type")
    return rows.groupBy(key, "type").agg(F.count(F.lit(1)).alias("n"))


def several(df: DataFrame, key: str, found: str, kind: str = "decision", least: int = 2) -> DataFrame:
    """Keys with ``least`` dates of a kind or more."""
    return counts_by_type(df, key, found).where((F.col("type") == kind) & (F.col("n") >= least)).select(key, "n")
