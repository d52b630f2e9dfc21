"""Queries over made cases: every customer gets one text of a list by its key, and the SQL names what each text must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places, tags
from ..operators import capacity, dates, replies, snippets
from .derived import Corpus

#: name -> (function of a Corpus, SQL)
CASES: dict[str, tuple[Callable[[Corpus], DataFrame], str]] = {}


def _rows(c: Corpus, texts: list) -> DataFrame:
    values = F.array(*[F.lit(t) for t in texts])
    # a few bytes of a customer become a long text: the file's own splits would be one task
    n = 4 * c.spark.sparkContext.defaultParallelism
    return c.table("customer").select("c_custkey").repartition(n, "c_custkey").select("c_custkey", F.get(values, (F.col("c_custkey") % len(texts)).cast("int")).alias("text"))


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def _sql(n: int, names: dict[str, str], want: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in want)
    columns = ", ".join(f"v.{c}::{t} AS {c}" for c, t in names.items())
    return f"SELECT c_custkey, {columns} FROM customer JOIN (VALUES {values}) v(i, {', '.join(names)}) ON c_custkey % {n} = v.i"


def case(texts: list, names: dict[str, str], want: dict[int, list[tuple]]):
    """Register a function of (c_custkey, text) rows; ``want`` lists the rows of each text's number."""

    def add(f):
        CASES[f.__name__] = (lambda c: f(_rows(c, texts)), _sql(len(texts), names, [(i, *row) for i, rows in want.items() for row in rows]))
        return f

    return add


def _day(c: str = "date") -> Column:
    return F.col(c).cast("string").alias("date")


@case(
    [
        "Work commenced on March 5, 2012 at the site.", "Form filed Feb. 9, 2015 by mail.", "NOI of 7 June 2018 for the line.", "Draft text of 10/11/2016 is attached.",
        "FEIS of 2017-04-02 is out.", "FONSI 12-30-2019 on file.", "Comment period ends 2020.03.04 at noon.", "Scoping ran in August 2021 there.",
        "Seen in Sept 2014 and nothing else.", "Read on 3/4/98 and 5/6/07 only.", "The Clean Water Act of 1972 and May 1, 2003 were named.", "Smith et al. wrote on June 3, 2010.",
        "signed May 1, 1989", "dated February 30, 2011.", "Start date 1/2/2001; approved 1/2/2001.", "Issued April 4, 2004 and 2004-04-04.", "see Jones. 2009. and July 9, 2009", "no day at all", None,
    ],
    {"date": "VARCHAR", "context": "VARCHAR"},
    {
        0: [("2012-03-05", "start")], 1: [("2015-02-09", "submission")], 2: [("2018-06-07", "notice"), ("2018-06-01", "notice")], 3: [("2016-10-11", "draft")], 4: [("2017-04-02", "final")],
        5: [("2019-12-30", "decision")], 6: [("2020-03-04", "comment")], 7: [("2021-08-01", "scoping")], 8: [("2014-09-01", "unknown")], 9: [("1998-03-04", "unknown"), ("2007-05-06", "unknown")],
        14: [("2001-01-02", "start")], 15: [("2004-04-04", "decision")],
    },
)
def t1_t6_all_patterns(rows):
    return dates.extract_dates(rows, "text", ["c_custkey"]).select("c_custkey", _day(), "context")


_LONG = "On 3/5/2019 the whole long tale about hills and rivers and meadows ran on for a while there."
_S1 = "Signed 1/1/2010 by the keeper of the house in the town near the river and the long hills."
_S2 = "Approved 1/1/2010 and 2/2/2012 by the keeper of another house in the town near the mountains there."


@case(
    [
        "signed on Jan. 15, 2024", "Date: 2024.01.15 approved", f"The form was received. {_LONG}", "See 77 FR 1234 signed 4/4/2014.", "Signed 1/1/2010 and 2/2/2011.", f"{_S1} {_S2}",
        "The sky on 5/5/2015 was blue.", f"Received 6/6/2016 here.\n{_LONG}", "Wild.  Approved\n5/5/2012 !!", None,
    ],
    {"date": "VARCHAR", "context": "VARCHAR", "position": "BIGINT"},
    {
        0: [("2024-01-15", "signed on Jan. 15, 2024", 10)], 1: [("2024-01-15", "Date: 2024. 01. 15 approved", 6)], 2: [("2019-03-05", f"The form was received. {_LONG}", 26)],
        4: [("2010-01-01", "Signed 1/1/2010 and 2/2/2011.", 7)], 5: [("2010-01-01", _S1, 7), ("2012-02-02", _S2, len(_S1) + 1 + 22)],
        7: [("2016-06-06", f"Received 6/6/2016 here. {_LONG}", 9)], 8: [("2012-05-05", "Wild. Approved 5/5/2012 !!", 16)],
    },
)
def t13_t16_sentences(rows):
    return dates.hybrid_candidates(rows, "text", ["c_custkey"]).select("c_custkey", _day(), "context", F.col("position").cast("long").alias("position"))


@case(
    ["2024-03-20", "3/20/2024", "3/20/24", "03-20-2024", "2024.03.20", "March 20, 2024", "2024-3-20", "2024-02-30", "1949-12-31", "12/31/71", "12/31/55", " 2024-03-20\n", "null", ""],
    {"date": "VARCHAR"},
    {i: [("2024-03-20",)] for i in (0, 1, 2, 3, 4, 11)} | {i: [(None,)] for i in (5, 6, 7, 8, 10, 12, 13)} | {9: [("1971-12-31",)]},
)
def t19_reply_dates(rows):
    return rows.select("c_custkey", dates.normalize_date(F.col("text")).cast("string").alias("date"))


@case(
    ["The 20 megawatt  thermal plant", "cost of a 30 MW per site", "between 5 to 10 kW", "former 1,200.5 GWh store", "no power here", "rated 4 kW; a similar 7 MWac unit", "99 apples", None],
    {"match": "VARCHAR", "value": "DOUBLE", "unit": "VARCHAR", "confidence": "VARCHAR"},
    {
        0: [("20 megawatt", 20.0, "MW", "high"), ("20 megawatt  thermal plant", 20.0, "MW", "high")], 1: [("30 MW", 30.0, "MW", "medium")], 2: [("5 to 10 kW", 10.0, "kW", "medium")],
        3: [("1,200.5 GW", 1200.5, "GW", "low")], 5: [("4 kW", 4.0, "kW", "medium"), ("7 MW", 7.0, "MW", "medium"), ("rated 4 kW", 4.0, "kW", "medium")],
    },
)
def n3_n5_n7_capacity_cases(rows):
    return capacity.extract_capacity(rows, "text", ["c_custkey"]).select("c_custkey", "match", "value", "unit", "confidence")


@case(
    ["Kern County, CA; Reno, NV OR CA border", "Elko,NV", "new york and West Virginia", "IN THE FIELD, OK)", "(Lat/Lon: 41.25, -101)", "Somewhere, ZZ", "", None],
    {"states": "VARCHAR", "counties": "VARCHAR", "needs": "BOOLEAN"},
    {
        0: [("California;Nevada", "Kern", False)], 1: [("Nevada", "", False)], 2: [("New York;Virginia;West Virginia", "", False)], 3: [("Oklahoma", "", False)], 4: [("", "", True)],
        5: [("", "", False)], 6: [("", "", False)], 7: [("", "", False)],
    },
)
def g3_g5_place_cases(rows):
    made = rows.select("c_custkey", *[c.alias(n) for n, c in places.location_columns(F.col("text")).items()])
    listed = lambda c: F.array_join(c, ";")
    return made.select("c_custkey", listed("project_state").alias("states"), listed("project_county").alias("counties"), F.coalesce("project_location_needs_geocoding", F.lit(False)).alias("needs"))


_D1 = '{"dates": [{"date": "2020-01-02", "type": "decision", "source": "p1", "confidence": "high"}, {"date": "2021.05.06", "type": "decision", "source": "p2"}, {"date": "someday", "type": "decision"}]}'
_D2 = '{"dates": [{"date": "3/4/2019", "type": "specialist_review"}, {"date": "2018-01-01", "type": "specialist_review"}, {"date": "1960-01-01", "type": "historical"}, {"date": "2030-01-01", "type": "expiration"}]}'
_D3 = '{"dates": [{"date": "2017-07-07", "type": "application"}]}'


@case(
    [f"Sure: {_D1} as asked.", _D2, f"{_D3} trailing", "no object", '{"dates": [}', '{"other": 1}', "", None],
    {"n": "BIGINT", "decision": "VARCHAR", "sure": "VARCHAR", "reviews": "BIGINT", "first_review": "VARCHAR", "application": "VARCHAR", "inferred": "VARCHAR", "n_old": "BIGINT", "ends": "VARCHAR", "error": "VARCHAR"},
    {
        0: [(2, "2021-05-06", "medium", 0, None, None, None, 0, None, None)], 1: [(4, None, None, 2, "2018-01-01", None, "2018-01-01", 1, "2030-01-01", None)],
        2: [(1, None, None, 0, None, "2017-07-07", "2017-07-07", 0, None, None)], 3: [(0, None, None, 0, None, None, None, 0, None, "no_json_found")],
        4: [(0, None, None, 0, None, None, None, 0, None, "json_decode_error")], 5: [(0, None, None, 0, None, None, None, 0, None, None)],
        6: [(0, None, None, 0, None, None, None, 0, None, "empty_response")], 7: [(0, None, None, 0, None, None, None, 0, None, "empty_response")],
    },
)
def x16_reply_summary(rows):
    return replies.parse_dates(rows, "text").select(
        "c_custkey", F.col("n_dates_found").alias("n"), F.col("decision_date").alias("decision"), F.col("decision_confidence").alias("sure"), F.col("n_specialist_reviews").alias("reviews"),
        F.col("earliest_review_date").alias("first_review"), F.col("application_date").alias("application"), F.col("inferred_application_date").alias("inferred"),
        F.col("n_historical_dates").alias("n_old"), F.col("expiration_date").alias("ends"), F.col("parse_error").alias("error"),
    )


@case(
    ['{"classifications": [{"date": "2020-02-02", "type": "decision", "reason": "signed"}, {"date": "2019-01-01", "type": "initiation"}]}', '{"classifications": []} ok', "none", '{"classifications": [x]}'],
    {"n": "BIGINT", "decision": "VARCHAR", "application": "VARCHAR", "n_low": "BIGINT", "error": "VARCHAR"},
    {0: [(3, "2020-02-02", "2019-01-01", 1, None)], 1: [(2, None, None, 2, None)], 2: [(2, None, None, 0, "no_json_found")], 3: [(2, None, None, 0, "json_decode_error")]},
)
def x15_classification(rows):
    asked = F.array(*[F.struct(F.to_date(F.lit(d)).alias("date"), F.lit(x).alias("context")) for d, x in (("2020-02-02", "signed"), ("2018-08-08", "seen"))])
    read = replies.parse_classification(rows.withColumn("asked", asked), "text", "asked")
    low = F.size(F.filter("dates", lambda d: d["confidence"] == "low")).cast("long")
    return read.select("c_custkey", F.col("n_dates_found").alias("n"), F.col("decision_date").alias("decision"), F.col("application_date").alias("application"), low.alias("n_low"), F.col("parse_error").alias("error"))


@case(
    ['So: {"capacity_value": 12.5, "capacity_unit": "MW", "confidence": "high", "source_quote": "q"}', '{"capacity_value": "50", "capacity_unit": "kW"}', "{not json}", "nothing", "", None, '{"capacity_value": null}'],
    {"capacity_value": "DOUBLE", "capacity_unit": "VARCHAR", "confidence": "VARCHAR", "source_quote": "VARCHAR", "parse_error": "BOOLEAN"},
    {0: [(12.5, "MW", "high", "q", False)], 1: [(50.0, "kW", "low", None, False)], 6: [(None, None, "low", None, False)]} | {i: [(None, None, "low", None, True)] for i in (2, 3, 4, 5)},
)
def x17_reply_capacity(rows):
    return rows.select("c_custkey", replies.parse_capacity(F.col("text")).alias("r")).select("c_custkey", "r.*")


@case([_D1, _D2, "none"], {"type": "VARCHAR", "n": "BIGINT"}, {0: [("decision", 2)], 1: [("specialist_review", 2), ("historical", 1), ("expiration", 1)]})
def x19_counts_by_type(rows):
    return replies.counts_by_type(replies.parse_dates(rows, "text"), "c_custkey", "dates")


@case([_D1, _D2, "none"], {"n": "BIGINT"}, {0: [(2,)]})
def x19_several_decisions(rows):
    return replies.several(replies.parse_dates(rows, "text"), "c_custkey", "dates")


@case(["a {b} c {d} e", "x {y", "", None], {"body": "VARCHAR"}, {0: [("{b} c {d}",)], 1: [(None,)], 2: [(None,)], 3: [(None,)]})
def x20_outer_json(rows):
    return rows.select("c_custkey", replies.outer_json(F.col("text")).alias("body"))


@case(
    ["Gas Pipeline", "Pipeline; Wind, Onshore", "PIPELINE and nuclear", "Solar", "", None],
    {"no_power": "BOOLEAN", "n_terms": "BIGINT", "has_turbine": "BOOLEAN", "has_steam": "BOOLEAN"},
    {0: [(True, 27, False, False)], 1: [(False, 30, True, False)], 2: [(False, 32, False, False)], 3: [(False, 33, False, False)], 4: [(False, 27, False, False)], 5: [(False, 27, False, False)]},
)
def c18_c19_type_terms(rows):
    terms = tags.capacity_terms(F.coalesce("text", F.lit("")))
    has = lambda t: F.array_contains(terms, t)
    return rows.select("c_custkey", tags.non_power(F.col("text")).alias("no_power"), F.size(terms).cast("long").alias("n_terms"), has("turbine").alias("has_turbine"), has("steam").alias("has_steam"))


@case(
    ['["a", "b|c"]', "plain", "x|y", "", None, '["only"]', "[broken"],
    {"first": "VARCHAR", "label": "VARCHAR", "parts": "BIGINT"},
    {0: [("a", "a - b|c", 3)], 1: [("plain", "plain", 1)], 2: [("x|y", "x|y", 2)], 3: [("", "", 0)], 4: [(None, "", 0)], 5: [("only", "only", 1)], 6: [("[broken", "[broken", 1)]},
)
def a27_e1_e4_list_texts(rows):
    parts = F.coalesce(F.size(tags.split_tags(F.col("text"))), F.lit(0)).cast("long")
    return rows.select("c_custkey", tags.first_value(F.col("text")).alias("first"), tags.tag_label(F.col("text"), " - ").alias("label"), parts.alias("parts"))


_TEXT = "x" * 300 + " Date Signed 1 " + "y" * 100 + " Easement " + "z" * 900 + " APD " + "w" * 300


@case(
    [_TEXT, "nothing here", "Right-of-Way and Right-of-Way", None],
    {"category": "VARCHAR", "matches": "VARCHAR"},
    {0: [("date_labels", "Date Signed"), ("project_types", "Easement;APD")], 2: [("project_types", "Right-of-Way;Right-of-Way")]},
)
def x7_keyword_matches(rows):
    found = snippets.keyword_matches(rows, "text", ["c_custkey"])
    return found.select("c_custkey", "category", F.array_join("matches", ";").alias("matches"))


@case(
    [_TEXT, "nothing here", "  \t padded License Amendment \n", ""],
    {"start": "BIGINT", "snippet": "VARCHAR", "categories": "VARCHAR"},
    {
        0: [(51, _TEXT[51:674].strip(), "date_labels,project_types"), (1076, _TEXT[1076:1579].strip(), "project_types")],
        2: [(0, "padded License Amendment", "project_types")],
    },
)
def x3_snippet_cases(rows):
    s = snippets.snippets(rows, "text", ["c_custkey"])
    return s.select("c_custkey", F.col("start").cast("long").alias("start"), "snippet", F.array_join("categories", ",").alias("categories"))


@case(
    [_TEXT, "nothing here", "q" * 9000 + " Easement", ""],
    {"n_snippets": "BIGINT", "n_chars": "BIGINT", "head": "VARCHAR"},
    {0: [(2, 623 + 9 + 503, _TEXT[51:61])], 1: [(0, 12, "nothing he")], 2: [(1, 258, "q" * 10)], 3: [(0, 0, "")]},
)
def x5_reduced_cases(rows):
    made = snippets.reduce_texts(rows, "text", ["c_custkey"])
    return made.select("c_custkey", "n_snippets", F.length("processed").cast("long").alias("n_chars"), F.substring("processed", 1, 10).alias("head"))
