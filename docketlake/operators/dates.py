"""Date extraction and project timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.matches import Pattern, alternation, around, first_of, generated, has_any, holds_any, let, match_offsets, pieces, running, strip, zoned_hits
from ..sources import staging

_SIGNS = {"numeric_slash": "/", "numeric_slash_2y": "/", "ISO": "-", "numeric_dash": "-", "digital_sig": "."}
PATTERNS = [Pattern(name, f"(?i){p}", groups, _SIGNS.get(name, "[a-zA-Z]{3}")) for name, p, groups in fixed.DATE_PATTERNS]
# stretches of digits, months and what can stand between them, with one letter that may follow; two names share a letter in "janov..."
_MONTH = "(?:j[au]nov(?:ember)?|" + alternation(sorted(fixed.MONTH_NUMBERS, key=len, reverse=True)) + ")"
ZONE = rf"(?i)(?=[\djfmasond])(?:{_MONTH}|\d)(?:[\d\s,./-]++(?:{_MONTH})?+|{_MONTH}){{0,200}}+[\d\s,./-]*+(?:(?!{_MONTH})\w)?"
ZONE_NEEDS = r"\d\d"
SENTENCE = r"[^.!?\n]*(?:[.!?]+|\n+)|[^.!?\n]+"
REACH = 40  # sentences on either side that can be needed to fill a context of 80 characters


def parsed_date(name: Column, groups: Column) -> Column:
    """The date of a match of the named pattern by its groups (year, month, day); null if the calendar has no such day."""
    months = F.create_map(*[F.lit(x) for kv in fixed.MONTH_NUMBERS.items() for x in kv])
    year, month, day = (F.get(groups, F.lit(i)) for i in range(3))
    short = F.when(year.cast("int") <= 30, 2000).otherwise(1900)
    year = year.cast("int") + F.when(name == "numeric_slash_2y", short).otherwise(0)
    number = F.when(name.rlike("^[DM]"), months[F.lower(month)]).otherwise(month.try_cast("int"))
    zero = F.lit(0)
    return F.try_make_timestamp(year, number, day.cast("int"), zero, zero, zero).cast("date")


def statute_like(near: Column) -> Column:
    citation = "|".join(f"(?:{p})" for p in fixed.CITATIONS)
    return has_any(near, fixed.DATE_EXCLUSIONS) | near.rlike(citation)


def context_type(near: Column) -> Column:
    def first(low: Column) -> Column:
        out = F.lit("unknown")
        for kind in reversed(list(fixed.DATE_CONTEXTS)):
            out = F.when(holds_any(low, fixed.DATE_CONTEXTS[kind]), kind).otherwise(out)
        return out

    return let(F.lower(near), first)


def dated_hits(text: Column, parts: Column, years: tuple[int, int], window: int) -> Column:
    """Matches of all date patterns with their ``date``, without impossible days, other years, statutes and citations.

    ``parts`` is the text in ``pieces``.
    """

    def dated(h: Column) -> Column:
        fields = [h[f].alias(f) for f in ("priority", "name", "start", "end", "match")]
        return F.struct(*fields, parsed_date(h["name"], h["groups"]).alias("date"))

    good = lambda h: F.year(h["date"]).between(*years) & let(around(parts, h["start"], h["end"], window), lambda near: ~statute_like(near))
    return F.filter(F.transform(zoned_hits(text, ZONE, ZONE_NEEDS, PATTERNS), dated), good)


def extract_dates(pages: DataFrame, text: str, keep: list[str], years: tuple[int, int] = (1990, 2030)) -> DataFrame:
    """One row per page and date: keep..., date, match, start, context. The first match by pattern, then place, wins.

    All of it happens inside a page's row; nothing is shuffled, and no row holds the text beside a match. Rows
    are told apart by place, not by ``keep``.
    """

    body, parts = F.col("_text"), F.col("_parts")
    rows = pages.select(*keep, F.col(text).alias("_text")).where(body.rlike(r"\d\d"))
    rows = generated(generated(rows, _parts=pieces(body)), _hits=dated_hits(body, parts, years, 50)).where(F.size("_hits") > 0)
    hit = lambda h: F.struct(h["date"].alias("date"), h["match"].alias("match"), h["start"].alias("start"), around(parts, h["start"], h["end"], 100).alias("near"))
    rows = rows.select(*keep, F.explode(F.transform(first_of(F.col("_hits"), "date"), hit)).alias("_hit"))
    return rows.select(*keep, "_hit.date", "_hit.match", "_hit.start", context_type(F.col("_hit.near")).alias("context"))


def priority_documents(documents: DataFrame, category: str = "category") -> DataFrame:
    """Per project the documents of its first non-empty category: decision, final, draft, other; else all."""
    ranks = {"decision": 1, "final": 2, "draft": 3, "other": 4}
    rank = F.lit(5)
    for name, r in ranks.items():
        rank = F.when(F.col(category) == name, r).otherwise(rank)
    best = F.min("_rank").over(Window.partitionBy("project_id"))
    return documents.withColumn("_rank", rank).withColumn("_best", best).where("_rank = _best").drop("_rank", "_best")


def first_pages(documents: DataFrame, pages: DataFrame, n: int, main: bool = True) -> DataFrame:
    """Per project the first ``n`` pages, of its main documents where it has any (``main``)."""
    if main:
        has = F.max(F.col("main_document").eqNullSafe("YES")).over(Window.partitionBy("project_id"))
        documents = documents.withColumn("_has", has).where(~F.col("_has") | F.col("main_document").eqNullSafe("YES")).drop("_has")
    rows = pages.join(documents.select("project_id", "document_id"), "document_id")
    order = Window.partitionBy("project_id").orderBy("document_id", "page_number")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def merge_dates(dates: DataFrame) -> DataFrame:
    """One row per project and date: the first known context by document and page, else the first."""
    order = Window.partitionBy("project_id", "date").orderBy(F.col("context") == "unknown", "document_id", "page_number", "start")
    return dates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def timelines(projects: DataFrame, documents: DataFrame, merged: DataFrame) -> DataFrame:
    """Per project: span, decision date, year, counts, review flags and the earliest 20 dates."""
    summary = merged.groupBy("project_id").agg(
        F.min("date").alias("earliest"),
        F.max("date").alias("latest"),
        F.max(F.when(F.col("context") == "decision", F.col("date"))).alias("decision"),
        F.count(F.lit(1)).alias("n_dates"),
        F.count_if(F.col("context") == "unknown").alias("n_unknown"),
        F.slice(F.sort_array(F.collect_list(F.struct("date", "context"))), 1, 20).alias("first"),
    )
    docs = documents.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("main_document") == "YES").alias("n_main"))
    days = F.datediff("latest", "earliest")
    reasons = F.array_compact(
        F.array(
            F.when(days > 3650, "long_duration"),
            F.when(F.col("decision").isNull(), "no_decision_date"),
            F.when(F.col("n_unknown") / F.col("n_dates") > 0.7, "mostly_unknown_context"),
        )
    )
    reasons = F.when(F.col("n_dates").isNotNull(), reasons)
    return (
        projects.select("project_id").join(docs, "project_id", "left").join(summary, "project_id", "left")
        .select(
            "project_id", "earliest", "latest", "decision", days.alias("duration_days"), F.year(F.coalesce("decision", "latest")).alias("year"),
            F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_main", F.lit(0)).alias("n_main"),
            F.transform("first", lambda x: x["date"]).alias("dates"), F.transform("first", lambda x: x["context"]).alias("contexts"),
            reasons.alias("review_reasons"), (F.size(reasons) > 0).alias("needs_review"),
        )
    )


def normalize_date(value: Column, years: tuple[int, int] = (1950, 2030)) -> Column:
    """Numeric date text of a model's answer as a date; null where no form fits. Two-digit years from 69 are of 19xx."""
    value = strip(value)
    out = F.lit(None).cast("date")
    for pattern, form in fixed.REPLY_DATES:
        read = F.to_date(F.try_to_timestamp(value, F.lit(form)))
        if form.endswith("/yy"):
            read = F.when(F.year(read) >= 2069, F.add_months(read, -1200)).otherwise(read)
        out = F.coalesce(out, F.when(value.rlike(pattern), read))
    return F.when(F.year(out).between(*years), out)


def spans(text: Column) -> Column:
    """array<struct<start,end,sentence>>: stretches up to a full stop or line break; blank ones dropped."""
    parts = F.transform(match_offsets(text, SENTENCE), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), strip(h["match"]).alias("sentence")))
    return F.filter(parts, lambda s: s["sentence"] != "")


def expanded_context(parts: Column, at: Column, least: int = 80) -> Column:
    """Sentence ``at`` (0-based) of an array (a column or a lambda's variable), widened by the previous then the next sentence in turn until long enough."""

    def step(c: Column, i: Column) -> Column:
        short = c["size"] < least
        back, ahead = short & (i % 2 == 0) & (c["lo"] > 0), short & (i % 2 == 1) & (c["hi"] < F.size(parts) - 1)
        lo, hi = F.when(back, c["lo"] - 1).otherwise(c["lo"]), F.when(ahead, c["hi"] + 1).otherwise(c["hi"])
        more = F.when(back, F.length(F.get(parts, lo)) + 1).when(ahead, F.length(F.get(parts, hi)) + 1).otherwise(0)
        return F.struct(lo.alias("lo"), hi.alias("hi"), (c["size"] + more).alias("size"))

    begin = F.struct(at.cast("int").alias("lo"), at.cast("int").alias("hi"), F.length(F.get(parts, at)).alias("size"))
    turns = F.sequence(F.lit(0), F.least(F.lit(2 * REACH - 1), 2 * F.size(parts)))
    span = F.when(F.length(F.get(parts, at)) >= least, begin).otherwise(F.aggregate(turns, begin, step))
    wide = let(span, lambda s: F.array_join(F.slice(parts, s["lo"] + 1, s["hi"] - s["lo"] + 1), " "))
    return strip(F.regexp_replace(wide, r"\s+", " "))


def _excluded(context: Column) -> Column:
    return context.rlike("(?i)" + "|".join(f"(?:{p})" for p in fixed.CONTEXT_EXCLUSIONS))


def _found(rows: DataFrame, keep: list[str], years: tuple[int, int]) -> DataFrame:
    """Adds _hits: array<struct<priority,start,match,date,at,context,before,both>>, the dates with their sentence (``at`` counts from the row's first) as context.

    Rows have _text, what stands on either side of it (_left, _right: read for dates and what is near them, not for hits) and the sentences
    before and after (_pre, _post). Pages never share a sentence.
    """
    shift = F.length("_left")
    rows = generated(rows, _wide=F.concat("_left", "_text", "_right")).where(F.col("_wide").rlike(r"\d\d"))
    rows = generated(generated(rows, _parts=pieces(F.col("_wide"))), _dated=dated_hits(F.col("_wide"), F.col("_parts"), years, 30))
    inside = F.filter("_dated", lambda h: (h["start"] >= shift) & (h["start"] < shift + F.length("_text")))
    rows = generated(rows.drop("_wide", "_parts"), _own=inside).drop("_dated").where(F.size("_own") > 0)
    rows = generated(rows, _spans=spans(F.col("_text")))
    # sentences and dates in order of place; a date's sentence is the last one before it
    starts = F.transform("_spans", lambda s: F.struct(s["start"].alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("i")))
    places = F.transform("_own", lambda h, i: F.struct((h["start"] - shift).alias("at"), F.lit(1).alias("kind"), i.alias("i")))
    rows = generated(rows, _order=F.sort_array(F.concat(starts, places)))
    rows = generated(rows, _seen=running(F.transform("_order", lambda x: 1 - x["kind"])))
    of_hit = F.filter(F.transform("_order", lambda x, n: F.struct(x["kind"].alias("kind"), x["i"].alias("i"), (F.get("_seen", n) - 1).alias("at"))), lambda x: x["kind"] == 1)
    rows = generated(rows, _at=F.sort_array(F.transform(of_hit, lambda x: F.struct(x["i"].alias("i"), x["at"].alias("at")))), _all=F.concat("_pre", F.transform("_spans", lambda s: s["sentence"]), "_post"))

    def told(h: Column, i: Column) -> Column:
        at = F.get("_at", i)["at"]
        first = F.greatest(at + F.size("_pre") - REACH, F.lit(0))
        near = F.slice("_all", first + 1, F.lit(2 * REACH + 1))

        def made(b: Column) -> Column:
            before = F.when(b["at"] > 0, F.get(b["near"], b["at"] - 1))
            both = strip(F.regexp_replace(F.concat_ws(" ", before, F.get(b["near"], b["at"])), r"\s+", " "))
            own = [h["priority"].alias("priority"), (h["start"] - shift).alias("start"), h["match"].alias("match"), h["date"].alias("date"), at.alias("at")]
            return F.struct(*own, expanded_context(b["near"], b["at"]).alias("context"), before.alias("before"), both.alias("both"))

        return let(F.struct(near.alias("near"), (at + F.size("_pre") - first).alias("at")), made)

    return generated(rows, _hits=F.filter(F.transform("_own", told), lambda h: ~_excluded(h["context"]))).drop("_own", "_order", "_seen", "_at", "_all")


def _items(rows: DataFrame) -> Column:
    """array<struct<late,first,priority,start,date,match,context>> of the dates of _hits to be tried, in the order in which they are.

    First those whose context has a cue. Then a sentence with an initiation cue and no date (_prev_dated: whether the
    sentence before the row's first has one) lends its cue to the dates of the next sentence.
    """
    cues = fixed.DECISION_CUES + fixed.INITIATION_CUES
    hits, dated = F.col("_hits"), F.col("_sentences_with")
    item = lambda late, first, h, context: F.struct(late.alias("late"), first.alias("first"), h["priority"].alias("priority"), h["start"].alias("start"), h["date"].alias("date"), h["match"].alias("match"), context.alias("context"))
    own = F.transform(F.filter(hits, lambda h: has_any(h["context"], cues)), lambda h: item(F.lit(0), F.lit(0), h, h["context"]))
    known = lambda h: F.when(h["at"] == 0, F.col("_prev_dated")).otherwise(F.array_contains(dated, h["at"] - 1))
    lends = lambda h: h["before"].isNotNull() & has_any(h["before"], fixed.INITIATION_CUES) & ~known(h) & ~_excluded(h["both"])
    late = F.transform(F.filter(hits, lends), lambda h: item(F.lit(1), F.get("_spans", h["at"])["start"], h, h["both"]))
    return F.sort_array(F.concat(own, late))


def hybrid_candidates(texts: DataFrame, text: str, keep: list[str], years: tuple[int, int] = (1950, 2030)) -> DataFrame:
    """Dates with their sentences as context, kept only with a decision or initiation cue: keep..., date, match, context, position, position_pct.

    Dates are found in the whole text, then placed in a sentence. In the order of patterns and places
    a date is taken if neither it nor its context was taken before. Each row is a text of its own (see ``paged_candidates`` for texts of many pages).
    """
    none = F.array().cast("array<string>")
    rows = texts.select(*keep, F.col(text).alias("_text")).where(F.col("_text").rlike(r"\d\d"))
    rows = rows.withColumns({"_left": F.lit(""), "_right": F.lit(""), "_pre": none, "_post": none, "_prev_dated": F.lit(False)})
    rows = _found(rows, keep, years).where(F.size("_hits") > 0)
    rows = generated(rows, _sentences_with=F.transform("_hits", lambda h: h["at"]))
    rows = generated(rows, _tried=_items(rows))

    def take(kept: Column, h: Column) -> Column:
        known = F.exists(kept, lambda k: (k["date"] == h["date"]) | (F.lower(k["context"]) == F.lower(h["context"])))
        return F.when(known, kept).otherwise(F.concat(kept, F.array(h)))

    start = F.array().cast("array<struct<late:int,first:int,priority:int,start:int,date:date,match:string,context:string>>")
    taken = F.when(F.size("_tried") < 2, F.col("_tried")).otherwise(F.aggregate("_tried", start, take))
    rows = rows.select(*keep, F.length("_text").alias("_n"), F.explode(taken).alias("_c"))
    return rows.select(*keep, "_c.date", "_c.match", "_c.context", F.col("_c.start").alias("position"), (F.col("_c.start") / F.col("_n") * 100).alias("position_pct"))


SEPARATOR = "\n\n"  # between the pages of a project
NEAR = 60  # characters of the neighbouring page that are read at least
NEIGHBOURS = 3  # pages on either side that are read where they are that short
HEAD = rf"(?i)^(?:[\d\s,./-]++|{_MONTH}){{0,200}}+\w?"
TAIL = rf"(?i)(?=[\djfmasond])(?:{_MONTH}|\d)(?:[\d\s,./-]++(?:{_MONTH})?+|{_MONTH}){{0,200}}+$"


def _sides(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """For each page what the others lend it: _offset, _left, _right, _pre, _post. Only ends of pages are sorted by project, not pages."""
    body = F.col("_text")
    size = F.length(body)
    tail = F.greatest(F.length(F.regexp_extract(F.substring(body, -2000, 2000), TAIL, 0)), F.lit(NEAR))
    head = F.greatest(F.length(F.regexp_extract(F.substring(body, 1, 2000), HEAD, 0)), F.lit(NEAR))
    told = F.transform(spans(body), lambda s: s["sentence"])

    def few(sentences: Column) -> Column:
        """The first sentences, until they fill a context."""
        step = lambda s, x: F.when((s["n"] >= 80) | (F.size(s["out"]) >= REACH), s).otherwise(F.struct((s["n"] + F.length(x)).alias("n"), F.concat(s["out"], F.array(x)).alias("out")))
        return F.aggregate(F.slice(sentences, 1, REACH), F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")), step)["out"]

    edges = generated(rows.select(*key, *order, "_text"), _told=told)
    edges = edges.select(
        *key, *order, size.alias("n"), F.substring(body, -1 * F.least(tail, size), F.least(tail, size)).alias("tail"), (size <= tail).alias("all_tail"),
        F.substring(body, 1, head).alias("head"), (size <= head).alias("all_head"), few(F.col("_told")).alias("firsts"), F.reverse(few(F.reverse("_told"))).alias("lasts"),
    )
    w = Window.partitionBy(*key).orderBy(*order)
    left, right = F.lit(""), F.lit("")
    for i in range(NEIGHBOURS, 0, -1):
        back, ahead = lambda c, i=i: F.lag(c, i).over(w), lambda c, i=i: F.lead(c, i).over(w)
        left = F.when(back("tail").isNull(), "").otherwise(F.concat(F.when(back("all_tail"), left).otherwise(""), back("tail"), F.lit(SEPARATOR)))
        right = F.when(ahead("head").isNull(), "").otherwise(F.concat(F.lit(SEPARATOR), ahead("head"), F.when(ahead("all_head"), right).otherwise("")))
    pre = F.reverse(few(F.reverse(F.flatten(F.collect_list("lasts").over(w.rowsBetween(-REACH, -1))))))
    post = few(F.flatten(F.collect_list("firsts").over(w.rowsBetween(1, REACH))))
    before = F.coalesce(F.sum(F.col("n") + len(SEPARATOR)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return edges.select(
        *key, *order, before.alias("_offset"), left.alias("_left"), right.alias("_right"), pre.alias("_pre"), post.alias("_post"), F.size("firsts").alias("_told")
    )


def paged_candidates(pages: DataFrame, text: str, key: list[str], order: list[str], years: tuple[int, int] = (1950, 2030)) -> DataFrame:
    """As ``hybrid_candidates`` of the pages of each key, joined in order by blank lines; but no row is longer than a page and its neighbours' ends.

    Dates that run over a page's end, and sentences before and after, come from the neighbouring pages. ``order`` tells the pages of a
    key apart. What is near a date is read from NEIGHBOURS pages on either side at most. Dates are taken by ``first_taken``.
    """
    rows = pages.where(F.col(text).isNotNull()).select(*key, *order, F.col(text).alias("_text"))
    sides = staging.staged(_sides(rows, key, order), "pages")
    found = _found(rows.join(sides, [*key, *order]), [*key, *order], years)
    found = generated(found, _sentences_with=F.transform("_hits", lambda h: h["at"])).drop("_left", "_right", "_pre", "_post")
    found = staging.staged(found.where(F.size("_hits") > 0).drop("_text"), "dated")
    last = found.select(*key, *order, F.array_contains("_sentences_with", F.size("_spans") - 1).alias("_last"))
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    flags = sides.select(*key, *order, "_told").join(last, [*key, *order], "left")
    flags = flags.select(*key, *order, F.coalesce(F.last(F.when(F.col("_told") > 0, F.coalesce("_last", F.lit(False))), ignorenulls=True).over(w), F.lit(False)).alias("_prev_dated"))
    tried = found.join(flags, [*key, *order])
    tried = tried.select(*key, "_offset", F.explode(_items(tried)).alias("h"))
    place = F.struct("h.late", F.when(F.col("h.late") == 1, F.col("h.first") + F.col("_offset")).otherwise(0).alias("first"), "h.priority", (F.col("h.start") + F.col("_offset")).alias("position"))
    taken = first_taken(tried.select(*key, place.alias("place"), "h.date", "h.match", "h.context"), key)
    sizes = sides.join(rows.select(*key, *order, F.length("_text").alias("n")), [*key, *order]).groupBy(*key).agg(F.max(F.col("_offset") + F.col("n")).alias("_n"))
    return taken.join(sizes, key).select(*key, "date", "match", "context", F.col("place.position").cast("int").alias("position"), (F.col("place.position") / F.col("_n") * 100).alias("position_pct"))


def first_taken(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows (key..., place, date, match, context), in order of place, those whose date and context (in any case) no row taken before has.

    In each round the rows are taken that come first by both; rows that share a date or context with one of them are done with. Every round
    takes at least the first row of a key that has any left; mostly one or two are enough.
    """
    context = F.md5(F.lower("context").cast("binary"))
    first = rows.groupBy(*key, "date", context.alias("_c")).agg(F.min(F.struct("place", "match", "context")).alias("r"))
    left, taken = first.select(*key, "date", "_c", "r.*"), None
    while True:
        by_date, by_context = Window.partitionBy(*key, "date"), Window.partitionBy(*key, "_c")
        marked = left.withColumn("_d1", F.min("place").over(by_date)).withColumn("_c1", F.min("place").over(by_context))
        marked = marked.withColumn("_ok", (F.col("place") == F.col("_d1")) & (F.col("place") == F.col("_c1"))).drop("_d1", "_c1")
        marked = marked.withColumn("_by_context", F.max("_ok").over(by_context)).withColumn("_by_date", F.max("_ok").over(by_date))
        marked = staging.staged(marked, "taken")
        new = marked.where("_ok").select(*key, "place", "date", "match", "context")
        taken = new if taken is None else taken.unionByName(new)
        left = marked.where("not _ok and not _by_context and not _by_date").select(*left.columns)
        if left.isEmpty():
            return taken


def duration_bucket(days: Column) -> Column:
    years = days / 365
    return F.when(years <= 1, "<=1").when(years <= 2, "1-2").when(years <= 5, "2-5").when(years <= 10, "5-10").when(years > 10, ">10")

