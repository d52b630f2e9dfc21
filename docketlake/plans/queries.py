"""Queries of the core library over the derived corpus, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, places, tags
from ..functions.matches import match_offsets, merge_windows
from ..operators import capacity, dates, geo, reports, runs, search, snippets
from ..operators.asking import ask_model
from ..sources import ingest, staging
from .cases import CASES
from .derived import SQL_BASE, STATE_NAMES, TYPE_TAGS, Corpus, _sql_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name, (_made, _text) in CASES.items():
    QUERIES[_name] = lambda spark, sf_dir, made=_made: made(Corpus(spark, sf_dir))
    ORACLES[_name] = _text


def query(sql: str | None, base: bool = True):
    """Register a function of a Corpus under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (SQL_BASE if base else "") + sql
        return f

    return add


joined = lambda c: F.array_join(c, ";")
TAGS = list(TYPE_TAGS.values())
_FLAGS = ["project_energy_type_questions", "project_is_utilities_broadband_only", "project_is_nuclear_tech_only", "project_utilities_to_exclude"]


# scans, projections, filters


@query("SELECT project_id, project_title, array_to_string(project_type, ';') AS project_type, project_sponsor, project_location, '' AS project_description FROM projects")
def s1_p1_projects(c):
    p = ingest.projects(c.records)
    return p.select("project_id", "project_title", joined("project_type").alias("project_type"), "project_sponsor", joined("project_location").alias("project_location"), "project_description")


@query("SELECT project_id, process_type, array_to_string(lead_agency, ';') AS lead_agency, '' AS process_family FROM projects")
def s1_processes(c):
    return ingest.processes(c.records).select("project_id", "process_type", joined("lead_agency").alias("lead_agency"), "process_family")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 100 AND l_linenumber = 1", base=False)
def s3_pushed_filter(c):
    # a stored column against a literal: both tests reach the Parquet scan
    return c.table("lineitem").where("l_orderkey = 100 and l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT project_id, document_id, coalesce(document_type, '') AS document_type, file_name, coalesce(main_document, '') AS main_document, total_pages::VARCHAR AS total_pages FROM documents_ JOIN projects USING (project_id)")
def p2_documents(c):
    return ingest.documents(c.records).select("project_id", "document_id", "document_type", "file_name", "main_document", "total_pages")


@query("SELECT document_id, page_number, page_text FROM pages_ JOIN projects USING (project_id)")
def p3_pages(c):
    return ingest.pages(c.records)


@query("SELECT event_id, coalesce(json_extract_string(props, '$.value'), props) AS raw_id FROM events", base=False)
def p4_id_unwrap(c):
    p = F.col("props")
    return c.table("events").select("event_id", F.coalesce(F.get_json_object(p, "$.value"), p).alias("raw_id"))


@query("SELECT project_id, process_type FROM projects")
def p6_process_map(c):
    return c.projects.select("project_id", "process_type")


@query("SELECT document_id, TRY_CAST(regexp_extract(file_name, '-([0-9]+)', 1) AS INT)::BIGINT AS n, TRY_CAST(document_type AS INT)::BIGINT AS bad, left(file_name, 6) AS short FROM documents_")
def p10_casts(c):
    n = F.regexp_extract("file_name", "-([0-9]+)", 1).try_cast("int").cast("long")
    return c.documents.select("document_id", n.alias("n"), F.col("document_type").try_cast("int").cast("long").alias("bad"), F.substring("file_name", 1, 6).alias("short"))


@query("SELECT document_id FROM documents_ WHERE main_document IS DISTINCT FROM 'YES'")
def f1_null_safe_filter(c):
    return c.documents.where(~F.col("main_document").eqNullSafe("YES")).select("document_id")


@query("SELECT project_id FROM projects WHERE process_type IN ('CE', 'EIS')")
def f2_membership(c):
    return c.projects.where(F.col("process_type").isin("CE", "EIS")).select("project_id")


@query("SELECT project_id FROM projects WHERE lower(project_title) LIKE '%solar%'")
def f3_substring(c):
    return c.projects.where(tags.contains_any(F.col("project_title"), ["SOLAR".lower()])).select("project_id")


@query("SELECT document_id FROM documents_ WHERE regexp_matches(file_name, '(?i)draft_ea|appendix')")
def f4_regex(c):
    return c.documents.where(F.coalesce(F.col("file_name").rlike("(?i)draft_ea|appendix"), F.lit(False))).select("document_id")


@query("SELECT document_id FROM documents_ WHERE document_type IS NOT NULL AND document_type <> ''")
def f5_not_empty(c):
    return c.documents.where("document_type is not null and document_type <> ''").select("document_id")


@query("SELECT project_id, o_totalprice FROM projects WHERE o_totalprice > 1000 AND o_totalprice <= 50000 AND year(order_date) BETWEEN 1996 AND 1999")
def f6_range(c):
    return c.projects.where("o_totalprice > 1000 and o_totalprice <= 50000").where(F.year("order_date").between(1996, 1999)).select("project_id", "o_totalprice")


@query("SELECT project_sponsor, count(*) AS n FROM projects GROUP BY 1 HAVING count(*) >= 12")
def f7_having(c):
    return c.projects.groupBy("project_sponsor").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")


@query("SELECT tag, n FROM (SELECT tag, n, row_number() OVER (ORDER BY n DESC, tag) AS r FROM (SELECT unnest(project_type) AS tag, count(*) AS n FROM projects GROUP BY 1)) WHERE r > 1")
def f8_drop_top(c):
    n = reports.tag_rows(c.projects, "project_type").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.orderBy(F.col("n").desc(), "tag"))).where("r > 1").drop("r")  # one row per tag


@query("SELECT project_id, energy FROM tagged")
def f9_reclassify(c):
    return c.tagged.select("project_id", "energy")


@query(f"SELECT project_id, coalesce(list_contains(project_type, 'Broadband'), false) AS has, coalesce(list_has_any(project_type, {_sql_list(TAGS[1:3])}), false) AS any_of FROM projects")
def f10_array_contains(c):
    t = F.col("project_type")
    return c.projects.select(
        "project_id", F.coalesce(F.array_contains(t, "Broadband"), F.lit(False)).alias("has"), F.coalesce(F.arrays_overlap(t, tags.words(TAGS[1:3])), F.lit(False)).alias("any_of")
    )


# tag sets


@query("SELECT project_id, project_energy_type FROM tagged")
def c1_energy(c):
    return c.tagged.select("project_id", "project_energy_type")


@query("SELECT project_id, project_energy_type_questions FROM tagged")
def c2_questions(c):
    return c.tagged.select("project_id", "project_energy_type_questions")


@query("SELECT project_id, project_type_count, project_type_count_clean, project_type_count_fossil FROM tagged")
def c3_counts(c):
    return c.tagged.select("project_id", "project_type_count", "project_type_count_clean", "project_type_count_fossil")


@query("SELECT project_id, project_is_utilities_broadband_only, project_is_nuclear_tech_only, project_utilities_to_exclude FROM tagged")
def c4_c5_c6_flags(c):
    return c.tagged.select("project_id", *_FLAGS[1:])


@query("SELECT project_id, project_energy_type_strict FROM tagged")
def c7_strict(c):
    return c.tagged.select("project_id", "project_energy_type_strict")


@query("SELECT project_id, project_nuclear_waste_to_exclude FROM tagged")
def c10_waste(c):
    return c.tagged.select("project_id", "project_nuclear_waste_to_exclude")


@query("""SELECT project_id, k % 7 = 0 AS military, CASE WHEN energy = 'Clean' AND k % 7 = 0 THEN 'Other' ELSE energy END AS energy,
  CASE WHEN project_energy_type = 'Clean' AND k % 7 = 0 THEN 'Other' ELSE energy_strict END AS strict FROM tagged""")
def c9_c11_filters(c):
    ids = c.projects.where("k % 7 = 0").select("project_id")
    df = tags.excluded(c.tagged.drop("project_military_to_exclude"), ids)
    return df.select("project_id", F.col("project_military_to_exclude").alias("military"), F.col("project_energy_type").alias("energy"), F.col("project_energy_type_strict").alias("strict"))


@query(f"SELECT project_id, coalesce(list_has_any(project_type, {_sql_list(fixed.NOTEBOOK_CLEAN)}), false) AS clean FROM projects")
def c17_notebook_clean(c):
    return c.projects.select("project_id", tags.notebook_clean(F.col("project_type")).alias("clean"))


@query("SELECT document_id, CASE document_type WHEN 'ROD' THEN 'decision' WHEN 'FONSI' THEN 'decision' WHEN 'FEIS' THEN 'final' WHEN 'DEIS' THEN 'draft' ELSE 'other' END AS category FROM documents_")
def c16_category_by_type(c):
    return c.documents.select("document_id", tags.document_category(F.col("document_type")).alias("category"))


@query("SELECT project_id, project_department FROM tagged")
def c12_department(c):
    return c.tagged.select("project_id", "project_department")


@query("SELECT project_id, len(project_state) > 1 AS multi_state, len(project_county) > 1 AS multi_county, len(lead_agency) > 1 AS multi_agency FROM projects")
def c14_multi(c):
    m = lambda n: tags.multiple(tags.json_list(F.to_json(F.col(n))))
    return c.tagged.select("project_id", m("project_state").alias("multi_state"), m("project_county").alias("multi_county"), m("lead_agency").alias("multi_agency"))


@query("SELECT document_id, category FROM documents_")
def c15_doctype(c):
    return c.documents.select("document_id", "category")


# joins


@query("SELECT p.project_id, d.document_id FROM projects p LEFT JOIN documents_ d USING (project_id)")
def j1_left(c):
    return c.projects.select("project_id").join(c.documents.select("project_id", "document_id"), "project_id", "left")


@query("""SELECT p.project_id, coalesce(bool_or(category = 'decision'), false) AS has_decision, coalesce(bool_or(category = 'final'), false) AS has_final, coalesce(bool_or(category = 'draft'), false) AS has_draft,
  coalesce(bool_or(category = 'appendix'), false) AS has_appendix, count(document_id) AS n FROM projects p LEFT JOIN documents_ d USING (project_id) GROUP BY 1""")
def a6_j2_document_flags(c):
    flags = ["decision", "final", "draft", "appendix"]
    some = c.documents.groupBy("project_id").agg(*[F.bool_or(F.col("category") == f).alias(f"has_{f}") for f in flags], F.count("document_id").alias("n"))
    out = c.projects.select("project_id").join(some, "project_id", "left")
    return out.select("project_id", *[F.coalesce(f"has_{f}", F.lit(False)).alias(f"has_{f}") for f in flags], F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT document_id, category, page_number FROM documents_ JOIN pages_ USING (document_id)")
def j3_inner(c):
    return c.documents.select("document_id", "category").join(c.pages.select("document_id", "page_number"), "document_id")


@query("""SELECT a.state, a.process_type, a.n, b.m FROM (SELECT project_state[1] AS state, process_type, count(*) AS n FROM projects GROUP BY 1, 2) a
  LEFT JOIN (SELECT project_state[1] AS st, process_type AS pt, count(*) AS m FROM projects WHERE k % 3 = 0 GROUP BY 1, 2) b ON a.state = b.st AND a.process_type = b.pt""")
def j4_multikey(c):
    df = c.tagged.select(F.get("project_state", F.lit(0)).alias("state"), "process_type", "k")
    a = df.groupBy("state", "process_type").agg(F.count(F.lit(1)).alias("n"))
    b = df.where("k % 3 = 0").groupBy(F.col("state").alias("st"), F.col("process_type").alias("pt")).agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, (a.state == b.st) & (a.process_type == b.pt), "left").select("state", a.process_type, "n", "m")


@query("SELECT document_id, page_number FROM pages_ WHERE document_id IN (SELECT document_id FROM documents_ WHERE main_document = 'YES')")
def j5_semi(c):
    return c.pages.join(c.documents.where("main_document = 'YES'"), "document_id", "left_semi").select("document_id", "page_number")


@query("SELECT project_id FROM projects WHERE project_id NOT IN (SELECT project_id FROM documents_)")
def j6_anti(c):
    return c.projects.join(c.documents, "project_id", "left_anti").select("project_id")


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation NATURAL LEFT JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region)", base=False)
def j9_natural(c):
    a, b = c.table("nation"), c.table("region").withColumnRenamed("r_regionkey", "n_regionkey")
    return a.join(b, [x for x in a.columns if x in b.columns], "left").select("n_nationkey", "n_name", "n_regionkey", "r_name")


def _decision_and_latest(c):
    """Two tables (project_id, day), from one that is written, so that pages are read once for both.

    The dates are written with all their columns before the join: at sf0.1 extraction took 21 s with all of them, and 95 s when
    followed by the join and totals in one plan.
    """
    found = staging.staged(c.page_dates, "dates")
    rows = found.join(c.documents.select("document_id", "project_id"), "document_id")
    decision = F.max(F.when(F.col("context") == "decision", F.col("date"))).alias("decision")
    both = staging.staged(rows.groupBy("project_id").agg(decision, F.max("date").alias("latest")), "days")
    return both.select("project_id", F.col("decision").alias("day")), both.select("project_id", F.col("latest").alias("day"))


@query("""SELECT project_id, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x = y END AS match_day FROM (SELECT project_id, max(date) FILTER (context = 'decision') AS x FROM page_dates GROUP BY 1)
  JOIN (SELECT project_id, max(date) AS y FROM page_dates GROUP BY 1) USING (project_id)""")
def j10_compare(c):
    return reports.compare(*_decision_and_latest(c), "project_id", ["day"])


# aggregates and reports


@query("SELECT dataset_source, energy, count(*) AS n FROM tagged GROUP BY 1, 2")
def a1_count(c):
    return c.tagged.groupBy("dataset_source", "energy").agg(F.count(F.lit(1)).alias("n"))


_CROSS = "count(*) FILTER (process_type = 'CE') AS \"CE\", count(*) FILTER (process_type = 'EA') AS \"EA\", count(*) FILTER (process_type = 'EIS') AS \"EIS\", count(*) AS \"Total\""


@query(f"SELECT energy, {_CROSS} FROM tagged GROUP BY 1")
def a2_crosstab_energy_process(c):
    return reports.crosstab(c.tagged, "energy")


@query(f"SELECT project_department, {_CROSS}, string_agg(DISTINCT energy, ' | ' ORDER BY energy) AS energy FROM tagged GROUP BY 1")
def a3_crosstab_keep(c):
    return reports.crosstab_with(c.tagged, "project_department", ["energy"])


@query(f"SELECT coalesce(energy, 'Total') AS energy, {_CROSS}, grouping(energy)::INT AS is_total FROM tagged GROUP BY ROLLUP (energy)")
def a4_totals(c):
    return reports.crosstab_with_total(c.tagged, "energy")


@query(f"SELECT coalesce(project_department, 'Total') AS project_department, {_CROSS}, 1 - grouping(project_department)::INT AS is_total FROM tagged GROUP BY ROLLUP (project_department)")
def a5_totals_on_top(c):
    return reports.crosstab_with_total(c.tagged, "project_department", on_top=True)


@query("SELECT category, count(*) AS n, count(*) FILTER (main_document = 'YES') AS main, count(*) FILTER (document_type IS NOT NULL) AS typed FROM documents_ GROUP BY 1")
def a7_cond_counts(c):
    return reports.conditional_counts(c.documents, ["category"], main=F.col("main_document") == "YES", typed=F.col("document_type").isNotNull())


@query("SELECT process_type, energy, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY process_type), 4) AS pct FROM tagged GROUP BY 1, 2")
def a8_share_group(c):
    return reports.counts_with_share(c.tagged, ["process_type", "energy"], ["process_type"])


@query("SELECT energy, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM tagged GROUP BY 1")
def a9_share_total(c):
    return reports.counts_with_share(c.tagged, ["energy"], [])


@query("SELECT dataset_source, count(DISTINCT project_title) AS titles, count(DISTINCT project_sponsor) AS sponsors FROM projects GROUP BY 1")
def a10_distinct(c):
    return c.projects.groupBy("dataset_source").agg(F.countDistinct("project_title").alias("titles"), F.countDistinct("project_sponsor").alias("sponsors"))


@query(f"SELECT project_department, \"Total\", round(\"CE\" / \"Total\", 6) AS ce_ratio, round(\"EIS\" / \"Total\", 6) AS eis_ratio FROM (SELECT project_department, {_CROSS} FROM tagged GROUP BY 1) WHERE \"Total\" >= 50")
def a11_ratio(c):
    t = reports.crosstab(c.tagged, "project_department").where("Total >= 50")
    return t.select("project_department", "Total", F.round(F.try_divide("CE", "Total"), 6).alias("ce_ratio"), F.round(F.try_divide("EIS", "Total"), 6).alias("eis_ratio"))


@query("""SELECT dataset_source, count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean, round(median(o_totalprice), 6) AS median, min(o_totalprice) AS least, max(o_totalprice) AS most,
  round(stddev_samp(o_totalprice), 6) AS sd, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.75), 6) AS q3 FROM projects GROUP BY 1""")
def a12_stats(c):
    return reports.statistics(c.projects, ["dataset_source"], "o_totalprice")


@query("""SELECT project_sponsor, n, CASE WHEN n >= q[3] THEN 'top' WHEN n >= q[2] THEN 'high' WHEN n >= q[1] THEN 'medium' ELSE 'low' END AS tier
  FROM (SELECT project_sponsor, count(*) AS n FROM projects GROUP BY 1) t, (SELECT quantile_cont(n, [0.4, 0.7, 0.9]) AS q FROM (SELECT count(*) AS n FROM projects GROUP BY project_sponsor))""")
def a13_tiers(c):
    return reports.quantile_tiers(c.projects.groupBy("project_sponsor").agg(F.count(F.lit(1)).alias("n")), "n")


@query("SELECT energy, count(*) AS n FROM (SELECT CASE WHEN k % 5 = 0 THEN NULL ELSE energy END AS energy FROM tagged) GROUP BY 1")
def a16_value_counts(c):
    return c.tagged.select(F.when(F.col("k") % 5 != 0, F.col("energy")).alias("energy")).groupBy("energy").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT dataset_source, round(avg((project_type IS NOT NULL)::INT) * 100, 6) AS pct_tagged FROM projects GROUP BY 1")
def a17_coverage(c):
    return c.projects.groupBy("dataset_source").agg(F.round(F.avg(F.col("project_type").isNotNull().cast("double")) * 100, 6).alias("pct_tagged"))


@query("SELECT project_id, string_agg(DISTINCT document_type, ', ' ORDER BY document_type) AS types FROM documents_ GROUP BY 1")
def a19_strings(c):
    types = F.array_sort(F.collect_set("document_type"))
    return c.documents.groupBy("project_id").agg(F.when(F.size(types) > 0, F.array_join(types, ", ")).alias("types"))


@query("SELECT dataset_source, string_agg(tag, ', ' ORDER BY n DESC, tag) AS values FROM (SELECT dataset_source, unnest(project_type) AS tag, count(*) AS n FROM projects GROUP BY 1, 2) GROUP BY 1")
def a20_freq_list(c):
    return reports.frequent_first(c.projects, "dataset_source", "project_type")


_PAIRS = """, t AS (SELECT project_id, unnest(project_type) AS tag FROM projects), pairs AS (
  SELECT a.tag, b.tag AS other, count(*) AS n FROM t a JOIN t b ON a.project_id = b.project_id AND a.tag <> b.tag GROUP BY 1, 2
), totals AS (SELECT tag, count(*) AS total FROM t GROUP BY 1)
"""


@query(_PAIRS + "SELECT tag, other, n, total, round(n * 100.0 / total, 1) AS pct FROM pairs JOIN totals USING (tag) WHERE round(n * 100.0 / total, 1) > 5")
def a21_cooccur(c):
    return reports.cooccurrence(c.projects, "project_type", TAGS)


@query(_PAIRS + """, r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, other) AS i FROM pairs)
  SELECT tag, max(other) FILTER (i = 1) AS other_1, max(n) FILTER (i = 1) AS n_1, max(other) FILTER (i = 2) AS other_2, max(n) FILTER (i = 2) AS n_2, max(other) FILTER (i = 3) AS other_3, max(n) FILTER (i = 3) AS n_3 FROM r GROUP BY 1""")
def a22_cooccur_top3(c):
    return reports.cooccurrence_top(c.projects, "project_type", TAGS)


@query(_PAIRS + "SELECT a.tag, a.project_id, b.tag AS other FROM t a JOIN t b ON a.project_id = b.project_id AND a.tag <> b.tag WHERE a.tag = 'Broadband'")
def a23_cooccur_detail(c):
    return reports.tag_pairs(c.projects, "project_type", ["Broadband"]).select("tag", "project_id", "other")


@query("SELECT CASE WHEN project_type_count >= 5 THEN '5+' ELSE project_type_count::VARCHAR END AS tags, CASE WHEN project_type_count - project_type_count_clean >= 2 THEN '2+' ELSE (project_type_count - project_type_count_clean)::VARCHAR END AS other, count(*) AS n FROM tagged GROUP BY 1, 2")
def a24_tag_buckets(c):
    n, o = F.col("project_type_count"), F.col("project_type_count") - F.col("project_type_count_clean")
    df = c.tagged.select(F.when(n >= 5, "5+").otherwise(n.cast("string")).alias("tags"), F.when(o >= 2, "2+").otherwise(o.cast("string")).alias("other"))
    return df.groupBy("tags", "other").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT project_type_count, project_type_count_clean, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY project_type_count), 4) AS pct FROM tagged GROUP BY 1, 2")
def a25_two_counts(c):
    return reports.counts_with_share(c.tagged, ["project_type_count", "project_type_count_clean"], ["project_type_count"])


@query(f"""SELECT state, CASE WHEN county IS NULL THEN state ELSE '  └─ ' || county END AS label, CASE WHEN county IS NULL THEN 'State' ELSE 'County' END AS level, {_CROSS}
  FROM (SELECT project_state[1] AS state, unnest(CASE WHEN len(project_county) = 0 THEN [NULL] ELSE project_county END) AS county, process_type FROM projects) GROUP BY 1, 2, 3""")
def a26_state_county(c):
    return reports.nested_places(c.tagged.withColumn("first_state", F.get("project_state", F.lit(0))), "first_state", "project_county")


@query(f"SELECT coalesce(y, 'Total') AS y, {_CROSS}, grouping(y)::INT AS is_total FROM (SELECT year(order_date)::VARCHAR AS y, process_type FROM projects WHERE year(order_date) BETWEEN 1995 AND 2000) GROUP BY ROLLUP (y)")
def a28_year_process(c):
    df = c.projects.withColumn("y", F.year("order_date")).where("y between 1995 and 2000").withColumn("y", F.col("y").cast("string"))
    return reports.crosstab_with_total(df, "y").orderBy("is_total", F.col("y").desc())


@query(f"SELECT coalesce(project_department, 'Total') AS project_department, {_CROSS}, grouping(project_department)::INT AS is_total FROM tagged GROUP BY ROLLUP (project_department)")
def o1_sorted_crosstab(c):
    return reports.sorted_crosstab(c.tagged, "project_department")


@query("""SELECT CASE WHEN y <= 1 THEN '<=1' WHEN y <= 2 THEN '1-2' WHEN y <= 5 THEN '2-5' WHEN y <= 10 THEN '5-10' ELSE '>10' END AS bucket, count(*) AS n
  FROM (SELECT project_id, date_diff('day', min(date), max(date)) / 365 AS y FROM page_dates GROUP BY 1) GROUP BY 1""")
def a29_duration(c):
    rows = c.page_dates.join(c.documents.select("document_id", "project_id"), "document_id").groupBy("project_id").agg(F.datediff(F.max("date"), F.min("date")).alias("d"))
    return rows.select(dates.duration_bucket(F.col("d")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


_CAPACITY = """, own AS (SELECT * FROM caps WHERE document_id IN (SELECT document_id FROM documents_ WHERE main_document = 'YES')),
has_main AS (SELECT DISTINCT project_id FROM own), others AS (SELECT * FROM caps WHERE project_id NOT IN (SELECT project_id FROM has_main)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY unit = 'MW' DESC, value DESC, document_id, page_number) AS i FROM (SELECT * FROM own UNION ALL SELECT * FROM others)) WHERE i = 1),
energy_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY value DESC, document_id, page_number) AS i FROM (SELECT * FROM own UNION ALL SELECT * FROM others) WHERE flag = 'R') WHERE i = 1),
cap AS (
  SELECT p.project_id, CASE WHEN p.k % 10 = 0 THEN (p.k % 900 + 1)::DOUBLE ELSE b.value END AS value, CASE WHEN p.k % 10 = 0 THEN 'MW' ELSE b.unit END AS unit,
    CASE WHEN p.k % 10 <> 0 THEN e.value END AS energy_value, CASE WHEN p.k % 10 <> 0 AND e.value IS NOT NULL THEN 'MWh' END AS energy_unit,
    CASE WHEN p.k % 10 = 0 THEN 'title' WHEN b.value IS NOT NULL THEN 'document' ELSE 'no_documents' END AS source,
    CASE WHEN p.k % 10 = 0 THEN 'high' ELSE coalesce(b.confidence, 'low') END AS confidence, p.dataset_source
  FROM projects p LEFT JOIN best b USING (project_id) LEFT JOIN energy_best e USING (project_id)
)
"""


def _capacity(c):
    return capacity.project_capacity(c.projects.select("project_id", "project_title"), c.documents, c.pages)


@query(_CAPACITY + """, texts AS (
  SELECT project_id, 'power' AS kind, document_id, page_number, 0 AS o, CASE flag WHEN 'A' THEN qty::INT || ' MW' WHEN 'N' THEN size || ' kW' ELSE size || ' MW' END AS match FROM pages_
  UNION ALL SELECT project_id, 'power', document_id, page_number, 1, CASE flag WHEN 'A' THEN 'generate ' || qty::INT || ' MW' ELSE 'rated ' || size || ' kW' END FROM pages_ WHERE flag <> 'R'
  UNION ALL SELECT project_id, 'energy', document_id, page_number, 2, size || ' MWh battery' FROM pages_ WHERE flag = 'R'
), used AS (SELECT * FROM texts WHERE document_id IN (SELECT document_id FROM documents_ WHERE main_document = 'YES') UNION ALL SELECT * FROM texts WHERE project_id NOT IN (SELECT project_id FROM has_main)),
firsts AS (SELECT project_id, kind, string_agg(match, ';' ORDER BY document_id, page_number, o) AS m FROM (SELECT *, row_number() OVER (PARTITION BY project_id, kind ORDER BY document_id, page_number, o) AS i FROM used) WHERE i <= 5 GROUP BY 1, 2)
SELECT c.project_id, value, unit, energy_value, energy_unit, CASE WHEN source = 'title' THEN (k % 900 + 1) || '-MW solar;A ' || (k % 900 + 1) || '-MW solar' ELSE coalesce(p.m, '') END AS matches,
  CASE WHEN source = 'title' THEN '' ELSE coalesce(e.m, '') END AS energy_matches, source, confidence, CASE WHEN source = 'title' THEN project_title END AS title_context
FROM cap c JOIN projects USING (project_id) LEFT JOIN firsts p ON p.project_id = c.project_id AND p.kind = 'power' LEFT JOIN firsts e ON e.project_id = c.project_id AND e.kind = 'energy'""")
def n9_project_capacity(c):
    title = F.when(F.col("source") == "title", F.col("context")).alias("title_context")
    return _capacity(c).withColumns({"matches": joined("matches"), "energy_matches": joined("energy_matches")}).select("project_id", "value", "unit", "energy_value", "energy_unit", "matches", "energy_matches", "source", "confidence", title)


@query(_CAPACITY + ", chosen AS (SELECT project_id FROM tagged WHERE project_energy_type = 'Clean' AND dataset_source = 'EA') SELECT project_id, value, unit, source FROM cap JOIN chosen USING (project_id)")
def n10_capacity_run(c):
    run = capacity.run_capacity(c.tagged, c.documents, c.pages, source="ea")
    return run.select("project_id", F.col("project_gencap_value").alias("value"), F.col("project_gencap_unit").alias("unit"), F.col("project_gencap_source").alias("source"))


@query("""SELECT project_id, count(*) AS n_pages, true AS has_capacity FROM (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY page_number) AS i FROM pages_
  JOIN (SELECT project_id, min(document_id) AS document_id FROM documents_ WHERE main_document = 'YES' GROUP BY 1) USING (project_id, document_id)) WHERE i <= 20 GROUP BY 1""")
def n15_first_pages(c):
    return capacity.first_page_coverage(c.documents, c.pages)


@query(_CAPACITY + """SELECT CASE WHEN mw < 10 THEN 'Small' WHEN mw < 100 THEN 'Medium' WHEN mw < 500 THEN 'Large' WHEN mw IS NOT NULL THEN 'Utility-scale' END AS bucket, count(*) AS n
  FROM (SELECT CASE unit WHEN 'kW' THEN value / 1000 ELSE value END AS mw FROM cap) GROUP BY 1""")
def a30_n11_capacity_bucket(c):
    mw = capacity.to_megawatts(F.col("value"), F.col("unit"))
    return _capacity(c).select(capacity.capacity_bucket(mw).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(_CAPACITY + "SELECT dataset_source, count(*) AS n, count(value) AS found, count(*) FILTER (value <= 100) AS small, round(count(value) * 100.0 / count(*), 4) AS pct FROM cap GROUP BY 1")
def a31_coverage(c):
    df = _capacity(c).join(c.projects.select("project_id", "dataset_source"), "project_id")
    n = reports.conditional_counts(df, ["dataset_source"], found=F.col("value").isNotNull(), small=F.col("value") <= 100)
    return n.withColumn("pct", F.round(F.col("found") * 100 / F.col("n"), 4))


@query("SELECT n_docs, count(*) AS projects, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM (SELECT project_id, count(*) AS n_docs FROM documents_ GROUP BY 1) GROUP BY 1")
def a32_docs_hist(c):
    n = c.documents.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_docs")).groupBy("n_docs").agg(F.count(F.lit(1)).alias("projects"))
    return n.withColumn("pct", F.round(reports.share(F.col("projects")), 4))


@query("""SELECT CASE WHEN d = 1 THEN '1' WHEN d = 2 THEN '2' WHEN d <= 5 THEN '3-5' ELSE '6+' END AS stratum, count(*) AS projects, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct
  FROM (SELECT count(*) AS d FROM documents_ GROUP BY project_id) GROUP BY 1""")
def a32_strata(c):
    return reports.per_project_strata(c.documents)


@query("SELECT main_document, count(*) AS n, round(avg(total_pages), 6) AS mean, median(total_pages) AS median, max(total_pages) AS most FROM documents_ GROUP BY 1")
def a33_page_stats(c):
    p = F.col("total_pages")
    plain = c.documents.groupBy("main_document").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean"), F.max(p).alias("most"))
    half = reports.quantiles(c.documents, ["main_document"], "total_pages", [0.5]).select(F.col("main_document").alias("m"), F.get("q", F.lit(0)).alias("median"))
    return plain.join(half, F.col("main_document").eqNullSafe(F.col("m"))).drop("m")


@query("SELECT project_id, project_title, process_type FROM tagged WHERE project_is_utilities_broadband_only OR project_is_nuclear_tech_only")
def a37_listing(c):
    return c.tagged.where("project_is_utilities_broadband_only or project_is_nuclear_tech_only").select("project_id", "project_title", "process_type")


@query("SELECT process_type, count(*) FILTER (project_is_utilities_broadband_only) AS utilities, count(*) FILTER (project_is_nuclear_tech_only) AS nuclear, count(*) AS n FROM tagged GROUP BY 1")
def a37_counts(c):
    return reports.conditional_counts(c.tagged, ["process_type"], utilities=F.col("project_is_utilities_broadband_only"), nuclear=F.col("project_is_nuclear_tech_only"))


@query("""SELECT broad, strict, broad - strict AS excluded, round((broad - strict) * 100.0 / broad, 4) AS pct FROM (SELECT count(*) FILTER (project_energy_type = 'Clean') AS broad, count(*) FILTER (project_energy_type_strict = 'Clean') AS strict FROM tagged)""")
def a36_strict_against_broad(c):
    return reports.strict_against_broad(c.tagged)


@query("SELECT tag, count(*) AS n FROM (SELECT trim(unnest(string_split(regexp_replace(to_json(project_type)::VARCHAR, '[\\[\\]\"]', '', 'g'), ','))) AS tag FROM projects WHERE project_type IS NOT NULL) WHERE tag <> '' GROUP BY 1")
def a35_tag_words(c):
    return reports.tag_frequencies(c.projects.select(F.to_json("project_type").alias("t")), "t")


@query("SELECT process_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM projects WHERE len(project_state) > 1 GROUP BY 1")
def a34_multi_share(c):
    return reports.counts_with_share(c.tagged.where(F.size("project_state") > 1), ["process_type"], [])


@query("SELECT project_id, project_department FROM tagged WHERE list_contains(s, 'waste management') AND list_contains(s, 'nuclear technology') AND NOT project_nuclear_waste_to_exclude")
def a39_candidates(c):
    return reports.tag_candidates(c.tagged, "project_type", ("Waste Management", "Nuclear"), F.col("project_nuclear_waste_to_exclude")).select("project_id", "project_department")


_SAMPLED = ", picked AS (SELECT project_id FROM projects ORDER BY md5('42:' || project_id), project_id LIMIT 20)"


@query(_SAMPLED + """ SELECT project_id, d.document_id, document_type, coalesce(n, 0) AS n_pages, preview FROM documents_ d LEFT JOIN
  (SELECT document_id, count(*) AS n, left(arg_min(page_text, page_number), 500) AS preview FROM pages_ GROUP BY 1) USING (document_id) WHERE project_id IN (SELECT project_id FROM picked)""")
def a38_sample_inspection(c):
    return reports.sample_documents(reports.sample(c.projects.select("project_id"), "project_id", 20), c.documents, c.pages)


@query("SELECT project_id, n FROM (SELECT project_id, count(*) AS n FROM documents_ GROUP BY 1 HAVING count(*) >= 4) ORDER BY md5('7:' || project_id), project_id LIMIT 3")
def l5_eligible(c):
    return reports.eligible_group(c.documents, "project_id", 4, 3, seed=7)


_LISTS = ", lists AS (SELECT array_to_string(project_state, ' - ') AS label, count(*) AS n, any_value(project_state) AS states FROM projects WHERE len(project_state) > 1 GROUP BY 1)"


@query(_LISTS + f""" SELECT label, "CE", "EA", "EIS", "Total" FROM (SELECT *, row_number() OVER (ORDER BY "Total" DESC, list) AS r FROM (SELECT array_to_string(project_state, ', ') AS label, to_json(project_state)::VARCHAR AS list, {_CROSS} FROM projects WHERE len(project_state) > 1 GROUP BY 1, 2)) WHERE r > 1""")
def g7_multi_state(c):
    return reports.multi_value_table(c.tagged, "project_state")


@query(f"""{_LISTS}, top AS (SELECT array_to_string(project_state, ' - ') AS label, {_CROSS} FROM projects WHERE len(project_state) > 1 GROUP BY 1 ORDER BY "Total" DESC, label LIMIT 10),
  listed AS (SELECT label, string_agg(tag, ', ' ORDER BY n DESC, tag) AS kinds FROM (SELECT array_to_string(project_state, ' - ') AS label, unnest(project_type) AS tag, count(*) AS n FROM projects WHERE len(project_state) > 1 GROUP BY 1, 2) GROUP BY 1)
  SELECT top.*, listed.kinds FROM top LEFT JOIN listed USING (label)""")
def g11_connections(c):
    return reports.top_connections(c.tagged, "project_state", "project_type")


# windows, samples, sets


@query("SELECT project_sponsor, n FROM (SELECT project_sponsor, n, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT project_sponsor, count(*) AS n FROM projects GROUP BY 1)) WHERE r <= 10")
def w3_topn_ties(c):
    return reports.top_with_ties(c.projects.groupBy("project_sponsor").agg(F.count(F.lit(1)).alias("n")), "n", 10)


@query("""SELECT user_id, island::BIGINT AS island, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT user_id, s, e, CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END AS fresh FROM (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
  FROM (SELECT user_id, event_id * 3 AS s, event_id * 3 + CAST(floor(value) AS BIGINT) AS e FROM events)))) GROUP BY 1, 2""", base=False)
def w5_merge(c):
    e = c.table("events").select("user_id", (F.col("event_id") * 3).alias("s"), (F.col("event_id") * 3 + F.floor("value")).alias("e"))
    return merge_windows(e, ["user_id"], "s", "e").groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT project_id FROM projects ORDER BY md5('42:' || project_id), project_id LIMIT 100")
def l3_sample(c):
    return reports.sample(c.projects.select("project_id"), "project_id", 100)


@query("SELECT dataset_source, project_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_source ORDER BY md5('42:' || project_id), project_id) AS i FROM projects) WHERE i <= 30")
def l4_stratified(c):
    return reports.sample(c.projects.select("dataset_source", "project_id"), "project_id", 30, strata=["dataset_source"])


@query("SELECT project_id, dataset_source, NULL::BIGINT AS extra FROM projects WHERE dataset_source = 'CE' UNION ALL SELECT project_id, dataset_source, k AS extra FROM projects WHERE dataset_source = 'EA'")
def u1_union(c):
    a = c.projects.where("dataset_source = 'CE'").select("project_id", "dataset_source")
    return a.unionByName(c.projects.where("dataset_source = 'EA'").select("project_id", "dataset_source", F.col("k").alias("extra")), allowMissingColumns=True)


@query("SELECT DISTINCT project_department, energy FROM tagged")
def u2_distinct(c):
    return c.tagged.select("project_department", "energy").distinct()


@query(f"SELECT project_id, len(list_intersect(s, {_sql_list(fixed.CLEAN)})) AS both, len(list_filter(s, lambda x: NOT list_contains({_sql_list(fixed.CLEAN)}, x))) AS rest FROM tagged")
def u3_setops(c):
    s, clean = tags.tag_set(F.col("project_type")), tags.words(fixed.CLEAN)
    return c.projects.select("project_id", F.size(F.array_intersect(s, clean)).cast("long").alias("both"), F.size(F.array_except(s, clean)).cast("long").alias("rest"))


@query("SELECT project_id, unnest(CASE WHEN project_type IS NULL THEN [NULL] ELSE project_type END) AS tag FROM projects")
def e1_explode(c):
    j = F.to_json("project_type")
    return c.projects.select("project_id", F.explode_outer(F.coalesce(F.from_json(j, "array<string>"), F.array(F.lit(None).cast("string")))).alias("tag"))


# places and links


@query("SELECT project_id, CASE WHEN k % 2 = 0 THEN 30.5 + k % 19 END::DOUBLE AS lat, CASE WHEN k % 2 = 0 THEN -(70.25 + k % 50) END::DOUBLE AS lon FROM projects")
def g2_latlon(c):
    t = F.col("project_location")
    return c.projects.select("project_id", places.latitude(t).alias("lat"), places.longitude(t).alias("lon"))


@query("SELECT project_id, array_to_string(project_state, ';') AS states FROM projects")
def g3_states(c):
    return c.projects.select("project_id", joined(places.states(F.col("project_location"))).alias("states"))


@query("SELECT project_id, array_to_string(project_county, ';') AS counties FROM projects")
def g4_counties(c):
    return c.projects.select("project_id", joined(places.counties(F.col("project_location"))).alias("counties"))


_PLACES = [(n, 25.0 + (i * 7) % 23, -120.0 + (i * 11) % 50) for i, n in enumerate(STATE_NAMES)]
_PLACES_SQL = ", ".join(f"('{n}', {a}, {b})" for n, a, b in _PLACES)


@query(f""", pl(name, lat, lon) AS (VALUES {_PLACES_SQL}), lists AS (SELECT array_to_string(project_state, ';') AS list_id, any_value(project_state) AS states, count(*) AS n FROM projects WHERE len(project_state) > 1 GROUP BY 1),
  r AS (SELECT list_id, n, name, lead(name) OVER (PARTITION BY list_id ORDER BY lat, name) AS t FROM (SELECT list_id, n, unnest(states) AS name FROM lists) JOIN pl USING (name)),
  e AS (SELECT name AS f, t, sum(n)::BIGINT AS n FROM r WHERE t IS NOT NULL GROUP BY 1, 2)
  SELECT f AS "from", t AS "to", n, a.lat::DOUBLE AS lat_from, a.lon::DOUBLE AS lon_from, b.lat::DOUBLE AS lat_to, b.lon::DOUBLE AS lon_to, ((a.lon + b.lon) / 2)::DOUBLE AS lon_mid FROM e LEFT JOIN pl a ON a.name = f LEFT JOIN pl b ON b.name = t
  WHERE a.lon BETWEEN -130 AND -66 AND b.lon BETWEEN -130 AND -66 AND a.lat BETWEEN 20 AND 50 AND b.lat BETWEEN 20 AND 50""")
def g8_links(c):
    lists = c.tagged.where(F.size("project_state") > 1).groupBy(joined("project_state").alias("list_id")).agg(F.first("project_state").alias("states"), F.count(F.lit(1)).alias("n"))
    where = c.spark.createDataFrame(_PLACES, "name string, lat double, lon double")
    return reports.in_box(reports.link_edges(lists, where))


@query(f""", pl(name, lat, lon) AS (VALUES {_PLACES_SQL}), pts AS (SELECT project_id, 30 + k % 19 + 0.5 AS a, -(70 + k % 50 + 0.25) AS b FROM projects WHERE k % 2 = 0)
  SELECT project_id, arg_min(name, round(pow(sin(radians(lat - a) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin(radians(lon - b) / 2), 2), 12)) AS nearest FROM pts, pl GROUP BY 1""")
def g6_nearest_place(c):
    where = c.spark.createDataFrame(_PLACES, "name string, lat double, lon double")
    points = c.tagged.where("project_lat is not null and project_lon is not null").select("project_id", F.col("project_lat").alias("lat"), F.col("project_lon").alias("lon"))
    return geo.nearest(points, where).select("project_id", F.col("nearest").alias("nearest"))


@query(f"SELECT state, {_CROSS} FROM (SELECT unnest(project_state) AS state, process_type FROM projects) GROUP BY 1")
def g12_state_counts(c):
    return reports.crosstab(c.tagged.select(F.explode("project_state").alias("state"), "process_type"), "state")


# dates


@query("SELECT document_id, page_number, date::VARCHAR AS date, context FROM page_dates")
def t6_dates(c):
    return c.page_dates.select("document_id", "page_number", F.col("date").cast("string").alias("date"), "context")


_PRIORITY = """, ranked AS (SELECT *, CASE category WHEN 'decision' THEN 1 WHEN 'final' THEN 2 WHEN 'draft' THEN 3 WHEN 'other' THEN 4 ELSE 5 END AS r FROM documents_),
chosen AS (SELECT * FROM ranked QUALIFY r = min(r) OVER (PARTITION BY project_id)), dd AS (SELECT c.project_id, d.* EXCLUDE (project_id) FROM page_dates d JOIN chosen c USING (document_id)),
merged AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY project_id, date ORDER BY context = 'unknown', document_id, page_number) = 1)
"""


@query(_PRIORITY + "SELECT project_id, document_id FROM chosen")
def t7_priority(c):
    return dates.priority_documents(c.documents).select("project_id", "document_id")


def _merged(c):
    chosen = dates.priority_documents(c.documents).select("project_id", "document_id")
    return dates.merge_dates(c.page_dates.join(chosen, "document_id"))


@query(_PRIORITY + "SELECT project_id, document_id, page_number, date::VARCHAR AS date, context FROM merged")
def t8_merge(c):
    return _merged(c).select("project_id", "document_id", "page_number", F.col("date").cast("string").alias("date"), "context")


@query(_PRIORITY + """, sums AS (SELECT project_id, min(date) AS a, max(date) AS b, max(date) FILTER (context = 'decision') AS d, string_agg(date::VARCHAR, ';' ORDER BY date) FILTER (i <= 20) AS dates
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY date) AS i FROM merged) GROUP BY 1), nd AS (SELECT project_id, count(*) AS n, count(*) FILTER (main_document = 'YES') AS m FROM documents_ GROUP BY 1)
  SELECT project_id, a::VARCHAR AS earliest, b::VARCHAR AS latest, d::VARCHAR AS decision, date_diff('day', a, b) AS duration_days, year(coalesce(d, b)) AS year, coalesce(n, 0) AS n_documents, coalesce(m, 0) AS n_main, dates,
  CASE WHEN a IS NULL THEN NULL ELSE array_to_string(list_filter([CASE WHEN date_diff('day', a, b) > 3650 THEN 'long_duration' END, CASE WHEN d IS NULL THEN 'no_decision_date' END], lambda x: x IS NOT NULL), ';') END AS reasons
  FROM projects LEFT JOIN sums USING (project_id) LEFT JOIN nd USING (project_id)""")
def t9_t10_timeline(c):
    t = dates.timelines(c.projects, c.documents, _merged(c))
    s = [F.col(x).cast("string").alias(x) for x in ("earliest", "latest", "decision")]
    return t.select("project_id", *s, F.col("duration_days").cast("long").alias("duration_days"), F.col("year").cast("long").alias("year"), "n_documents", "n_main", joined(F.transform("dates", lambda x: x.cast("string"))).alias("dates"), joined("review_reasons").alias("reasons"))


@query("SELECT document_id, page_number, day::VARCHAR AS date FROM pages_")
def t16_hybrid(c):
    return dates.hybrid_candidates(c.pages, "page_text", ["document_id", "page_number"]).select("document_id", "page_number", F.col("date").cast("string").alias("date"))


_RUN = """, chosen AS (SELECT project_id FROM tagged WHERE energy = 'Clean' AND dataset_source = 'CE'), own AS (SELECT * FROM documents_ WHERE project_id IN (SELECT project_id FROM chosen))"""


@query(_RUN + """, ranked AS (SELECT *, CASE category WHEN 'decision' THEN 1 WHEN 'final' THEN 2 WHEN 'draft' THEN 3 WHEN 'other' THEN 4 ELSE 5 END AS r FROM own),
  dd AS (SELECT * FROM page_dates WHERE document_id IN (SELECT document_id FROM (SELECT * FROM ranked QUALIFY r = min(r) OVER (PARTITION BY project_id)) WHERE main_document = 'YES'))
  SELECT project_id, min(date)::VARCHAR AS earliest, max(date)::VARCHAR AS latest, count(DISTINCT date) AS n_dates, any_value(n) AS n_documents FROM chosen LEFT JOIN dd USING (project_id) LEFT JOIN (SELECT project_id, count(*) AS n FROM own GROUP BY 1) USING (project_id) GROUP BY 1""")
def t12_timeline_run(c):
    options = runs.Options(clean_only=True, ce_only=True, main_docs_only=True)
    made = runs.run_timelines(_analysis(c), c.documents, c.pages, options)
    n = F.when(F.col("project_timeline_n_documents") > 0, F.col("project_timeline_n_documents"))
    size = F.coalesce(F.size("project_timeline_dates"), F.lit(0))
    s = lambda x: F.col(f"project_timeline_{x}").cast("string").alias(x)
    return made.select("project_id", s("earliest"), s("latest"), F.greatest(size, F.lit(0)).cast("long").alias("n_dates"), n.alias("n_documents"))


def _analysis(c):
    return c.tagged.drop("project_energy_type").withColumnRenamed("energy", "project_energy_type")


@query(_RUN + """, pg AS (SELECT project_id, document_id, page_number, page_text, day FROM pages_ WHERE document_id IN (SELECT document_id FROM own WHERE main_document = 'YES'))
  SELECT project_id, min(day)::VARCHAR AS first_date, max(length(page_text)) > 0 AS some FROM pg GROUP BY 1""")
def t17_candidates(c):
    found = runs.date_candidates(_analysis(c), c.documents, c.pages)
    return found.groupBy("project_id").agg(F.min("date").cast("string").alias("first_date"), (F.max(F.length("context")) > 0).alias("some"))


@query(_RUN + """, pg AS (SELECT project_id, sum(length(page_text)) + 2 * (count(*) - 1) AS total_chars, max(day) FILTER (flag = 'A') AS signed FROM pages_ WHERE document_id IN (SELECT document_id FROM own WHERE main_document = 'YES') GROUP BY 1)
  SELECT project_id, coalesce(n, 0) AS documents, total_chars::BIGINT AS total_chars, CASE WHEN n IS NULL THEN 'no_documents' WHEN total_chars IS NULL THEN 'no_pages' END AS error, signed::VARCHAR AS decision
  FROM chosen LEFT JOIN (SELECT project_id, count(*) AS n FROM own GROUP BY 1) USING (project_id) LEFT JOIN pg USING (project_id)""")
def x18_model_run(c):
    made = runs.model_timelines(_analysis(c), c.documents, c.pages, _signed_dates())
    return made.select("project_id", F.col("document_count").alias("documents"), F.col("total_chars").cast("long").alias("total_chars"), F.col("llm_error").alias("error"), F.col("llm_decision_date").alias("decision"))


def _signed_dates():
    """A client that reads the prompt as a model would: all signed dates of the text, in the shape that the prompt asks for."""

    def client(prompt):
        import datetime
        import json
        import re

        found = re.findall(r"signed (\w+ \d+, \d{4})", prompt)
        days = [datetime.datetime.strptime(f, "%B %d, %Y").date().isoformat() for f in found]
        return json.dumps({"dates": [{"date": d, "type": "decision", "source": "signed", "confidence": "high"} for d in days]})

    return client


@query(_RUN + """, pg AS (SELECT project_id, day, flag FROM pages_ WHERE document_id IN (SELECT document_id FROM own WHERE main_document = 'YES')), nd AS (SELECT project_id, count(*) AS n FROM own GROUP BY 1),
  k AS (SELECT project_id, count(DISTINCT day) AS dates, max(day) AS latest FROM pg GROUP BY 1)
  SELECT project_id, coalesce(dates, 0) AS n_dates, latest::VARCHAR AS decision, CASE WHEN n IS NULL THEN 'no_documents' WHEN dates IS NULL THEN 'no_pages' END AS error FROM chosen LEFT JOIN nd USING (project_id) LEFT JOIN k USING (project_id)""")
def x18_hybrid_run(c):
    # each date of the prompt is called a decision
    def client(prompt):
        import json
        import re

        days = re.findall(r"(?m)^\d+\. (\d{4}-\d{2}-\d{2}): ", prompt)
        return json.dumps({"classifications": [{"date": d, "type": "decision", "reason": "listed"} for d in days]})

    made = runs.model_timelines(_analysis(c), c.documents, c.pages, client, hybrid=True)
    return made.select("project_id", F.coalesce("llm_n_dates_found", F.lit(0)).cast("long").alias("n_dates"), F.col("llm_decision_date").alias("decision"), F.col("llm_error").alias("error"))


_MODEL_CAPACITY = """, d AS (SELECT project_id, document_id, row_number() OVER (PARTITION BY project_id ORDER BY CASE document_type WHEN 'FEIS' THEN 1 WHEN 'DEIS' THEN 2 WHEN 'FONSI' THEN 5 WHEN '' THEN 5 WHEN 'ROD' THEN 6 WHEN 'OTHER' THEN 8 ELSE 10 END,
  CASE main_document WHEN 'YES' THEN 0 WHEN 'NO' THEN 1 ELSE 3 END, document_id) AS i FROM documents_), pg AS (SELECT d.project_id, flag, qty, size, row_number() OVER (PARTITION BY d.project_id ORDER BY i, page_number) AS k FROM d JOIN pages_ USING (document_id) WHERE i <= 3),
  n AS (SELECT project_id, count(*) AS n, arg_min({'v': CASE flag WHEN 'A' THEN qty::INT ELSE size END, 'u': CASE flag WHEN 'A' THEN 'MW' WHEN 'N' THEN 'kW' ELSE 'MWh' END}, CASE flag WHEN 'R' THEN 1000 ELSE 0 END + k) AS best FROM pg WHERE k <= 15 GROUP BY 1)
SELECT p.project_id, best.v::DOUBLE AS capacity_value, best.u AS capacity_unit, CASE WHEN n > 0 THEN 'llm' ELSE 'no_documents' END AS extraction_method, coalesce(n, 0) AS n_candidates, coalesce(n, 0) AS pages_scanned FROM projects p LEFT JOIN n USING (project_id)"""


@query(_MODEL_CAPACITY)
def x18_model_capacity(c):
    def client(prompt):
        import json
        import re

        first = re.search(r"(?m)^1\. .*?(\d+) (MWh|MW|kW)", prompt)
        return json.dumps({"capacity_value": int(first[1]), "capacity_unit": first[2], "confidence": "high", "source_quote": first[0]})

    made = runs.model_capacities(c.projects, c.documents, c.pages, client)
    return made.select("project_id", "capacity_value", "capacity_unit", "extraction_method", "n_candidates", "pages_scanned")


@query(_PRIORITY + """, sums AS (SELECT project_id, min(date) AS a, max(date) AS b, max(date) FILTER (context = 'decision') AS d FROM merged GROUP BY 1), t AS (SELECT project_id, a, b, d, date_diff('day', a, b) AS days FROM projects LEFT JOIN sums USING (project_id))
  SELECT n, with_dates, with_year, with_duration, over_5_years, over_10_years, flagged, round(with_dates * 100.0 / n, 4) AS pct_with_dates, round(with_year * 100.0 / n, 4) AS pct_with_year, round(with_duration * 100.0 / n, 4) AS pct_with_duration,
  round(over_5_years * 100.0 / n, 4) AS pct_over_5_years, round(over_10_years * 100.0 / n, 4) AS pct_over_10_years, round(flagged * 100.0 / n, 4) AS pct_flagged FROM (
  SELECT count(*) AS n, count(a) AS with_dates, count(b) AS with_year, count(*) FILTER (days > 0) AS with_duration, count(*) FILTER (days > 1825) AS over_5_years, count(*) FILTER (days > 3650) AS over_10_years,
  count(*) FILTER (a IS NOT NULL AND (days > 3650 OR d IS NULL)) AS flagged FROM t)""")
def a18_t20_quality(c):
    return reports.timeline_quality(dates.timelines(c.projects, c.documents, _merged(c)))


@query("""SELECT 'day' AS "column", count(x = y) AS "both", count(*) FILTER (x = y) AS agree, round(count(*) FILTER (x = y) * 100.0 / count(x = y), 4) AS pct FROM (SELECT project_id, max(date) FILTER (context = 'decision') AS x, max(date) AS y FROM page_dates GROUP BY 1)""")
def t21_match_rates(c):
    return reports.match_rates(reports.compare(*_decision_and_latest(c), "project_id", ["day"]), ["day"])


@query("SELECT project_id, string_agg(page_text, '\n\n' ORDER BY document_id, page_number) AS text FROM pages_ GROUP BY 1")
def t18_concatenation(c):
    rows = c.pages.join(c.documents.select("document_id", "project_id"), "document_id").groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("document_id", "page_number", "page_text"))).alias("p"))
    return rows.select("project_id", F.array_join(F.transform("p", lambda x: x["page_text"]), "\n\n").alias("text"))


@query("""SELECT document_id, page_number FROM (SELECT d.project_id, document_id, page_number, row_number() OVER (PARTITION BY d.project_id ORDER BY document_id, page_number) AS i FROM (
  SELECT *, bool_or(coalesce(main_document = 'YES', false)) OVER (PARTITION BY project_id) AS m FROM documents_) d JOIN (SELECT document_id, page_number FROM pages_) USING (document_id) WHERE NOT m OR main_document = 'YES') WHERE i <= 10""")
def t22_first_pages(c):
    return dates.first_pages(c.documents, c.pages, 10).select("document_id", "page_number")


@query("""SELECT document_id, page_number FROM (SELECT d.project_id, document_id, page_number, row_number() OVER (PARTITION BY d.project_id ORDER BY document_id, page_number) AS i FROM (
  SELECT * FROM documents_ QUALIFY CASE category WHEN 'decision' THEN 1 WHEN 'final' THEN 2 WHEN 'draft' THEN 3 WHEN 'other' THEN 4 ELSE 5 END = min(CASE category WHEN 'decision' THEN 1 WHEN 'final' THEN 2 WHEN 'draft' THEN 3 WHEN 'other' THEN 4 ELSE 5 END) OVER (PARTITION BY project_id)) d
  JOIN (SELECT document_id, page_number FROM pages_) USING (document_id)) WHERE i <= 15""")
def t22_first_category(c):
    return dates.first_pages(dates.priority_documents(c.documents), c.pages, 15, main=False).select("document_id", "page_number")


# capacity


@query("""SELECT document_id, page_number, qty::INT || ' MW' AS match, value, unit, confidence FROM caps JOIN pages_ USING (document_id, page_number) WHERE pages_.flag = 'A'
  UNION ALL SELECT document_id, page_number, 'generate ' || qty::INT || ' MW', value, unit, confidence FROM caps JOIN pages_ USING (document_id, page_number) WHERE pages_.flag = 'A'
  UNION ALL SELECT document_id, page_number, size || ' kW', value, unit, confidence FROM caps JOIN pages_ USING (document_id, page_number) WHERE pages_.flag = 'N'
  UNION ALL SELECT document_id, page_number, 'rated ' || size || ' kW', value, unit, confidence FROM caps JOIN pages_ USING (document_id, page_number) WHERE pages_.flag = 'N'
  UNION ALL SELECT document_id, page_number, size || ' MW', value, unit, confidence FROM caps JOIN pages_ USING (document_id, page_number) WHERE pages_.flag = 'R'
  UNION ALL SELECT document_id, page_number, size || ' MWh battery', value, 'MWh', confidence FROM caps JOIN pages_ USING (document_id, page_number) WHERE pages_.flag = 'R'""")
def n7_capacity(c):
    return capacity.extract_capacity(c.pages, "page_text", ["document_id", "page_number"]).select("document_id", "page_number", "match", "value", "unit", "confidence")


@query("SELECT document_id, page_number, value, unit FROM caps")
def n8_primary(c):
    found = capacity.extract_capacity(c.pages, "page_text", ["document_id", "page_number"]).where("not is_energy")
    return capacity.primary(found, ["document_id", "page_number"], ["ordinal"]).select("document_id", "page_number", "value", "unit")


@query("""SELECT document_id, page_number, CASE flag WHEN 'A' THEN 'The proposed project will generate ' || qty::INT || ' MW.' WHEN 'N' THEN 'An existing nearby unit rated ' || size || ' kW.'
  ELSE 'Storage of ' || size || ' MWh battery.' END AS sentence, CASE flag WHEN 'R' THEN 5 ELSE 7 END::BIGINT AS score FROM pages_""")
def n12_sentences(c):
    return capacity.sentence_candidates(c.pages, "page_text", ["document_id", "page_number"])


@query("""SELECT project_id, document_id, page_number, page_rank, 1::BIGINT AS n_sentences FROM (SELECT project_id, document_id, page_number, row_number() OVER (PARTITION BY project_id ORDER BY d, page_number) AS page_rank FROM (
  SELECT project_id, document_id, row_number() OVER (PARTITION BY project_id ORDER BY CASE document_type WHEN 'FEIS' THEN 1 WHEN 'DEIS' THEN 2 WHEN 'FONSI' THEN 5 WHEN '' THEN 5 WHEN 'ROD' THEN 6 WHEN 'OTHER' THEN 8 ELSE 10 END,
  CASE main_document WHEN 'YES' THEN 0 WHEN 'NO' THEN 1 ELSE 3 END, document_id) AS d FROM documents_) JOIN (SELECT document_id, page_number FROM pages_) USING (document_id) WHERE d <= 3) WHERE page_rank <= 15""")
def n13_budget(c):
    rows = capacity.page_budget(c.documents, c.pages)
    return rows.select("project_id", "document_id", "page_number", "page_rank", F.size("sentences").cast("long").alias("n_sentences"))


# text windows and model stages


@query("""SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n FROM documents) WHERE n > 0""", base=False)
def x1_offsets(c):
    t = F.col("text")
    rows = c.table("documents").where(t.rlike("[0-9]")).select("doc_id", t.alias("t"), F.explode(match_offsets(t, "[0-9]+")).alias("h"))
    right = F.substring("t", F.col("h.start") + 1, F.col("h.end") - F.col("h.start")) == F.col("h.match")
    return rows.where(right).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


BANK = [("english", r"\bthe worthless\b|\bthe idiot\b"), ("license", "Licensed under|Apache License"), ("secret", "token = ")]


@query("""SELECT document_id, page_number, 'kw:signed' AS label, page_text AS snippet FROM pages_ WHERE flag = 'A'""")
def x3_snippets(c):
    s = snippets.snippets(c.pages, "page_text", ["document_id", "page_number"], [("signed", "(?i)signed")])
    return s.select("document_id", "page_number", F.concat(F.lit("kw:"), F.array_join("categories", ",")).alias("label"), "snippet")


@query("SELECT doc_id, len(regexp_extract_all(text, 'Licensed under|Apache License'))::BIGINT AS n_matches FROM documents WHERE regexp_matches(text, 'Licensed under|Apache License')", base=False)
def x3_x4_document_snippets(c):
    # each match lies in exactly one of the merged windows
    pattern = "Licensed under|Apache License"
    s = snippets.snippets(c.table("documents").select("doc_id", "text"), "text", ["doc_id"], [("license", pattern)])
    return s.groupBy("doc_id").agg(F.sum(F.regexp_count("snippet", F.lit(pattern))).alias("n_matches"))


@query("SELECT page_number, document_id, coalesce(document_type, '') AS document_type, page_text FROM pages_ JOIN documents_ USING (document_id) WHERE document_id = 'D1-1' AND page_number BETWEEN 1 AND 3")
def x8_document_pages(c):
    return snippets.document_pages(c.documents, c.pages, "D1-1", 1, 3).select("document_id", F.coalesce("document_type", F.lit("")).alias("document_type"), "page_number", "page_text")


@query("SELECT project_id, document_id, coalesce(main_document = 'YES', false) AS is_main, page_number, page_text FROM pages_ JOIN documents_ USING (project_id, document_id) WHERE project_id = 'P3'")
def x8_project_pages(c):
    return snippets.project_pages(c.documents, c.pages, "P3")


_BANK_VALUES = ", ".join(f"('{k}', {len(v)})" for k, v in fixed.SNIPPET_PATTERNS.items())


@query(", b(category, n_patterns) AS (VALUES " + _BANK_VALUES + """), m AS (SELECT CASE flag WHEN 'A' THEN 'section_headers' ELSE 'application_indicators' END AS category, count(*) AS n FROM pages_ WHERE flag IN ('A', 'N') GROUP BY 1)
  SELECT category, n_patterns::BIGINT AS n_patterns, coalesce(n, 0) AS n_pages FROM b LEFT JOIN m USING (category)""")
def x7_keyword_table(c):
    found = snippets.keyword_matches(c.pages, "page_text", ["document_id", "page_number"]).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    bank = snippets.keyword_table(c.spark).groupBy("category").agg(F.count(F.lit(1)).alias("n_patterns"))
    return bank.join(found, "category", "left").select("category", "n_patterns", F.coalesce("n", F.lit(0)).alias("n_pages"))


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


@query(f"""SELECT item_id, {_quoted(snippets.DOCUMENT_HEAD)} || text AS document, {_quoted(snippets.CLASSES_HEAD)} || '1. 2020-01-01: ' || text AS classes,
  {_quoted(snippets.CAPACITY_HEAD)} || 'Project: Item ' || item_id || chr(10) || 'Type: unknown' || chr(10) || '1. ' || text || chr(10) || '2. End' AS capacity FROM benchmark""", base=False)
def x11_x12_x13_prompts(c):
    text = F.col("text")
    asked = F.array(F.struct(F.lit("2020-01-01").alias("date"), text.alias("context")))
    title = F.concat(F.lit("Item "), F.col("item_id").cast("string"))
    made = [snippets.document_prompt(text), snippets.date_prompt(asked), snippets.capacity_prompt(F.array(text, F.lit("End")), title, F.lit(None).cast("string"))]
    return c.table("benchmark").select("item_id", made[0].alias("document"), made[1].alias("classes"), made[2].alias("capacity"))


@query("SELECT doc_id, regexp_matches(text, 'Licensed under|Apache License') AS found, length(text)::BIGINT AS n_chars FROM documents", base=False)
def x5_preprocess(c):
    made = snippets.reduce_texts(c.table("documents").select("doc_id", "text"), "text", ["doc_id"], [("license", "Licensed under|Apache License")])
    # a text without a match is kept up to the cap
    whole = c.table("documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))
    return made.join(whole, "doc_id").select("doc_id", (F.col("n_snippets") > 0).alias("found"), "n_chars")


@query("""SELECT doc_id, CASE WHEN p > 201 THEN '...' ELSE '' END || substr(text, greatest(p - 200, 1), least(p - 1 + 14 + 200, length(text)) - greatest(p - 201, 0)) || CASE WHEN p - 1 + 14 + 200 < length(text) THEN '...' ELSE '' END AS context
  FROM (SELECT doc_id, text, position('licensed under' IN lower(text)) AS p FROM documents) WHERE p > 0""", base=False)
def x9_kwic(c):
    return snippets.in_context(c.table("documents"), "text", ["doc_id"], "licensed under")


@query("""SELECT document_id, page_number, page_text AS context FROM pages_ WHERE lower(page_text) LIKE '%unit rated 1%'""")
def x9_indexed_search(c):
    index = search.trigram_index(c.pages, ["document_id", "page_number"], "page_text")
    return search.search(c.pages, "page_text", ["document_id", "page_number"], "Unit rated 1", index=index)


@query("SELECT project_id, document_id, page_number, NULL::VARCHAR AS context FROM pages_ WHERE project_id IN ('P1', 'P2', 'P3', 'P7') AND regexp_matches(page_text, '(?i)signed [a-z]+ 1\\d')")
def x9_pattern_in_project(c):
    own = c.documents.where(F.col("project_id").isin("P1", "P2", "P3", "P7")).select("project_id", "document_id")
    return search.search(c.pages.join(own, "document_id"), "page_text", ["project_id", "document_id", "page_number"], r"Signed [a-z]+ 1\d")


@query("""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), n AS (SELECT term, lang, count(*) AS n FROM w GROUP BY 1, 2), t AS (SELECT term, sum(n)::BIGINT AS total FROM n GROUP BY 1 HAVING sum(n) >= 5)
  SELECT term, lang, n, total FROM n JOIN t USING (term)""", base=False)
def x10_terms(c):
    return snippets.term_counts(c.table("documents"), "text", "lang")


@query("SELECT item_id, CASE WHEN text IS NOT NULL THEN 'echo ' || text END AS reply, NULL::VARCHAR AS error FROM benchmark", base=False)
def x14_model_stage(c):
    return ask_model(c.table("benchmark").select("item_id", F.col("text").alias("prompt")), "item_id", "prompt", lambda p: f"echo {p}")



@query(f""", pl(name, lat, lon) AS (VALUES {_PLACES_SQL}), lists AS (SELECT array_to_string(project_state, ';') AS list_id, any_value(project_state) AS states, count(*) AS n FROM projects WHERE len(project_state) > 1 GROUP BY 1)
  SELECT list_id, string_agg(name, ';' ORDER BY lat, name) AS ordered, max(n) AS n FROM (SELECT list_id, n, unnest(states) AS name FROM lists) JOIN pl USING (name) GROUP BY 1""")
def a14_a15_places_in_order(c):
    lists = c.tagged.where(F.size("project_state") > 1).groupBy(joined("project_state").alias("list_id")).agg(F.first("project_state").alias("states"), F.count(F.lit(1)).alias("n"))
    rows = reports.places_by_latitude(lists, c.spark.createDataFrame(_PLACES, "name string, lat double, lon double"))
    return rows.select("list_id", joined("ordered").alias("ordered"), "n")


@query("""SELECT 'rows' AS measure, NULL::VARCHAR AS value, count(*) AS n, 100.0::DOUBLE AS pct FROM tagged UNION ALL SELECT 'project_type', NULL, count(project_type), round(count(project_type) * 100.0 / count(*), 4) FROM tagged
  UNION ALL SELECT 'project_utilities_to_exclude', NULL, count(*) FILTER (project_utilities_to_exclude), round(count(*) FILTER (project_utilities_to_exclude) * 100.0 / count(*), 4) FROM tagged
  UNION ALL SELECT 'energy', energy, count(*), round(count(*) * 100.0 / (SELECT count(*) FROM tagged), 4) FROM tagged GROUP BY 2""")
def k7_summary(c):
    return ingest.summary(c.tagged, ["project_type", "project_utilities_to_exclude"], ["energy"])


_EDGES = f""", pl(name, lat, lon) AS (VALUES {_PLACES_SQL}), lists AS (SELECT array_to_string(project_state, ';') AS list_id, any_value(project_state) AS states, count(*) AS n FROM projects WHERE len(project_state) > 1 GROUP BY 1),
  r AS (SELECT list_id, n, name, lead(name) OVER (PARTITION BY list_id ORDER BY lat, name) AS t FROM (SELECT list_id, n, unnest(states) AS name FROM lists) JOIN pl USING (name)),
  e AS (SELECT name AS f, t, sum(n)::BIGINT AS n FROM r WHERE t IS NOT NULL GROUP BY 1, 2)
"""


@query(_EDGES + """, q AS (SELECT quantile_cont(n, [0.4, 0.7, 0.9]) AS q FROM e), least AS (SELECT min(n) AS n FROM (SELECT n FROM e ORDER BY n DESC LIMIT 10))
  SELECT f AS "from", t AS "to", e.n, CASE WHEN e.n >= q[3] THEN 'top' WHEN e.n >= q[2] THEN 'high' WHEN e.n >= q[1] THEN 'medium' ELSE 'low' END AS tier, e.n >= least.n AS labelled, ((a.lon + b.lon) / 2)::DOUBLE AS lon_mid
  FROM e, q, least, pl a, pl b WHERE a.name = f AND b.name = t""")
def g9_link_tiers(c):
    lists = c.tagged.where(F.size("project_state") > 1).groupBy(joined("project_state").alias("list_id")).agg(F.first("project_state").alias("states"), F.count(F.lit(1)).alias("n"))
    edges = reports.link_edges(lists, c.spark.createDataFrame(_PLACES, "name string, lat double, lon double"))
    labelled = reports.top_with_ties(edges, "n", 10).select("from", "to", F.lit(True).alias("labelled"))
    rows = reports.quantile_tiers(edges, "n").join(labelled, ["from", "to"], "left")
    return rows.select("from", "to", "n", "tier", F.coalesce("labelled", F.lit(False)).alias("labelled"), "lon_mid")


@query("SELECT project_id, o_totalprice FROM projects ORDER BY o_totalprice DESC, project_id LIMIT 25")
def l1_head(c):
    return c.projects.select("project_id", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "project_id").limit(25)


@query("SELECT project_title AS \"Title\", process_type AS \"Process\", project_id AS \"Id\" FROM projects WHERE dataset_source = 'EIS'")
def p8_presentation(c):
    rows = c.projects.where("dataset_source = 'EIS'").select("project_title", "process_type", "project_id")
    return rows.withColumnsRenamed({"project_title": "Title", "process_type": "Process", "project_id": "Id"})


@query("SELECT project_id, dataset_source FROM projects", base=True)
def p9_present_columns(c):
    return ingest.present(c.projects, ["project_id", "absent", "dataset_source"])
