"""A review corpus made from star-schema tables, in DataFrames and in SQL from the same rules."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, places, tags
from ..sources import ingest

# tag of each part type
TYPE_TAGS = {
    "ECONOMY": "Utilities (electricity, gas, telecommunications)",
    "STANDARD": "Broadband",
    "PROMO": "Renewable Energy Production - Solar",
    "SMALL": "Nuclear Technology",
    "MEDIUM": "Conventional Energy Production - Land-based Oil & Gas",
    "LARGE": "Waste Management",
}
SEGMENT_AGENCIES = {
    "BUILDING": "Department of Energy - Office of Electricity",
    "AUTOMOBILE": "Department of Transportation",
    "MACHINERY": "Department of the Interior - BLM",
    "HOUSEHOLD": "Legislative Branch",
    "FURNITURE": "Unlisted Office",
}
SECOND_AGENCY = "Office of Environmental Management"
STATE_NAMES = [n.title() for n in list(fixed.STATES)[:25]]
STATE_CODES = list(fixed.STATES.values())[:25]
DOC_TYPES = {1: "ROD", 2: "FONSI", 3: "FEIS", 4: "DEIS", 5: "OTHER", 6: ""}


def _map(values: dict, key):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


class Corpus:
    """The derived tables of one folder; every table is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def projects(self) -> DataFrame:
        lines, part = self.table("lineitem"), self.table("part")
        of = lines.join(part, lines.l_partkey == part.p_partkey).groupBy("l_orderkey").agg(
            F.array_sort(F.collect_set(_map(TYPE_TAGS, F.col("p_type")))).alias("project_type"),
            F.min(F.struct("p_partkey", "p_name")).alias("_first"), F.min("l_suppkey").alias("_supplier"),
        )
        supplier = self.table("supplier").select(F.col("s_suppkey").alias("_supplier"), F.col("s_nationkey").alias("_n2"))
        rows = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(of, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(supplier, "_supplier", "left")
        k, name, code = F.col("o_orderkey"), tags.words(STATE_NAMES), tags.words(STATE_CODES)
        n1, n2 = F.col("c_nationkey"), F.col("_n2")
        county = F.initcap(F.col("_first.p_name"))
        even = F.concat(
            F.coalesce(F.concat(county, F.lit(" County, ")), F.lit("Unnamed place, ")), F.get(code, n1), F.lit(" (Lat/Lon: "), (30 + k % 19).cast("string"),
            F.lit(".5, -"), (70 + k % 50).cast("string"), F.lit(".25)"),
        )
        odd = F.concat(F.get(name, n1), F.when(n2 != n1, F.concat(F.lit(", "), F.get(name, n2))).otherwise(""))
        source = _map({"F": "CE", "O": "EA", "P": "EIS"}, F.col("o_orderstatus"))
        process = _map({"F": "Categorical Exclusion", "O": "Environmental Assessment (EA)", "P": "Unlisted process"}, F.col("o_orderstatus"))
        agency = _map(SEGMENT_AGENCIES, F.col("c_mktsegment"))
        agencies = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(agency, F.lit(SECOND_AGENCY))).otherwise(F.array(agency))
        title = F.when(k % 10 == 0, F.concat(F.lit("A "), (k % 900 + 1).cast("string"), F.lit("-MW solar facility"))).otherwise(F.concat(F.lit("Order "), k.cast("string")))
        return rows.select(
            F.concat(F.lit("P"), k.cast("string")).alias("project_id"), k.alias("k"), source.alias("dataset_source"), title.alias("project_title"), "project_type",
            tags.process_type(process, source).alias("process_type"), agencies.alias("lead_agency"), F.col("c_name").alias("project_sponsor"),
            F.when(k % 2 == 0, even).otherwise(odd).alias("project_location"), F.to_date("o_orderdate").alias("order_date"), "o_totalprice",
        )

    @cached_property
    def documents(self) -> DataFrame:
        lines = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("total_pages"))
        n = F.col("l_linenumber")
        key = F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string"))
        name = F.when(n == 6, F.concat(F.lit("Draft_EA_"), key)).when(n == 7, F.concat(F.lit("Appendix_"), key)).otherwise(F.concat(F.lit("File_"), key))
        kind = _map(DOC_TYPES, n)
        file = F.concat(name, F.lit(".pdf"))
        return lines.select(
            F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("project_id"), F.concat(F.lit("D"), key).alias("document_id"), kind.alias("document_type"),
            file.alias("file_name"), F.when(n <= 3, "YES").when(n < 7, "NO").alias("main_document"), "total_pages", tags.document_category(kind, file).alias("category"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
        rows = self.table("lineitem").withColumn("page_number", F.row_number().over(order).cast("long")).join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        size, day = F.col("p_size").cast("string"), F.col("l_shipdate")
        text = (
            F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Decision Record signed "), F.date_format(day, "MMMM d, yyyy"), F.lit(". The proposed project will generate "), F.col("l_quantity").cast("int").cast("string"), F.lit(" MW.")))
            .when(F.col("l_returnflag") == "N", F.concat(F.lit("Application received "), F.date_format(day, "MM/dd/yyyy"), F.lit(". An existing nearby unit rated "), size, F.lit(" kW.")))
            .otherwise(F.concat(F.lit("Notice of Intent published "), F.date_format(day, "yyyy-MM-dd"), F.lit(". Storage of "), size, F.lit(" MWh battery. National Policy Act of 1969.")))
        )
        key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        return rows.select(F.concat(F.lit("D"), key).alias("document_id"), "page_number", text.alias("page_text"))

    @cached_property
    def tagged(self) -> DataFrame:
        """Projects with energy, agency and place columns, and the exclusion rules applied."""
        df = self.projects.withColumns(tags.energy_columns(F.col("project_type")))
        agency = F.array_join("lead_agency", " ")
        df = df.withColumn("project_nuclear_waste_to_exclude", tags.nuclear_waste(F.col("project_type"), F.col("project_sponsor"), agency, F.col("project_title")))
        df = df.withColumn("project_department", tags.department(F.get("lead_agency", F.lit(0)))).withColumns(places.location_columns(F.col("project_location")))
        ruled = tags.excluded(df.withColumn("_kind", F.col("project_energy_type")).withColumn("_strict", F.col("project_energy_type_strict")))
        names = {"energy": F.col("project_energy_type"), "energy_strict": F.col("project_energy_type_strict"), "project_energy_type": F.col("_kind"), "project_energy_type_strict": F.col("_strict")}
        return ruled.withColumns(names).drop("_kind", "_strict")

    @cached_property
    def records(self) -> DataFrame:
        """The corpus as nested records, through JSON text and the declared schema."""
        v = lambda c: F.struct(c.cast("string").alias("value"))
        pages = self.pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_number").alias("page number"), F.col("page_text").alias("page text")))).alias("pages"))
        docs = self.documents.join(pages, "document_id", "left")
        about = F.struct(v(F.col("document_id")).alias("document_ID"), v(F.col("document_type")).alias("document_type"))
        file = F.struct(v(F.col("file_name")).alias("file_name"), v(F.col("total_pages")).alias("total_pages"), v(F.col("main_document")).alias("main_document"))
        one = F.struct(F.struct(about.alias("document_metadata"), file.alias("file_metadata")).alias("metadata"), F.coalesce("pages", F.array().cast("array<struct<`page number`:bigint,`page text`:string>>")).alias("pages"))
        docs = docs.groupBy("project_id").agg(F.collect_list(one).alias("documents"))
        project = F.struct(
            v(F.col("project_id")).alias("project_ID"), v(F.col("project_title")).alias("project_title"), v(F.col("project_sponsor")).alias("project_sponsor"),
            F.struct(F.col("project_type").alias("value")).alias("project_type"), F.struct(F.array("project_location").alias("value")).alias("location"),
        )
        process = F.struct(v(F.col("process_type")).alias("process_type"), F.struct(F.col("lead_agency").alias("value")).alias("lead_agency"))
        rows = self.projects.join(docs, "project_id", "left").select(F.to_json(F.struct(project.alias("project"), process.alias("process"), "documents")).alias("line"))
        return rows.select(F.from_json("line", ingest.RECORD).alias("r")).select("r.*")

    @cached_property
    def page_dates(self) -> DataFrame:
        from ..operators.dates import extract_dates

        return extract_dates(self.pages, "page_text", ["document_id", "page_number"])


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_map(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in values.items()) + " END"


_S = "list_transform(coalesce(project_type, []), lambda x: lower(trim(x)))"
_U, _B = f"list_contains(s, '{fixed.UTILITIES}')", "list_contains(s, 'broadband')"

SQL_BASE = f"""
WITH of AS (
  SELECT l_orderkey, list_sort(list(DISTINCT {_sql_map('p_type', TYPE_TAGS)})) AS project_type, arg_min(p_name, p_partkey) AS p_name, min(l_suppkey) AS sup
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
), projects AS (
  SELECT 'P' || o_orderkey AS project_id, o_orderkey AS k, {_sql_map('o_orderstatus', {'F': 'CE', 'O': 'EA', 'P': 'EIS'})} AS dataset_source,
    CASE WHEN o_orderkey % 10 = 0 THEN 'A ' || (o_orderkey % 900 + 1) || '-MW solar facility' ELSE 'Order ' || o_orderkey END AS project_title, project_type,
    {_sql_map('o_orderstatus', {'F': 'CE', 'O': 'EA', 'P': 'EIS'})} AS process_type,
    CASE WHEN o_orderpriority = '1-URGENT' THEN [{_sql_map('c_mktsegment', SEGMENT_AGENCIES)}, '{SECOND_AGENCY}'] ELSE [{_sql_map('c_mktsegment', SEGMENT_AGENCIES)}] END AS lead_agency,
    c_name AS project_sponsor,
    CASE WHEN o_orderkey % 2 = 0 THEN coalesce(upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) || ' County, ', 'Unnamed place, ')
      || {_sql_list(STATE_CODES)}[c_nationkey + 1] || ' (Lat/Lon: ' || (30 + o_orderkey % 19) || '.5, -' || (70 + o_orderkey % 50) || '.25)'
    ELSE {_sql_list(STATE_NAMES)}[c_nationkey + 1] || CASE WHEN s_nationkey <> c_nationkey THEN ', ' || {_sql_list(STATE_NAMES)}[s_nationkey + 1] ELSE '' END END AS project_location,
    o_orderdate::DATE AS order_date, o_totalprice,
    CASE WHEN o_orderkey % 2 = 0 THEN [{_sql_list(STATE_NAMES)}[c_nationkey + 1]] WHEN s_nationkey IS NULL OR s_nationkey = c_nationkey THEN [{_sql_list(STATE_NAMES)}[c_nationkey + 1]]
      ELSE list_sort([{_sql_list(STATE_NAMES)}[c_nationkey + 1], {_sql_list(STATE_NAMES)}[s_nationkey + 1]]) END AS project_state,
    CASE WHEN o_orderkey % 2 = 0 AND p_name IS NOT NULL THEN [upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2)] ELSE [] END AS project_county
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN of ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = sup
), documents_ AS (
  SELECT 'P' || l_orderkey AS project_id, 'D' || l_orderkey || '-' || l_linenumber AS document_id, {_sql_map('l_linenumber', DOC_TYPES)} AS document_type,
    CASE l_linenumber WHEN 6 THEN 'Draft_EA_' WHEN 7 THEN 'Appendix_' ELSE 'File_' END || l_orderkey || '-' || l_linenumber || '.pdf' AS file_name,
    CASE WHEN l_linenumber <= 3 THEN 'YES' WHEN l_linenumber < 7 THEN 'NO' END AS main_document, count(*) AS total_pages,
    CASE l_linenumber WHEN 1 THEN 'decision' WHEN 2 THEN 'decision' WHEN 3 THEN 'final' WHEN 4 THEN 'draft' WHEN 6 THEN 'draft' WHEN 7 THEN 'appendix' ELSE 'other' END AS category
  FROM lineitem GROUP BY l_orderkey, l_linenumber
), pages_ AS (
  SELECT 'D' || l_orderkey || '-' || l_linenumber AS document_id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS page_number,
    CASE l_returnflag WHEN 'A' THEN 'Decision Record signed ' || strftime(l_shipdate, '%B %-d, %Y') || '. The proposed project will generate ' || l_quantity::INT || ' MW.'
      WHEN 'N' THEN 'Application received ' || strftime(l_shipdate, '%m/%d/%Y') || '. An existing nearby unit rated ' || p_size || ' kW.'
      ELSE 'Notice of Intent published ' || strftime(l_shipdate, '%Y-%m-%d') || '. Storage of ' || p_size || ' MWh battery. National Policy Act of 1969.' END AS page_text,
    l_returnflag AS flag, l_shipdate::DATE AS day, l_quantity AS qty, p_size AS size, 'P' || l_orderkey AS project_id
  FROM lineitem JOIN part ON l_partkey = p_partkey
), sets AS (SELECT *, {_S} AS s FROM projects
), kinds AS (
  SELECT *, CASE WHEN list_has_any(s, {_sql_list(fixed.FOSSIL)}) THEN 'Fossil' WHEN list_has_any(s, {_sql_list(fixed.CLEAN)}) THEN 'Clean' ELSE 'Other' END AS project_energy_type,
    {_U} AND {_B} AND len(s) = 2 AS project_is_utilities_broadband_only,
    list_contains(s, '{fixed.NUCLEAR_TECH}') AND NOT list_contains(s, '{fixed.NUCLEAR_POWER}') AS project_is_nuclear_tech_only,
    {_U} AND list_has_any(s, {_sql_list(fixed.NON_ENERGY)}) AND len(list_filter(s, lambda x: NOT list_contains({_sql_list([fixed.UTILITIES, *fixed.NON_ENERGY])}, x))) = 0 AS project_utilities_to_exclude,
    list_contains(s, 'waste management') AND list_contains(s, 'nuclear technology') AND len(lead_agency) > 1 AS project_nuclear_waste_to_exclude
  FROM sets
), tagged AS (
  SELECT *, project_is_utilities_broadband_only OR (list_has_any(s, {_sql_list(fixed.FOSSIL)}) AND list_has_any(s, {_sql_list(fixed.CLEAN)})) AS project_energy_type_questions,
    CASE WHEN project_is_utilities_broadband_only OR project_is_nuclear_tech_only THEN 'Other' ELSE project_energy_type END AS project_energy_type_strict,
    CASE WHEN project_energy_type = 'Clean' AND (project_utilities_to_exclude OR project_nuclear_waste_to_exclude) THEN 'Other' ELSE project_energy_type END AS energy,
    CASE WHEN project_is_utilities_broadband_only OR project_is_nuclear_tech_only OR (project_energy_type = 'Clean' AND (project_utilities_to_exclude OR project_nuclear_waste_to_exclude)) THEN 'Other' ELSE project_energy_type END AS energy_strict,
    len(s) AS project_type_count, len(list_intersect(s, {_sql_list(fixed.CLEAN)})) AS project_type_count_clean, len(list_intersect(s, {_sql_list(fixed.FOSSIL)})) AS project_type_count_fossil,
    CASE lead_agency[1] WHEN 'Department of Energy - Office of Electricity' THEN 'Department of Energy' WHEN 'Department of the Interior - BLM' THEN 'Department of the Interior'
      WHEN 'Unlisted Office' THEN 'Other / Unclassified' ELSE lead_agency[1] END AS project_department
  FROM kinds
), page_dates AS (
  SELECT document_id, page_number, project_id, day AS date, CASE flag WHEN 'A' THEN 'decision' ELSE 'submission' END AS context FROM pages_ WHERE flag <> 'R'
), caps AS (
  SELECT document_id, page_number, project_id, CASE flag WHEN 'A' THEN qty::INT::DOUBLE ELSE size::DOUBLE END AS value, CASE flag WHEN 'N' THEN 'kW' ELSE 'MW' END AS unit,
    CASE flag WHEN 'A' THEN 'high' ELSE 'medium' END AS confidence, flag FROM pages_
)
"""
