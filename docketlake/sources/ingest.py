"""Reading and writing the review corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import places, tags
from ..functions.matches import strip
from . import staging

_V = "struct<value:string>"
_L = "struct<value:array<string>>"
RECORD = (
    f"project struct<project_ID:{_V},project_title:{_V},project_sector:{_L},project_type:{_L},project_description:{_V},project_sponsor:{_V},location:{_L}>, "
    f"process struct<process_family:{_V},process_type:{_V},lead_agency:{_L}>, "
    f"documents array<struct<metadata:struct<document_metadata:struct<document_ID:{_V},document_type:{_V},document_title:{_V},prepared_by:{_V},ce_category:{_V}>,"
    f"file_metadata:struct<file_ID:{_V},file_name:{_V},total_pages:{_V},main_document:{_V}>>,pages:array<struct<`page number`:long,`page text`:string>>>>"
)


BROKEN = "_broken"  # the text of a line that is no record


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON lines, one record per project, by a declared schema (no inference pass); ``_broken`` has the text of lines that are no JSON of that shape."""
    return spark.read.schema(f"{RECORD}, {BROKEN} string").option("columnNameOfCorruptRecord", BROKEN).json(path)


def read_corpus(spark: SparkSession, root: str, sources: list[str] | None = None) -> DataFrame:
    """All records under ``root``/SOURCE/*/*.jsonl with their ``dataset_source`` (CE, EA and EIS, those that exist)."""
    found = None
    for source in sources or ["EA", "EIS", "CE"]:
        if not exists(spark, f"{root}/{source}"):
            continue
        rows = read_records(spark, f"{root}/{source}/*/*.jsonl").withColumn("dataset_source", F.lit(source))
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], f"{RECORD}, {BROKEN} string, dataset_source string") if found is None else found


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A report table; a missing file gives an empty one of the schema."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema or "key string")
    return spark.read.schema(schema).csv(path, header=True) if schema else spark.read.csv(path, header=True, inferSchema=True)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _text(path: str):
    return F.coalesce(F.col(path), F.lit(""))


def projects(records: DataFrame) -> DataFrame:
    p = "project."
    return records.select(
        F.col(p + "project_ID.value").alias("project_id"), _text(p + "project_title.value").alias("project_title"), F.col(p + "project_sector.value").alias("project_sector"),
        F.col(p + "project_type.value").alias("project_type"), _text(p + "project_description.value").alias("project_description"),
        _text(p + "project_sponsor.value").alias("project_sponsor"), F.col(p + "location.value").alias("project_location"),
    )


def processes(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("project.project_ID.value").alias("project_id"), _text("process.process_family.value").alias("process_family"),
        _text("process.process_type.value").alias("process_type"), F.col("process.lead_agency.value").alias("lead_agency"),
    )


def documents(records: DataFrame) -> DataFrame:
    rows = records.select(F.col("project.project_ID.value").alias("project_id"), F.explode("documents").alias("d"))
    m, f = "d.metadata.document_metadata.", "d.metadata.file_metadata."
    return rows.select(
        "project_id", _text(m + "document_ID.value").alias("document_id"), _text(m + "document_type.value").alias("document_type"),
        _text(m + "document_title.value").alias("document_title"), _text(m + "prepared_by.value").alias("prepared_by"), _text(m + "ce_category.value").alias("ce_category"),
        _text(f + "file_ID.value").alias("file_id"), _text(f + "file_name.value").alias("file_name"), _text(f + "total_pages.value").alias("total_pages"),
        _text(f + "main_document.value").alias("main_document"), content_digest(F.col("d.pages")).alias("content_digest"),
    )


def content_digest(pages: Column) -> Column:
    """Digest of a document's pages, so that a change is seen without reading them again."""
    told = F.transform(pages, lambda p: F.concat_ws(":", p["page number"].cast("string"), F.sha2(F.coalesce(p["page text"], F.lit("")).cast("binary"), 256)))
    return F.sha2(F.array_join(F.coalesce(told, F.array().cast("array<string>")), ",").cast("binary"), 256)


def pages(records: DataFrame) -> DataFrame:
    rows = records.select(F.explode("documents").alias("d")).select(_text("d.metadata.document_metadata.document_ID.value").alias("document_id"), F.explode("d.pages").alias("p"))
    return rows.select("document_id", F.col("p.`page number`").alias("page_number"), F.coalesce(F.col("p.`page text`"), F.lit("")).alias("page_text"))


TABLES = {"projects": projects, "processes": processes, "documents": documents, "pages": pages}


def write_tables(records: DataFrame, path: str, source: str) -> None:
    """The four tables of one source, partitioned by it so that a source filter prunes files, and the lines that could not be read (``broken``).

    Records are parsed once, into a table that all others are made of. The tables are written beside the present ones; they take
    their places when all are there, after a mark is set. A run that fails before the mark changes nothing; one that fails after
    it is finished by ``recover``, which every run calls first. Pages are ordered by document in ranges, so that a file, and a row
    group of it, holds few documents.
    """
    spark = records.sparkSession
    recover(spark, path, source)
    if BROKEN not in records.columns:
        records = records.withColumn(BROKEN, F.lit(None).cast("string"))
    parsed = staging.staged(records, "records")
    good = parsed.where(F.col(BROKEN).isNull())
    for name, make in TABLES.items():
        rows = make(good)
        if name == "pages":
            rows = clustered(rows)
        rows.write.mode("overwrite").options(**PAGE_FILES).parquet(_beside(path, source, name))
    parsed.where(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("line")).write.mode("overwrite").parquet(_beside(path, source, "broken"))
    spark.range(1).write.mode("overwrite").parquet(_beside(path, source, "READY"))
    recover(spark, path, source)


PAGE_FILES = {"parquet.bloom.filter.enabled#document_id": "true", "parquet.block.size": str(32 << 20)}


def clustered(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Pages in ranges of document_id, sorted: the least and greatest id of files and row groups, and their Bloom filters, rule out nearly all others in a lookup."""
    order = ["document_id", "page_number"]
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def _beside(path: str, source: str, name: str) -> str:
    return f"{path}/_new/{source.upper()}/{name}"


def recover(spark: SparkSession, path: str, source: str) -> None:
    """Puts tables that are complete (marked) in place; what is not marked stays out of sight, to be replaced by the next run."""
    if not exists(spark, _beside(path, source, "READY")):
        return
    for name in [*TABLES, "broken"]:
        if exists(spark, _beside(path, source, name)):
            replace_folder(spark, _beside(path, source, name), f"{path}/{name}/dataset_source={source.upper()}")
    remove_folder(spark, f"{path}/_new/{source.upper()}")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def replace_folder(spark: SparkSession, new: str, old: str) -> None:
    files, target = _file_system(spark, old)
    files.mkdirs(target.getParent())
    files.delete(target, True)
    if not files.rename(_file_system(spark, new)[1], target):
        raise OSError(f"{new} cannot take the place of {old}")


def remove_folder(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


def combined(spark: SparkSession, path: str, military: DataFrame | None = None, waste_terms: list[str] | None = None) -> dict[str, DataFrame]:
    """The analysis tables of all sources written by ``write_tables``: projects, processes, documents.

    Projects carry process, energy, place, department and document-category columns; rules that
    exclude projects are applied in their order.
    """
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    docs = read("documents").withColumn("document_type_category", tags.document_category(F.col("document_type"), F.col("file_name")))
    kinds = ["decision", "final", "draft", "appendix"]
    flags = docs.groupBy("project_id").agg(
        *[F.bool_or(F.col("document_type_category") == k).alias(f"project_has_{k}") for k in kinds], F.count("document_id").alias("project_document_count")
    )
    steps = read("processes")
    rows = read("projects").join(steps.select("project_id", F.col("process_type").alias("_process"), "lead_agency"), "project_id", "left")
    rows = rows.withColumn("process_type", tags.process_type(F.col("_process"), F.col("dataset_source"))).drop("_process")
    rows = rows.withColumns(tags.energy_columns(F.col("project_type")))
    agency = F.array_join("lead_agency", " ")
    rows = rows.withColumn("project_nuclear_waste_to_exclude", tags.nuclear_waste(F.col("project_type"), F.col("project_sponsor"), agency, F.col("project_title"), waste_terms))
    rows = tags.excluded(rows, military)
    rows = rows.withColumns(places.location_columns(places.joined_list(F.col("project_location"))))
    rows = rows.withColumn("project_department", tags.department(F.get("lead_agency", F.lit(0))))
    several = {"multi_state": "project_state", "multi_county": "project_county", "multi_department": "lead_agency"}
    rows = rows.withColumns({f"project_{k}": tags.multiple(F.col(c)) for k, c in several.items()}).join(flags, "project_id", "left")
    none = {f"project_has_{k}": F.coalesce(f"project_has_{k}", F.lit(False)) for k in kinds}
    rows = rows.withColumns(none | {"project_document_count": F.coalesce("project_document_count", F.lit(0))})
    return {"projects_combined": rows, "processes_combined": steps, "documents_combined": docs}


def write_table(df: DataFrame, path: str) -> None:
    """An analysis table; a rerun replaces it."""
    df.write.mode("overwrite").parquet(path)


def summary(df: DataFrame, flags: list[str], counts: list[str]) -> DataFrame:
    """(measure, value, n, pct): rows, how many have each flag or column, and the values of each counted column. One scan: every row gives its measures."""
    kinds = dict(df.dtypes)
    one = lambda name, value: F.struct(F.lit(name).alias("measure"), value.cast("string").alias("value"))
    nothing = F.lit(None).cast("string")
    has = [F.when(F.coalesce(F.col(f), F.lit(False)) if kinds[f] == "boolean" else F.col(f).isNotNull(), one(f, nothing)) for f in flags]
    told = F.array_compact(F.array(one("rows", nothing), *has, *[one(c, F.col(c)) for c in counts]))
    sums = df.select(F.explode(told).alias("m")).groupBy("m.measure", "m.value").agg(F.count(F.lit(1)).alias("n"))
    # a flag that no row has is listed too
    listed = df.sparkSession.createDataFrame([(f,) for f in ["rows", *flags]], "measure string")
    rows = sums.join(F.broadcast(listed.select("measure", F.lit(True).alias("listed"))), "measure", "full")  # as many rows as flags
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("_all", F.max(F.when(F.col("measure") == "rows", F.col("n"))).over(Window.partitionBy()))  # as many rows as values
    return rows.select("measure", "value", "n", F.round(F.try_divide(F.col("n") * 100, "_all"), 4).alias("pct"))


def present(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the named columns that the table has, in the given order."""
    return df.select(*[c for c in names if c in df.columns])


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Lower-case terms of a text file; blank lines and comments are skipped."""
    line = F.lower(strip(F.col("value")))
    return spark.read.text(path).select(line.alias("term")).where("term <> '' and not startswith(term, '#')")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct project ids of a CSV; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "project_id string")
    return spark.read.csv(path, header=True).select(F.col("project_id").cast("string")).dropna().distinct()


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """A lookup of places (name, lat, lon) from a CSV with a header; each name once, those without coordinates left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], "name string, lat double, lon double")
    rows = spark.read.schema("name string, lat double, lon double").csv(path, header=True).dropna()
    return rows.groupBy("name").agg(F.min(F.struct("lat", "lon")).alias("p")).select("name", "p.lat", "p.lon")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def plain_id(column: str):
    """Ids stored plain or as {"value": id}."""
    c = F.col(column)
    return F.coalesce(F.get_json_object(c, "$.value"), c)


def export_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as compact JSON text; other columns as they are."""
    deep = lambda t: t.startswith(("array", "map", "struct"))
    return df.select(*[F.to_json(c).alias(c) if deep(t) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A report table as one CSV file with a header, in the given order; what makes its rows stays parallel."""
    one = df.repartition(1)
    (one.sortWithinPartitions(*order) if order else one).write.mode("overwrite").csv(path, header=True)
