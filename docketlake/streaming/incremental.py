"""Incremental ingest of record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ingest as tables
from ..sources import staging


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, name: str) -> None:
    """Read the record files of a source that are new since the last call, write the four tables, and stop.

    Every micro-batch has a partition of its own, which it replaces when it is run again after a
    failure, so no record is stored twice. Its records are parsed once; lines that are no records go to the table ``broken``.
    """

    def write(records: DataFrame, batch: int) -> None:
        parsed = staging.staged(records, "records")
        good = parsed.where(F.col(tables.BROKEN).isNull())
        broken = parsed.where(F.col(tables.BROKEN).isNotNull()).select(F.col(tables.BROKEN).alias("line"))
        for table, made in [*((n, make(good)) for n, make in tables.TABLES.items()), ("broken", broken)]:
            rows = made.withColumns({"dataset_source": F.lit(name.upper()), "batch": F.lit(batch)})
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_source", "batch").parquet(f"{target}/{table}")

    records = spark.readStream.schema(f"{tables.RECORD}, {tables.BROKEN} string").option("columnNameOfCorruptRecord", tables.BROKEN).json(source)
    query = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
