"""Queries that run as streams to their end, with the SQL of the batch they equal."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans import text_plans
from docloom.session import ensure_checkpoint_dir, numbered, table
from docloom.streaming.ingest import replace_batches, run_into, scanned, upsert_batches, upserted, windowed_counts


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of them."""
    path = f"{d}/{name}.parquet"
    schema = table(spark, d, name).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return reader.parquet(path)


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _latest(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/v={numbered(spark, target)[-1]}")


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last extraction of each document, kept up by micro-batches."""
    folder = _folder(spark)
    rows = _source(spark, d, "extract_record").where("doc_id IS NOT NULL").select("doc_id", "extract_id", "rel_path", "extracted_at", F.struct("extracted_at", "extract_id").alias("at"))
    run_into(rows, f"{folder}/checkpoint", upsert_batches(f"{folder}/ledger", "doc_id", "at")).awaitTermination()
    return upserted(spark, f"{folder}/ledger", rows.schema).select("doc_id", "extract_id", "rel_path", "extracted_at")


def stream_daily_files(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes of every day, in event-time windows, when the stream has run to its end."""
    folder = _folder(spark)
    counts = windowed_counts(_source(spark, d, "extract_record").where("extracted_at IS NOT NULL"))
    days = counts.select(F.col("w.start").alias("day"), "files", "bytes")
    run_into(days, f"{folder}/checkpoint", replace_batches(f"{folder}/days"), "complete").awaitTermination()
    return _latest(spark, f"{folder}/days")


def stream_severity(spark: SparkSession, d: str) -> DataFrame:
    """The scan of each record as it arrives: the same expressions as in batch."""
    folder = _folder(spark)
    rows = scanned(_source(spark, d, "extract_record")).select("extract_id", "severity")
    rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("extract_id long, severity string").parquet(f"{folder}/out")


def queries() -> dict:
    return {"stream_upsert": stream_upsert, "stream_daily_files": stream_daily_files, "stream_severity": stream_severity}


def oracle_sql() -> dict[str, str]:
    severity = text_plans.oracle_sql()["prior_severity"]
    return {
        "stream_upsert": "SELECT doc_id, extract_id, rel_path, extracted_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY extracted_at DESC NULLS LAST, extract_id DESC) AS rn FROM extract_record WHERE doc_id IS NOT NULL) WHERE rn = 1",
        "stream_daily_files": "SELECT date_trunc('day', extracted_at)::TIMESTAMP AS day, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM extract_record WHERE extracted_at IS NOT NULL GROUP BY 1",
        "stream_severity": f"SELECT extract_id, severity FROM ({severity})",
    }
