"""Files and extraction records as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from docloom.functions import priors as P
from docloom.session import list_names, numbered, remove_folder


def record_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_documents(records: DataFrame, event_time: str = "extracted_at", late: str = "30 days", key: str = "doc_id") -> DataFrame:
    """Each document once, within the time that late rows may take: state is dropped behind the watermark."""
    return records.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def scanned(records: DataFrame) -> DataFrame:
    """Records with their prior kinds and severity; the same expressions as in batch."""
    kinds = F.map_keys(P.scan_map(F.col("text")))
    return records.select("extract_id", "doc_id", "extracted_at", kinds.alias("kinds"), P.severity(kinds).alias("severity"))


def windowed_counts(records: DataFrame, event_time: str = "extracted_at", width: str = "1 day") -> DataFrame:
    """Rows and bytes by day of extraction. No watermark: files come in any order of time, and no row is too late.

    The state is one row for each day.
    """
    timed = records.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.groupBy(F.window(event_time, width).alias("w")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def run_into(records: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Run what is there through ``batch``; a batch that is tried again has the same number, so a keyed write is exactly once."""
    return records.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def replace_batches(target: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` for complete output: each batch is the whole result so far, in ``target``/v=<batch>."""

    def replace(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/v={number}")

    return replace


def _bucket_versions(spark: SparkSession, target: str, before: int | None = None) -> dict[str, list[int]]:
    """Versions of each bucket of a keyed state, rising."""
    out: dict[str, list[int]] = {}
    for v in numbered(spark, target):
        if before is None or v < before:
            for name in list_names(spark, f"{target}/v={v}"):
                if name.startswith("_bucket="):
                    out.setdefault(name, []).append(v)
    return out


def upsert_batches(target: str, key: str, order: str, buckets: int = 32) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` that keeps the last row of each key in ``target``/v=<batch>/_bucket=<hash of the key>.

    A batch rewrites only the buckets its keys fall in, from the last version of each before the batch, so one that is
    tried again gives the same. Versions that a later one had replaced before the batch are removed: the state is about as large as its rows.
    """

    def merge(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        versions = _bucket_versions(spark, target, number)
        for name, found in versions.items():
            for v in found[:-1]:
                remove_folder(spark, f"{target}/v={v}/{name}")
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [f"_bucket={r[0]}" for r in rows.select(bucket).distinct().collect()]  # at most ``buckets``
        paths = [f"{target}/v={versions[name][-1]}/{name}" for name in touched if name in versions]
        columns = rows.columns
        if paths:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*paths))
        best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key]), F.struct(F.col(order))).alias("r")).select(key, "r.*")
        best.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/v={number}")

    return merge


def upserted(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The state that ``upsert_batches`` keeps."""
    paths = [f"{target}/v={found[-1]}/{name}" for name, found in _bucket_versions(spark, target).items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def report_every(batches: int, report: Callable[[int], None], batch: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` that runs ``batch`` and, after each ``batches`` of them, ``report`` with the batch's number."""

    def run(rows: DataFrame, number: int) -> None:
        batch(rows, number)
        if (number + 1) % batches == 0:
            report(number)

    return run


class ProgressLog(StreamingQueryListener):
    """Keeps the last figures of each running stream: batch, rows, rows a second; ``rows()`` are those of a watcher's panel."""

    def __init__(self, most: int = 1_000):
        self.most, self.seen = most, []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._add(str(event.id), event.name, "started", 0, 0, 0.0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._add(str(p.id), p.name, "running", p.batchId, p.numInputRows, p.processedRowsPerSecond or 0.0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._add(str(event.id), None, "idle", 0, 0, 0.0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._add(str(event.id), None, "failed" if event.exception else "ended", 0, 0, 0.0)

    def _add(self, *row) -> None:
        self.seen = [*self.seen, row][-self.most :]

    def rows(self) -> list[dict]:
        return [dict(zip(("query", "name", "state", "batch", "rows", "rows_per_second"), r)) for r in self.seen]
