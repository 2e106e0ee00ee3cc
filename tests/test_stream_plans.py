import datetime as dt
import os
from collections import Counter

import pytest

from docloom.plans import stream_plans


@pytest.mark.parametrize("files", [1, 9])
def test_all_days_are_counted(spark, tmp_path, files):
    """The last days too, and those of files that come after files of later days."""
    start = dt.datetime(2024, 1, 1, 6)
    rows = [(i, start + dt.timedelta(days=i * 7 % 90), i * 10) for i in range(120)] + [(999, None, 5)]
    rows.sort(key=lambda r: (r[1] is None, r[1] or start), reverse=True)
    folder = tmp_path / "extract_record.parquet"
    folder.mkdir()
    step = -(-len(rows) // files)
    for k in range(files):  # the latest days are in the first file
        part = spark.createDataFrame(rows[k * step : (k + 1) * step], "extract_id long, extracted_at timestamp, size_bytes long")
        part.coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        source = next((tmp_path / f"part{k}").glob("*.parquet"))
        source.rename(folder / f"part-{k}.parquet")
        os.utime(folder / f"part-{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    n, size = Counter(), Counter()
    for _, at, b in rows:
        if at:
            n[at.date()] += 1
            size[at.date()] += b
    got = {r["day"].date(): (r["files"], r["bytes"]) for r in stream_plans.stream_daily_files(spark, str(tmp_path)).collect()}
    assert got == {day: (n[day], size[day]) for day in n}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    from docloom.streaming.ingest import ProgressLog, report_every, run_into, upsert_batches, upserted

    schema = "doc_id string, at long, v string"
    source = tmp_path / "in"
    want = {}
    for k in range(6):
        rows = [(f"d{i}", 10 - k if i % 5 == 0 else k, f"{k}-{i}") for i in range(k * 3, k * 3 + 9)]
        for d, at, v in rows:
            want[d] = max(want.get(d, (-1, "")), (at, v))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    log, reports = ProgressLog(), []
    spark.streams.addListener(log)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)).selectExpr("doc_id", "at", "v", "struct(at, v) AS o")
    run_into(stream, str(tmp_path / "ck"), report_every(2, reports.append, upsert_batches(str(tmp_path / "state"), "doc_id", "o", buckets=4))).awaitTermination()
    got = {r["doc_id"]: (r["at"], r["v"]) for r in upserted(spark, str(tmp_path / "state"), stream.schema).collect()}
    assert got == want and reports == [1, 3, 5]
    kept = list((tmp_path / "state").glob("v=*/_bucket=*"))
    assert len(kept) <= 8  # two versions of each bucket at most
    spark.streams.removeListener(log)
    assert {r["state"] for r in log.rows()} >= {"started"}
    assert upserted(spark, str(tmp_path / "none"), stream.schema).count() == 0
