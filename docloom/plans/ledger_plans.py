"""Queries over the ledger: versions, merges, comparisons, reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.terms import form_k
from docloom.operators.merge import compare_runs, last_write, not_in, upsert
from docloom.operators.versions import current_rows
from docloom.session import table

_IDENTIFIERS = ("ssn", "email", "phone", "dob", "address", "credit_card")


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document: the last queued, then by hash and size (whole copies are alike)."""
    return last_write(table(spark, d, "ledger"), ["doc_id"], [F.col("queued_at"), F.col("content_hash"), F.col("size_bytes"), F.col("char_count"), F.col("pass1.status"), F.col("pass2.status"), F.col("pass2.recommendation")])


def ledger_current(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).select("doc_id", "rel_path", "content_hash", "char_count", "prior_severity", "queue_status")


def ledger_versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("content_hash").alias("hashes"), F.min("queued_at").alias("first_queued"), F.max("queued_at").alias("last_queued")
    )


def pending_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose first pass is missing or was skipped, in path order."""
    status = F.col("pass1.status")
    return _ledger(spark, d).where(status.isNull() | (status == "skipped")).select("doc_id", "rel_path").orderBy("rel_path")


def ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after the current extractions: texts with another hash lose the results that rest on the old one."""
    old = _ledger(spark, d).select("doc_id", "rel_path", "content_hash", F.col("pass1.status").alias("pass1_status"), F.col("pass2.status").alias("pass2_status"), "queue_status")
    latest = current_rows(table(spark, d, "extract_record"), ["rel_path", "text"], stamp="extracted_at")
    new = latest.select("doc_id", "rel_path", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))
    return upsert(old, new, "doc_id", "content_hash", ["pass1_status", "pass2_status"], ["queue_status"])


def upsert_actions(spark: SparkSession, d: str) -> DataFrame:
    return ledger_upsert(spark, d).groupBy("merge_action").agg(F.count(F.lit(1)).alias("documents"))


def unseen_extracts(spark: SparkSession, d: str) -> DataFrame:
    """Extracted documents that no finished ledger row knows (left anti)."""
    done = table(spark, d, "ledger").where(F.col("pass2.status") == "done")
    return not_in(table(spark, d, "extract_record").select("doc_id", "extract_id"), done, "doc_id")


def path_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ledger id of each document path of the walk, by path."""
    ids = table(spark, d, "ledger").groupBy("rel_path").agg(F.min("doc_id").alias("ledger_id"))
    return table(spark, d, "walk_home").select("walk_id", "rel_path").join(ids, "rel_path", "left").select("walk_id", "ledger_id")


def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The two filings of each document side by side, with whether they agree on the main folder."""
    a = current_rows(table(spark, d, "layer_record"), ["main"]).select("doc_id", form_k(F.coalesce("main", F.lit(""))).alias("main"))
    b = current_rows(table(spark, d, "walk_home"), ["walk_id", "main"]).select("doc_id", form_k(F.coalesce("main", F.lit(""))).alias("main"))
    return compare_runs(a, b, "doc_id", ["main"])


def run_agreement(spark: SparkSession, d: str) -> DataFrame:
    c = run_comparison(spark, d)
    return c.agg(
        F.count_if(F.col("side") == "both").alias("shared"),
        F.count_if(F.col("side") == "left").alias("only_left"),
        F.count_if(F.col("side") == "right").alias("only_right"),
        F.coalesce(F.avg(F.col("same_main").cast("double")) * 100, F.lit(0.0)).alias("agreement_pct"),
    )


def path_set_operations(spark: SparkSession, d: str) -> DataFrame:
    """How many paths the two filings share, and have alone (intersect, except, union)."""
    a = table(spark, d, "layer_record").select("rel_path").where("rel_path IS NOT NULL").distinct()
    b = table(spark, d, "walk_home").select("rel_path").where("rel_path IS NOT NULL").distinct()
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("paths")).select(F.lit(name).alias("part"), "paths")
    return n(a.intersect(b), "both").unionAll(n(a.subtract(b), "left")).unionAll(n(b.subtract(a), "right")).unionAll(n(a.union(b).distinct(), "any"))


def ledger_report(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.map_keys("priors")
    pii = F.coalesce(F.arrays_overlap(kinds, F.array(*map(F.lit, _IDENTIFIERS))), F.lit(False))
    return _ledger(spark, d).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(pii).alias("with_identifiers"),
        F.count_if(F.col("pass1.status") == "done").alias("pass1_done"),
        F.count_if(F.col("pass2.status") == "done").alias("pass2_done"),
        F.count_if(F.col("content_hash").isNull()).alias("without_hash"),
        F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars"),
    )


def recommendation_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).groupBy(F.coalesce("pass2.recommendation", F.lit("pending")).alias("recommendation")).agg(F.count(F.lit(1)).alias("documents"))


def primary_tag_map(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their primary tag, tags by size; untagged ones under an empty tag."""
    return _ledger(spark, d).groupBy(F.coalesce("pass1.primary_tag", F.lit("")).alias("primary_tag")).agg(F.count(F.lit(1)).alias("documents"), F.min("rel_path").alias("first_path"), F.max("rel_path").alias("last_path"))


def prior_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    each = _ledger(spark, d).select(F.explode("priors").alias("kind", "v"))
    return each.groupBy("kind").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("v.count").cast("long")).alias("hits"), F.sum(F.size("v.redacted_samples").cast("long")).alias("samples"))


def unmasked_samples(spark: SparkSession, d: str) -> DataFrame:
    """Ledger samples that are neither masked nor a placeholder nor a listed word."""
    each = table(spark, d, "ledger").select("doc_id", F.explode("priors").alias("kind", "v")).select("doc_id", "kind", F.explode("v.redacted_samples").alias("sample"))
    masked = F.col("sample").contains("*") | F.col("sample").rlike(r"^\[[a-z-]+\]$")
    return each.where(~masked & (F.col("kind") != "sensitive_keyword")).groupBy("kind").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("samples"))


def progress_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Running progress of the extraction by hour: done so far, percent, seconds for each file, files to go."""
    e = table(spark, d, "extract_record").select(F.date_trunc("hour", "extracted_at").alias("tick"), F.unix_timestamp("extracted_at").alias("at"), "size_bytes")
    hourly = e.groupBy("tick").agg(F.count(F.lit(1)).alias("files"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    run = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over hours, not files
    whole = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    done = F.sum("files").over(run)
    total = F.sum("files").over(whole)
    seconds = F.col("last_at") - F.min("first_at").over(run)
    return hourly.select("tick", "files", done.alias("done"), (done * 100 / total).alias("percent"), (seconds / done).alias("seconds_per_file"), (total - done).alias("to_go"), "bytes")


def rate_change(spark: SparkSession, d: str) -> DataFrame:
    """Share of rows in need of review by month, and its change against the month before."""
    t = table(spark, d, "tags").where("stamped_at IS NOT NULL").groupBy(F.date_trunc("month", "stamped_at").alias("month"))
    rates = t.agg(F.count(F.lit(1)).alias("row_count"), F.avg(F.coalesce("needs_review", F.lit(False)).cast("double")).alias("rate"))
    return rates.withColumn("change", F.col("rate") - F.lag("rate").over(Window.orderBy("month")))


def event_counters(spark: SparkSession, d: str) -> DataFrame:
    """Additive counters of each stage of a run log."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("user_id").alias("users"), F.sum("value").alias("total"), F.max("value").alias("largest"))


_ORDER = "queued_at DESC NULLS LAST, content_hash DESC NULLS LAST, size_bytes DESC NULLS LAST, char_count DESC NULLS LAST, pass1.status DESC NULLS LAST, pass2.status DESC NULLS LAST, pass2.recommendation DESC NULLS LAST"
_CURRENT = f"WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}) AS rn FROM ledger) WHERE rn = 1)"
_K = "regexp_replace(regexp_replace(lower(coalesce(main, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_UPSERT = f"""{_CURRENT}, ext AS (SELECT doc_id, rel_path, sha256(text) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY extracted_at DESC NULLS LAST) AS rn FROM extract_record) WHERE rn = 1),
m AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.rel_path ELSE o.rel_path END AS rel_path,
 CASE WHEN n.doc_id IS NOT NULL THEN n.content_hash ELSE o.content_hash END AS content_hash,
 CASE WHEN n.doc_id IS NULL OR n.content_hash IS NOT DISTINCT FROM o.content_hash THEN o.pass1.status END AS pass1_status,
 CASE WHEN n.doc_id IS NULL OR n.content_hash IS NOT DISTINCT FROM o.content_hash THEN o.pass2.status END AS pass2_status, o.queue_status,
 CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'keep' WHEN n.content_hash IS NOT DISTINCT FROM o.content_hash THEN 'same' ELSE 'update' END AS merge_action
 FROM cur o FULL JOIN ext n ON o.doc_id = n.doc_id)"""
_COMPARE = f"""WITH a AS (SELECT doc_id, {_K} AS main FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stamped_at DESC NULLS LAST) AS rn FROM layer_record WHERE doc_id IS NOT NULL) WHERE rn = 1),
b AS (SELECT doc_id, {_K} AS main FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stamped_at DESC NULLS LAST) AS rn FROM walk_home WHERE doc_id IS NOT NULL) WHERE rn = 1),
c AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right' WHEN b.doc_id IS NULL THEN 'left' ELSE 'both' END AS side, a.main AS left_main, b.main AS right_main,
 CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN a.main IS NOT DISTINCT FROM b.main END AS same_main FROM a FULL JOIN b ON a.doc_id = b.doc_id)"""


def queries() -> dict:
    names = "ledger_current ledger_versions pending_rows ledger_upsert upsert_actions unseen_extracts path_lookup run_comparison run_agreement path_set_operations ledger_report recommendation_histogram primary_tag_map prior_kind_counts unmasked_samples progress_ticks rate_change event_counters"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    found = " OR ".join(f"list_contains(map_keys(priors), '{k}')" for k in _IDENTIFIERS)
    return {
        "ledger_current": _CURRENT + " SELECT doc_id, rel_path, content_hash, char_count, prior_severity, queue_status FROM cur",
        "ledger_versions": "SELECT doc_id, count(*) AS row_count, count(DISTINCT content_hash) AS hashes, min(queued_at) AS first_queued, max(queued_at) AS last_queued FROM ledger GROUP BY 1",
        "pending_rows": _CURRENT + " SELECT doc_id, rel_path FROM cur WHERE pass1.status IS NULL OR pass1.status = 'skipped'",
        "ledger_upsert": _UPSERT + " SELECT * FROM m",
        "upsert_actions": _UPSERT + " SELECT merge_action, count(*) AS documents FROM m GROUP BY 1",
        "unseen_extracts": "SELECT doc_id, extract_id FROM extract_record e WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.doc_id = e.doc_id AND l.pass2.status = 'done')",
        "path_lookup": "SELECT walk_id, ledger_id FROM walk_home w LEFT JOIN (SELECT rel_path, min(doc_id) AS ledger_id FROM ledger GROUP BY 1) l ON w.rel_path = l.rel_path",
        "run_comparison": _COMPARE + " SELECT * FROM c",
        "run_agreement": _COMPARE + " SELECT count(*) FILTER (side = 'both') AS shared, count(*) FILTER (side = 'left') AS only_left, count(*) FILTER (side = 'right') AS only_right, coalesce(avg(CAST(same_main AS DOUBLE)) * 100, 0.0) AS agreement_pct FROM c",
        "path_set_operations": """WITH a AS (SELECT DISTINCT rel_path FROM layer_record WHERE rel_path IS NOT NULL), b AS (SELECT DISTINCT rel_path FROM walk_home WHERE rel_path IS NOT NULL)
 SELECT 'both' AS part, count(*) AS paths FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'left', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'right', count(*) FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'any', count(*) FROM (FROM a UNION FROM b)""",
        "ledger_report": _CURRENT + f""" SELECT count(*) AS documents, count(*) FILTER (coalesce({found}, false)) AS with_identifiers, count(*) FILTER (pass1.status = 'done') AS pass1_done, count(*) FILTER (pass2.status = 'done') AS pass2_done,
 count(*) FILTER (content_hash IS NULL) AS without_hash, CAST(coalesce(sum(char_count), 0) AS BIGINT) AS chars FROM cur""",
        "recommendation_histogram": _CURRENT + " SELECT coalesce(pass2.recommendation, 'pending') AS recommendation, count(*) AS documents FROM cur GROUP BY 1",
        "primary_tag_map": _CURRENT + " SELECT coalesce(pass1.primary_tag, '') AS primary_tag, count(*) AS documents, min(rel_path) AS first_path, max(rel_path) AS last_path FROM cur GROUP BY 1",
        "prior_kind_counts": _CURRENT + ", e AS (SELECT unnest(map_entries(priors)) AS e FROM cur) SELECT e.key AS kind, count(*) AS documents, CAST(sum(e.value.count) AS BIGINT) AS hits, CAST(sum(len(e.value.redacted_samples)) AS BIGINT) AS samples FROM e GROUP BY 1",
        "unmasked_samples": r"""WITH e AS (SELECT doc_id, unnest(map_entries(priors)) AS e FROM ledger), s AS (SELECT doc_id, e.key AS kind, unnest(e.value.redacted_samples) AS sample FROM e)
 SELECT kind, count(DISTINCT doc_id) AS documents, count(*) AS samples FROM s WHERE NOT (contains(sample, '*') OR regexp_matches(sample, '^\[[a-z-]+\]$')) AND kind <> 'sensitive_keyword' GROUP BY 1""",
        "progress_ticks": """WITH h AS (SELECT date_trunc('hour', extracted_at) AS tick, count(*) AS files, min(CAST(floor(epoch(extracted_at)) AS BIGINT)) AS first_at, max(CAST(floor(epoch(extracted_at)) AS BIGINT)) AS last_at, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM extract_record GROUP BY 1),
 r AS (SELECT *, CAST(sum(files) OVER w AS BIGINT) AS done, CAST(sum(files) OVER () AS BIGINT) AS total, last_at - min(first_at) OVER w AS seconds FROM h WINDOW w AS (ORDER BY tick ROWS UNBOUNDED PRECEDING))
 SELECT tick, files, done, done * 100 / total AS percent, seconds / done AS seconds_per_file, total - done AS to_go, bytes FROM r""",
        "rate_change": """WITH r AS (SELECT date_trunc('month', stamped_at) AS month, count(*) AS row_count, avg(CAST(coalesce(needs_review, false) AS DOUBLE)) AS rate FROM tags WHERE stamped_at IS NOT NULL GROUP BY 1)
 SELECT month, row_count, rate, rate - lag(rate) OVER (ORDER BY month) AS change FROM r""",
        "event_counters": "SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS users, sum(value) AS total, max(value) AS largest FROM events GROUP BY 1",
    }
