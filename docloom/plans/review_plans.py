"""Queries of a review: decisions, reports, work lists, look-ups and searches, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import priors as P
from docloom.functions import textops as X
from docloom.functions.terms import form_k
from docloom.operators import search as S
from docloom.operators.versions import current_rows
from docloom.plans.ledger_plans import _CURRENT, _ledger
from docloom.session import spread, table
from docloom.sinks.reports import safe_sidecar

KINDS = (*P.KINDS,)
#: Columns of a flat decision that no table of a run without model passes fills.
UNFILLED = (
    "pass1_at pass1_chunk_custodies pass1_tags pass1_work_related pass1_summary pass1_error pass2_at pass2_model_custody pass2_model_recommendation pass2_model_reasons "
    "pass2_model_rationale pass2_model_confidence pass2_code_override pass2_final_reasons map_lifecycle map_handoff_note"
).split()


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The latest extraction of each document."""
    blank = F.coalesce(X.strip_all(F.col("text")) == "", F.lit(True))
    e = table(spark, d, "extract_record")
    error = F.when(F.col("extraction_error").isNotNull(), F.col("extraction_error")).when(blank, "no text extracted")
    rows = e.select("doc_id", "extracted_at", (~blank & F.coalesce("extraction_ok", F.lit(False))).alias("ok"), F.col("extraction_method").alias("method"), error.alias("error"))
    order = F.struct("extracted_at", "ok", "method", "error")
    return rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(order).alias("r")).select("doc_id", "r.*")


def _joined(values: Column) -> Column:
    return F.coalesce(F.array_join(F.filter(values, lambda x: x != ""), ","), F.lit(""))


def flat_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The nested row of each document as one level of columns: ledger, extraction, filing, tags, and every kind of identifier."""
    prior = lambda k: F.try_element_at(F.col("priors"), F.lit(k))
    tags = current_rows(table(spark, d, "tags"), ["status", "tags", "audiences", "artifact_types", "summary", "confidence", "needs_review"]).withColumnsRenamed({c: f"t_{c}" for c in ("status", "tags", "audiences", "artifact_types", "summary", "confidence", "needs_review")})
    walk = current_rows(table(spark, d, "walk_home"), ["home", "walk_action"])
    layer = current_rows(table(spark, d, "layer_record"), ["reasoning"])
    rows = _ledger(spark, d).join(_texts(spark, d), "doc_id", "left").join(tags, "doc_id", "left").join(walk, "doc_id", "left").join(layer, "doc_id", "left")
    has = lambda c, name: F.when(F.col(c).isNotNull(), name)
    steps = F.array_compact(F.array(F.lit("extract"), F.lit("priors"), has("pass1.status", "pass1"), has("pass2.status", "pass2"), has("walk_action", "map"), has("t_status", "tags")))
    present = F.filter(F.array(*map(F.lit, KINDS)), lambda k: F.coalesce(F.array_contains(F.map_keys("priors"), k), F.lit(False)))
    return rows.select(
        "doc_id", "rel_path", "ext", "size_bytes", "char_count", "content_hash", "queue_status",
        F.array_join(steps, ",").alias("steps_done"),
        F.col("ok").alias("extract_ok"), F.col("method").alias("extract_method"), F.col("error").alias("extract_error"), F.col("queued_at").alias("extract_at"),
        _joined(F.col("filename_tags")).alias("filename_tags"),
        F.coalesce("prior_severity", F.lit("low")).alias("prior_severity"),
        F.array_join(present, ",").alias("prior_kinds"),
        *[F.col(f"pass1.{c}").alias(f"pass1_{c}") for c in ("status", "primary_tag", "custody", "confidence")],
        F.col("pass1.chunk_count").cast("long").alias("pass1_chunk_count"),
        F.col("pass2.status").alias("pass2_status"), F.col("pass2.custody").alias("pass2_final_custody"), F.col("pass2.recommendation").alias("pass2_final_recommendation"), F.col("pass2.confidence").alias("pass2_confidence"),
        F.lit(False).alias("pass2_fail_closed"),
        F.col("walk_action").alias("map_status"), F.coalesce(F.get("home", F.lit(0)), F.lit("")).alias("map_program"), F.coalesce(F.try_element_at("home", F.lit(-1)), F.lit("")).alias("map_function"),
        _joined(F.col("t_audiences")).alias("map_audience"), _joined(F.col("t_artifact_types")).alias("map_record_type"), F.col("t_confidence").alias("map_confidence"), F.col("t_needs_review").alias("map_needs_review"), F.col("reasoning").alias("map_rationale"),
        F.col("t_status").alias("rich_tags_status"), _joined(F.col("t_tags")).alias("rich_tags"), F.coalesce(F.array_size("t_tags"), F.lit(0)).cast("long").alias("rich_tags_count"), F.col("t_summary").alias("rich_summary"), F.col("t_needs_review").alias("rich_tags_needs_review"),
        *[F.lit(None).cast("string").alias(c) for c in UNFILLED],
        *[F.coalesce(prior(k)["count"], F.lit(0)).cast("long").alias(f"prior_{k}_count") for k in KINDS],
        *[_joined(prior(k)["redacted_samples"]).alias(f"prior_{k}_samples") for k in KINDS],
    )


def decision_index(spark: SparkSession, d: str) -> DataFrame:
    """One JSON record and the place of its own file for each document, in path order; the index is written by tasks, not as one value."""
    row = F.struct("doc_id", "rel_path", "queue_status", F.coalesce("prior_severity", F.lit("low")).alias("prior_severity"), F.col("pass2.recommendation").alias("recommendation"))
    rows = _ledger(spark, d).select("doc_id", safe_sidecar(F.col("rel_path")).alias("file"), F.to_json(row, {"ignoreNullFields": "false"}).alias("record"), "rel_path")
    return rows.orderBy("rel_path", "doc_id").drop("rel_path")


def delete_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents recommended for deletion, with the kinds of identifiers in them; nothing is deleted."""
    rows = _ledger(spark, d).where("pass2.recommendation = 'delete_candidate'")
    kinds = F.coalesce(F.array_join(F.array_sort(F.map_keys("priors")), ", "), F.lit(""))
    return rows.select("doc_id", "rel_path", F.col("pass2.custody").alias("custody"), F.col("pass2.confidence").alias("confidence"), kinds.alias("kinds")).orderBy("rel_path", "doc_id")


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """What people still have to look at, and why: the first reason that holds."""
    rows = _ledger(spark, d).join(_texts(spark, d), "doc_id", "left")
    ok, wish = F.coalesce("ok", F.lit(False)), F.col("pass2.recommendation")
    why = (
        F.when(~ok, F.concat(F.lit("extract failed: "), F.coalesce("error", F.lit("no extraction"))))
        .when(F.col("pass1.status") == "skipped", "pass 1 skipped")
        .when(F.col("pass2.status") == "skipped", "pass 2 skipped")
        .when(F.col("pass1").isNull(), "waiting on pass 1")
        .when(F.col("pass2").isNull(), "waiting on pass 2")
        .otherwise("model asked for review")
    )
    return rows.where(~ok | wish.isNull() | (wish == "review")).select("doc_id", "rel_path", why.alias("why")).orderBy("rel_path", "doc_id")


def review_reasons(spark: SparkSession, d: str) -> DataFrame:
    return review_queue(spark, d).groupBy(F.when(F.col("why").startswith("extract failed"), "extract failed").otherwise(F.col("why")).alias("why")).agg(F.count(F.lit(1)).alias("documents"))


def _todo(spark: SparkSession, d: str, name: str, done: list[str]) -> DataFrame:
    stage = current_rows(table(spark, d, name), ["status"])
    rows = _ledger(spark, d).select("doc_id", "rel_path").join(stage, "doc_id", "left")
    return rows.where(F.col("status").isNull() | ~F.col("status").isin(*done)).select("doc_id", "rel_path", "status").orderBy("rel_path", "doc_id")


def tagging_todo(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose tags are not done."""
    return _todo(spark, d, "tags", ["done"])


def placement_todo(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are neither placed nor skipped."""
    return _todo(spark, d, "layer_record", ["done", "skipped"])


#: Characters of a text that each stage's prompt may hold (fixed values).
PROMPT_CAPS = {"peek": 6_000, "spike": 8_000, "judge": 10_000, "tags": 12_000, "layers": 80_000}


def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """How much of each text the stages' prompts show, and the hash of the shortest view."""
    e = table(spark, d, "extract_record").select("extract_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    return e.select("extract_id", *[F.least(n, F.lit(most)).cast("long").alias(f"{stage}_chars") for stage, most in PROMPT_CAPS.items()], F.md5(F.left("text", F.lit(PROMPT_CAPS["peek"]))).alias("peek_md5"))


def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a stage reads of each extraction: its text, else the name of a locked file, else nothing."""
    e = table(spark, d, "extract_record")
    body = F.coalesce(X.strip_all(F.col("text")), F.lit(""))
    locked = F.lower(F.coalesce("extraction_error", F.lit(""))).rlike("lock|encrypt|password")
    stem = X.bare_stem(F.col("rel_path"))
    shown = F.when(body != "", F.col("text")).when(locked, stem).otherwise("")
    source = F.when(body != "", "body").when(locked & (stem != ""), "name").otherwise("none")
    return e.select("extract_id", source.alias("source"), F.char_length(shown).cast("long").alias("chars"))


def personal_tax_files(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).where(F.array_contains("filename_tags", "tax_financial")).select("doc_id", "rel_path")


def path_or_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ledger id of each walked path: by the whole path, else by the file's name if it is one document's alone."""
    ids = table(spark, d, "ledger").where("rel_path IS NOT NULL")
    by_path = ids.groupBy("rel_path").agg(F.min("doc_id").alias("path_id"))
    name = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    by_name = ids.groupBy(name("rel_path").alias("name")).agg(F.min("doc_id").alias("name_id"), F.countDistinct("doc_id").alias("n")).where("n = 1").select("name", "name_id")
    rows = table(spark, d, "walk_home").select("walk_id", "rel_path", name("rel_path").alias("name"))
    rows = rows.join(by_path, "rel_path", "left").join(by_name, "name", "left")
    how = F.when(F.col("path_id").isNotNull(), "path").when(F.col("name_id").isNotNull(), "name").otherwise("none")
    return rows.select("walk_id", F.coalesce("path_id", "name_id").alias("ledger_id"), how.alias("how"))


def filing_notes(spark: SparkSession, d: str) -> DataFrame:
    """Each walked document with the notes of its filing (left join)."""
    notes = current_rows(table(spark, d, "layer_record"), ["summary", "reasoning"])
    rows = table(spark, d, "walk_home").where("doc_id IS NOT NULL").select("doc_id").distinct()
    return rows.join(notes, "doc_id", "left").select("doc_id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("reasoning", F.lit("")).alias("notes"))


def _walked(spark: SparkSession, d: str) -> DataFrame:
    home = F.filter(F.transform(F.coalesce("home", F.array().cast("array<string>")), form_k), lambda x: x.isNotNull() & (x != ""))
    return current_rows(table(spark, d, "walk_home"), ["rel_path", "home"]).select("doc_id", "rel_path", home.alias("home"))


def top_programs(spark: SparkSession, d: str) -> DataFrame:
    """The six broadest folders with the most documents."""
    tops = _walked(spark, d).where(F.size("home") > 0).groupBy(F.get("home", F.lit(0)).alias("program")).agg(F.count(F.lit(1)).alias("documents"))
    return tops.orderBy(F.desc("documents"), "program").limit(6)


def regions_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Folders in the order of a browse list: topics first, then by documents, then by id."""
    paths = _walked(spark, d).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("home")), lambda i: F.slice("home", 1, i))).alias("p")).where(F.size("p") > 0)
    nodes = paths.groupBy(F.array_join("p", "/").alias("region"), (F.size("p") == 1).alias("topic")).agg(F.count(F.lit(1)).alias("documents"))
    return nodes.orderBy(F.desc("topic"), F.desc("documents"), "region")


def revise_members(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 members of each folder by path: what a reviser is shown."""
    rows = _walked(spark, d).select("doc_id", "rel_path", F.array_join("home", "/").alias("region"))
    place = F.row_number().over(Window.partitionBy("region").orderBy("rel_path", "doc_id"))
    return rows.withColumn("place", place.cast("long")).where("place <= 40").select("region", "place", "rel_path", "doc_id")


def document_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """Breadcrumbs, top level and program/function placement of each document that has a home."""
    rows = _walked(spark, d).where(F.size("home") > 0)
    return rows.select("doc_id", F.array_join("home", " / ").alias("crumbs"), F.get("home", F.lit(0)).alias("program"), F.when(F.size("home") > 1, F.element_at("home", -1)).otherwise(F.get("home", F.lit(0))).alias("function"), F.size("home").cast("long").alias("depth"))


def search_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class of each document by the first of several rules that holds, and the years it names."""
    rows = spread(table(spark, d, "documents").select("doc_id", "rel_path", "text"))
    name, text = F.coalesce(F.element_at(F.split("rel_path", "/"), -1), F.lit("")), F.coalesce("text", F.lit(""))
    return rows.select("doc_id", S.hit_class(name, text).alias("kind"), F.array_join(S.dated_years(text), ",").alias("years"))


def search_hits(spark: SparkSession, d: str) -> DataFrame:
    return S.search_hits(spread(table(spark, d, "documents").select("doc_id", "rel_path", "text")), "doc_id", "rel_path", "text")


def search_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Files that a search need open at all: judged by name, type and size, before any text is read."""
    e = table(spark, d, "extract_record").select("extract_id", "rel_path", "size_bytes")
    return e.where(S.worth_opening(F.col("rel_path"), F.col("size_bytes"))).select("extract_id", "rel_path")


_BLANK = r"coalesce(regexp_replace(text, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') = '', true)"
_TEXT = f"""ex AS (SELECT doc_id, extracted_at, ok, method, error FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY extracted_at DESC NULLS LAST, ok DESC, method DESC NULLS LAST, error DESC NULLS LAST) AS rn FROM
 (SELECT doc_id, extracted_at, NOT {_BLANK} AND coalesce(extraction_ok, false) AS ok, extraction_method AS method, CASE WHEN extraction_error IS NOT NULL THEN extraction_error WHEN {_BLANK} THEN 'no text extracted' END AS error FROM extract_record WHERE doc_id IS NOT NULL)) WHERE rn = 1)"""


def _last(name: str, alias: str) -> str:
    return f"{alias} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stamped_at DESC NULLS LAST) AS rn FROM {name} WHERE doc_id IS NOT NULL) WHERE rn = 1)"


_KF = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_WALKED = f"WITH {_last('walk_home', 'w0')}, w AS (SELECT doc_id, rel_path, list_filter(list_transform(coalesce(home, []), lambda x: {_KF.format('x')}), lambda x: x <> '') AS home FROM w0)"
_STEM = r"""trim(regexp_replace(regexp_replace(regexp_replace(list_extract(string_split(rel_path, '/'), -1), '(?i)\(secured\)', '', 'g'), '(?i)(\.(pdf|docx?|pptx?|xlsx?|txt|html?|rtf|md|csv|jpe?g|png))+$', '', 'g'), '\(\d+\)', '', 'g'))"""


def _flat_sql() -> str:
    join = lambda c: f"coalesce(array_to_string(list_filter({c}, lambda x: x <> ''), ','), '')"
    steps = "concat_ws(',', 'extract', 'priors', CASE WHEN cur.pass1.status IS NOT NULL THEN 'pass1' END, CASE WHEN cur.pass2.status IS NOT NULL THEN 'pass2' END, CASE WHEN walk_action IS NOT NULL THEN 'map' END, CASE WHEN t.status IS NOT NULL THEN 'tags' END)"
    kinds = "concat_ws(',', " + ", ".join(f"CASE WHEN list_contains(map_keys(priors), '{k}') THEN '{k}' END" for k in KINDS) + ")"
    counts = ", ".join(f"CAST(coalesce(priors['{k}'].count, 0) AS BIGINT) AS prior_{k}_count, {join(f"priors['{k}'].redacted_samples")} AS prior_{k}_samples" for k in KINDS)
    empty = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in UNFILLED)
    p1 = ", ".join(f"cur.pass1.{c} AS pass1_{c}" for c in ("status", "primary_tag", "custody", "confidence"))
    return f"""{_CURRENT}, {_TEXT}, {_last('tags', 't')}, {_last('walk_home', 'w')}, {_last('layer_record', 'l')}
SELECT cur.doc_id, cur.rel_path, ext, size_bytes, char_count, content_hash, queue_status, {steps} AS steps_done, ok AS extract_ok, method AS extract_method, error AS extract_error, queued_at AS extract_at,
 {join('filename_tags')} AS filename_tags, coalesce(prior_severity, 'low') AS prior_severity, {kinds} AS prior_kinds, {p1}, CAST(cur.pass1.chunk_count AS BIGINT) AS pass1_chunk_count,
 cur.pass2.status AS pass2_status, cur.pass2.custody AS pass2_final_custody, cur.pass2.recommendation AS pass2_final_recommendation, cur.pass2.confidence AS pass2_confidence, false AS pass2_fail_closed,
 walk_action AS map_status, coalesce(home[1], '') AS map_program, coalesce(home[-1], '') AS map_function, {join('t.audiences')} AS map_audience, {join('t.artifact_types')} AS map_record_type,
 t.confidence AS map_confidence, t.needs_review AS map_needs_review, l.reasoning AS map_rationale, t.status AS rich_tags_status, {join('t.tags')} AS rich_tags, CAST(coalesce(len(t.tags), 0) AS BIGINT) AS rich_tags_count,
 t.summary AS rich_summary, t.needs_review AS rich_tags_needs_review, {empty}, {counts}
FROM cur LEFT JOIN ex ON ex.doc_id = cur.doc_id LEFT JOIN t ON t.doc_id = cur.doc_id LEFT JOIN w ON w.doc_id = cur.doc_id LEFT JOIN l ON l.doc_id = cur.doc_id"""


def _todo_sql(name: str, done: str) -> str:
    return f"{_CURRENT}, {_last(name, 's')} SELECT cur.doc_id, cur.rel_path, s.status FROM cur LEFT JOIN s ON s.doc_id = cur.doc_id WHERE s.status IS NULL OR s.status NOT IN ({done})"


_QUEUE = f"""{_CURRENT}, {_TEXT}, q AS (SELECT cur.doc_id, cur.rel_path, CASE WHEN NOT coalesce(ok, false) THEN 'extract failed: ' || coalesce(error, 'no extraction') WHEN cur.pass1.status = 'skipped' THEN 'pass 1 skipped'
 WHEN cur.pass2.status = 'skipped' THEN 'pass 2 skipped' WHEN cur.pass1 IS NULL THEN 'waiting on pass 1' WHEN cur.pass2 IS NULL THEN 'waiting on pass 2' ELSE 'model asked for review' END AS why
 FROM cur LEFT JOIN ex ON ex.doc_id = cur.doc_id WHERE NOT coalesce(ok, false) OR cur.pass2.recommendation IS NULL OR cur.pass2.recommendation = 'review')"""


def queries() -> dict:
    names = (
        "flat_decisions decision_index delete_candidates review_queue review_reasons tagging_todo placement_todo prompt_texts document_texts personal_tax_files path_or_name_lookup filing_notes "
        "top_programs regions_by_size revise_members document_breadcrumbs search_classes search_hits search_candidates"
    )
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    caps = ", ".join(f"least(length(coalesce(text, '')), {n}) AS {s}_chars" for s, n in PROMPT_CAPS.items())
    return {
        "flat_decisions": _flat_sql(),
        "decision_index": _CURRENT + """ SELECT doc_id, CASE WHEN NOT (starts_with(rel_path, '/') OR list_contains(string_split(rel_path, '/'), '..') OR list_contains(string_split(rel_path, '/'), '') OR regexp_matches(rel_path, '^[A-Za-z]:')) THEN rel_path || '.json' END AS file,
 CAST(to_json({'doc_id': doc_id, 'rel_path': rel_path, 'queue_status': queue_status, 'prior_severity': coalesce(prior_severity, 'low'), 'recommendation': pass2.recommendation}) AS VARCHAR) AS record FROM cur""",
        "delete_candidates": _CURRENT + " SELECT doc_id, rel_path, pass2.custody AS custody, pass2.confidence AS confidence, coalesce(array_to_string(list_sort(map_keys(priors)), ', '), '') AS kinds FROM cur WHERE pass2.recommendation = 'delete_candidate'",
        "review_queue": _QUEUE + " SELECT * FROM q",
        "review_reasons": _QUEUE + " SELECT CASE WHEN starts_with(why, 'extract failed') THEN 'extract failed' ELSE why END AS why, count(*) AS documents FROM q GROUP BY 1",
        "tagging_todo": _todo_sql("tags", "'done'"),
        "placement_todo": _todo_sql("layer_record", "'done', 'skipped'"),
        "prompt_texts": f"SELECT extract_id, {caps}, md5(left(coalesce(text, ''), 6000)) AS peek_md5 FROM extract_record",
        "document_texts": f"""WITH s AS (SELECT extract_id, coalesce(text, '') AS text, NOT {_BLANK} AS body, regexp_matches(lower(coalesce(extraction_error, '')), 'lock|encrypt|password') AS locked, {_STEM} AS stem FROM extract_record)
 SELECT extract_id, CASE WHEN body THEN 'body' WHEN locked AND stem <> '' THEN 'name' ELSE 'none' END AS source, CASE WHEN body THEN length(text) WHEN locked THEN length(stem) ELSE 0 END AS chars FROM s""",
        "personal_tax_files": _CURRENT + " SELECT doc_id, rel_path FROM cur WHERE list_contains(filename_tags, 'tax_financial')",
        "path_or_name_lookup": """WITH l AS (SELECT doc_id, rel_path, lower(list_extract(string_split(rel_path, '/'), -1)) AS name FROM ledger WHERE rel_path IS NOT NULL), p AS (SELECT rel_path, min(doc_id) AS path_id FROM l GROUP BY 1),
 n AS (SELECT name, min(doc_id) AS name_id FROM l GROUP BY 1 HAVING count(DISTINCT doc_id) = 1)
 SELECT walk_id, coalesce(path_id, name_id) AS ledger_id, CASE WHEN path_id IS NOT NULL THEN 'path' WHEN name_id IS NOT NULL THEN 'name' ELSE 'none' END AS how
 FROM walk_home w LEFT JOIN p ON p.rel_path = w.rel_path LEFT JOIN n ON n.name = lower(list_extract(string_split(w.rel_path, '/'), -1))""",
        "filing_notes": f"WITH {_last('walk_home', 'w')}, {_last('layer_record', 'l')} SELECT w.doc_id, coalesce(l.summary, '') AS summary, coalesce(l.reasoning, '') AS notes FROM w LEFT JOIN l ON l.doc_id = w.doc_id",
        "top_programs": _WALKED + " SELECT home[1] AS program, count(*) AS documents FROM w WHERE len(home) > 0 GROUP BY 1 ORDER BY documents DESC, program LIMIT 6",
        "regions_by_size": _WALKED + ", p AS (SELECT home, unnest(range(1, len(home) + 1)) AS n FROM w) SELECT array_to_string(home[1:n], '/') AS region, n = 1 AS topic, count(*) AS documents FROM p GROUP BY 1, 2",
        "revise_members": _WALKED + ", m AS (SELECT array_to_string(home, '/') AS region, row_number() OVER (PARTITION BY array_to_string(home, '/') ORDER BY rel_path, doc_id) AS place, rel_path, doc_id FROM w) SELECT * FROM m WHERE place <= 40",
        "document_breadcrumbs": _WALKED + " SELECT doc_id, array_to_string(home, ' / ') AS crumbs, home[1] AS program, home[-1] AS function, len(home) AS depth FROM w WHERE len(home) > 0",
        "search_classes": S.class_sql(),
        "search_hits": S.hits_sql(),
        "search_candidates": S.candidate_sql(),
    }
