"""The review run and its command line: inventory, extraction, scan, model stages, ledger, reports."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import priors as P
from docloom.functions.terms import kebab
from docloom.models import stages as M
from docloom.models.step import ModelFn
from docloom.operators.audit import audit_loop
from docloom.operators.chunking import group_chunks, overlap_chunks
from docloom.operators.fold import walk_fold
from docloom.operators.merge import compare_runs, upsert
from docloom.operators.search import people, search
from docloom.operators.tree import depth_first, findings, regions_of
from docloom.plans import catalog
from docloom.session import cut, ensure_checkpoint_dir, local_session, numbered
from docloom.sinks.reports import move_plan, tree_text, write_decisions, write_markdown, write_regions, write_text
from docloom.sources.files import expand_archives, extract, inventory
from docloom.streaming.ingest import ProgressLog, report_every, run_into, upsert_batches, upserted

#: The closed vocabulary of placements (a parameter of the run).
FACETS = {"program": ["budget", "grants", "staffing", "safety", "training", "travel"], "function": ["planning", "reporting", "purchasing", "recruitment", "maintenance"], "audience": ["staff", "visitors", "partners"]}


def records(spark: SparkSession, root: str) -> DataFrame:
    """Extraction records of the files below ``root`` with document ids: files of one text are one document."""
    rows = extract(expand_archives(inventory(spark, root)))
    digest = F.when(F.col("extraction_ok"), F.sha2(F.encode("text", "UTF-8"), 256)).otherwise(F.sha2(F.concat_ws("|", "rel_path", "size_bytes"), 256))
    return rows.withColumn("content_hash", digest).withColumn("doc_id", F.left("content_hash", F.lit(16)))


def scanned(rows: DataFrame) -> DataFrame:
    """(doc_id, rel_path, content_hash, chars, priors, severity, filename_tags, extraction_*) with one row for each document.

    The last path in order stands for the files of one text.
    """
    priors = P.scan_map(F.col("text"))
    out = rows.select(
        "doc_id", "rel_path", "content_hash", F.char_length("text").alias("chars"), priors.alias("priors"),
        P.severity(F.map_keys(priors)).alias("severity"), P.filename_tags(F.col("rel_path")).alias("filename_tags"), "extraction_ok", "extraction_method", "extraction_error",
    )
    return out.groupBy("doc_id").agg(F.max_by(F.struct(*out.columns[1:]), "rel_path").alias("r")).select("doc_id", "r.*")


def review(spark: SparkSession, root: str) -> DataFrame:
    return scanned(records(spark, root))


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest version of a table kept in versions, or none."""
    found = numbered(spark, folder)
    return spark.read.parquet(f"{folder}/v={found[-1]}") if found else None


def stage_rows(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    """The answers of a stage so far: the last one of each document."""
    folder = f"{out}/stages/{name}"
    if not numbered(spark, folder):
        return None
    rows = spark.read.parquet(folder)
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("doc_id", "v")]), "v").alias("r")).select("doc_id", "r.*")


def run_stage(spark: SparkSession, out: str, name: str, docs: DataFrame, ask: Callable[[DataFrame], DataFrame], limit: int | None = None, force: bool = False) -> int:
    """Run a stage over the documents (doc_id, content_hash, ...) that it has not answered for their present text, and add what it gives.

    Only new answers are written. Returns how many documents were asked.
    """
    done = stage_rows(spark, out, name)
    todo = docs if done is None or force else docs.join(done.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")
    if limit is not None:
        todo = todo.orderBy("rel_path").limit(limit)
    todo = cut(todo)
    n = todo.count()
    if n:
        found = numbered(spark, f"{out}/stages/{name}")
        answers = ask(todo).join(todo.select("doc_id", "content_hash"), "doc_id")
        answers.write.parquet(f"{out}/stages/{name}/v={found[-1] + 1 if found else 0}")
    return n


def first_pass(docs: DataFrame, model: ModelFn | None = None) -> DataFrame:
    """First pass over the chunks of each document, merged to one result; a document whose chunks can't be read is skipped."""
    chunks = overlap_chunks(docs, "doc_id", "text").withColumn("_k", F.concat_ws("#", "doc_id", "chunk_no"))
    chunks = cut(chunks.join(docs.select("doc_id", "rel_path", F.array_join("filename_tags", ",").alias("hints")), "doc_id"))
    answers = M.first_pass(chunks.withColumnRenamed("chunk", "text"), "_k", model).join(chunks.select("_k", "doc_id", "chunk_no"), "_k")
    merged = M.merge_first_pass(answers, "doc_id", "chunk_no")
    return docs.select("doc_id").join(merged, "doc_id", "left").withColumn("status", F.when(F.col("tags").isNull(), "skipped").otherwise("done"))


def run(spark: SparkSession, root: str, out: str, priors_only: bool = False, limit: int | None = None, force: bool = False, model: ModelFn | None = None) -> dict[str, int]:
    """Review ``root`` into ``out``: the ledger in versions, the answers of each stage, decisions and reports.

    A second run over the same files asks no model and writes no version. Returns the number of documents each step took.
    """
    rows = cut(records(spark, root))
    new = scanned(rows).withColumn("priors", F.to_json("priors"))
    folder = f"{out}/ledger"
    old = latest(spark, folder)
    merged = cut(upsert(old.drop("merge_action"), new, "doc_id", "content_hash", [], []) if old is not None else new.withColumn("merge_action", F.lit("insert")))
    taken = {"ledger": merged.where("merge_action IN ('insert', 'update')").count()}
    if taken["ledger"] or old is None:
        found = numbered(spark, folder)
        merged.write.parquet(f"{folder}/v={found[-1] + 1 if found else 0}")
    ledger = latest(spark, folder)
    if not priors_only:
        texts = rows.where("extraction_ok").groupBy("doc_id").agg(F.max_by("text", "rel_path").alias("text"))
        docs = ledger.where("extraction_ok").select("doc_id", "content_hash", "rel_path", "filename_tags", "severity", F.json_object_keys("priors").alias("kinds")).join(texts, "doc_id")
        step = lambda name, ask, over: taken.update({name: run_stage(spark, out, name, over, ask, limit, force)})
        step("first-pass", lambda d: first_pass(d, model), docs)
        first = stage_rows(spark, out, "first-pass")
        if first is not None:
            ready = docs.join(first.where("status = 'done'").select("doc_id", "primary_tag", "custody", "confidence"), "doc_id")
            step("second-pass", lambda d: M.second_pass(d, "doc_id", model), ready)
        step("placement", lambda d: M.placements(d, "doc_id", FACETS, model), docs)
        step("rich-tags", lambda d: M.rich_tags(d, "doc_id", model), docs)
        step("layers", lambda d: M.layer_names(d, "doc_id", FACETS["program"], model), docs)
    report(spark, out)
    return taken


def report(spark: SparkSession, out: str) -> None:
    """Write the reports of what ``out`` holds, each whole."""
    ledger = latest(spark, f"{out}/ledger")
    write_markdown(ledger.groupBy("severity").agg(F.count(F.lit(1)).alias("documents")).orderBy("severity"), "Documents by severity", f"{out}/SUMMARY.md")
    kinds = F.json_object_keys("priors")
    has = P.has_identifier(kinds)
    write_markdown(ledger.where(has).select("rel_path", "severity", F.array_join(kinds, ", ").alias("kinds")).orderBy("rel_path"), "Documents with identifiers", f"{out}/PII-MAP.md")
    rows = ledger
    first, second, tags = (stage_rows(spark, out, n) for n in ("first-pass", "second-pass", "rich-tags"))
    none = F.lit(None).cast("string")
    rows = rows.join(first.select("doc_id", F.col("status").alias("pass1"), "primary_tag"), "doc_id", "left") if first is not None else rows.withColumns({"pass1": none, "primary_tag": none})
    rows = rows.join(second.select("doc_id", "recommendation", "rationale"), "doc_id", "left") if second is not None else rows.withColumns({"recommendation": none, "rationale": none})
    rows = cut(rows)
    write_decisions(rows, f"{out}/decisions")
    why = (
        F.when(~F.col("extraction_ok"), F.concat(F.lit("extract failed: "), F.coalesce("extraction_error", F.lit(""))))
        .when(F.col("pass1") == "skipped", "pass 1 skipped")
        .when(F.col("pass1").isNull(), "waiting on pass 1")
        .when(F.col("recommendation").isNull(), "waiting on pass 2")
        .otherwise(F.coalesce("rationale", F.lit("model asked for review")))
    )
    open_ = ~F.col("extraction_ok") | F.col("recommendation").isNull() | (F.col("recommendation") == "review")
    write_markdown(rows.where(open_).select("rel_path", why.alias("why")).orderBy("rel_path"), "Review queue", f"{out}/REVIEW-QUEUE.md")
    write_markdown(rows.where("recommendation = 'delete_candidate'").select("rel_path", "rationale").orderBy("rel_path"), "Delete candidates", f"{out}/DELETE-CANDIDATES.md")
    by_tag = rows.groupBy(F.coalesce("primary_tag", F.lit("")).alias("tag")).agg(F.count(F.lit(1)).alias("documents"), F.min("rel_path").alias("first"))
    write_markdown(by_tag.orderBy(F.desc("documents"), "tag"), "Documents by tag", f"{out}/DOCUMENT-MAP.md")
    placed = stage_rows(spark, out, "placement")
    if placed is not None:
        facets = F.array(*[F.struct(F.lit(f).alias("facet"), F.element_at(f, 1).alias("term")) for f in FACETS])
        tallies = placed.select(F.explode(facets).alias("x")).groupBy("x.facet", "x.term").agg(F.count(F.lit(1)).alias("documents"))
        write_markdown(tallies.orderBy("facet", F.desc("documents"), "term"), "Documents by facet", f"{out}/TOPIC-MAP.md")
        placed.drop("content_hash").write.mode("overwrite").json(f"{out}/placements")
    if tags is not None:
        counted = tags.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("documents"))
        write_markdown(counted.orderBy(F.desc("documents"), "tag").limit(40), "Most frequent tags", f"{out}/TAGS.md")
        tags.drop("content_hash").write.mode("overwrite").json(f"{out}/tags")


def walk(spark: SparkSession, out: str) -> DataFrame:
    """Homes of the documents by an ordered walk over their layers; writes REGIONS.md."""
    rows = stage_rows(spark, out, "layers").join(latest(spark, f"{out}/ledger").select("doc_id", "rel_path"), "doc_id")
    part = lambda i: F.coalesce(F.get("path", F.lit(i)), F.lit(""))
    homes = cut(walk_fold(rows.select("doc_id", "rel_path", part(0).alias("main"), part(1).alias("sub"), part(2).alias("detail")), "doc_id", "main", ["rel_path"], ["sub", "detail"]))
    homes.write.mode("overwrite").parquet(f"{out}/walk")
    nodes = regions_of(homes)
    ordered = cut(depth_first(nodes.select("id", "parent_id", "label"), "label", ["unmapped"]))
    write_text(f"{out}/REGIONS.md", tree_text(ordered))
    write_regions(ordered, out)
    at = homes.join(rows.select("doc_id", "rel_path"), "doc_id").select("rel_path", F.array_join("home", "--").alias("region_id"))
    write_markdown(findings(nodes, at), "Findings of the tree", f"{out}/AUDIT-GRAPH.md")
    return homes


def audit(spark: SparkSession, out: str, model: ModelFn | None = None, size: int = 12) -> list[dict]:
    """Audit the walk's homes by chunks of files until there is a reason to stop; writes AUDIT.md and the homes after it."""
    homes = spark.read.parquet(f"{out}/walk").join(latest(spark, f"{out}/ledger").select("doc_id", "rel_path"), "doc_id")
    tags = stage_rows(spark, out, "rich-tags").select("doc_id", F.slice("tags", 1, 18).alias("tags")).join(homes.select("doc_id", "rel_path"), "doc_id").select("rel_path", "tags")
    assigned = homes.select("rel_path", F.array(F.element_at("home", 1)).alias("region_ids"))
    ids = assigned.select(F.explode("region_ids").alias("id")).distinct()
    listed = sorted(r["id"] for r in ids.collect())  # main folders

    def judge(current: DataFrame) -> DataFrame:
        plan = group_chunks(current.select("rel_path", F.element_at("region_ids", 1).alias("region")), "region", ["rel_path"], size)
        chunks = plan.join(tags, "rel_path", "left").groupBy("chunk_id", "region").agg(F.array_sort(F.collect_list(F.struct("rel_path", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")))).alias("files"))
        return M.chunk_verdicts(chunks, listed, model)

    plan = group_chunks(assigned.select("rel_path", F.element_at("region_ids", 1).alias("region")), "region", ["rel_path"], size)
    write_markdown(plan.groupBy("region").agg(F.countDistinct("chunk_id").alias("chunks"), F.count(F.lit(1)).alias("files")).orderBy("region"), "Plan of the audit", f"{out}/AUDIT-PLAN.md")
    after, log = audit_loop(assigned, ids, judge)
    after.write.mode("overwrite").parquet(f"{out}/audited")
    write_markdown(spark.createDataFrame([(r["round"], float(r["rate"]), r["applied"], r["stop"] or "") for r in log], "round int, rate double, applied long, stop string"), "Audit", f"{out}/AUDIT.md")
    return log


def maintain(spark: SparkSession, out: str, model: ModelFn | None = None, least: int = 8) -> DataFrame:
    """(parent, name, into): child folders to combine below folders of ``least`` files and two children or more."""
    homes = spark.read.parquet(f"{out}/walk")
    kids = homes.where(F.size("home") > 1).groupBy(F.element_at("home", 1).alias("parent"), F.element_at("home", 2).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    levels = kids.groupBy("parent").agg(F.sum("n").alias("files"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "name", "n"))).alias("k")).where((F.col("files") >= least) & (F.size("k") > 1))
    levels = cut(levels.select("parent", F.transform("k", lambda x: x["name"]).alias("names"), F.transform("k", lambda x: x["n"]).alias("counts")))
    return M.combined(levels, "parent", "maintain", model)


def census(spark: SparkSession, out: str, model: ModelFn | None = None) -> DataFrame:
    """(level, name, into): main folders to combine, then the subs of each, by names and counts alone; the answers are kept as state."""
    rows = stage_rows(spark, out, "layers").where(F.size("path") > 0)
    mains = rows.groupBy(F.lit("mains").alias("level"), F.element_at("path", 1).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    subs = rows.where(F.size("path") > 1).groupBy(F.element_at("path", 1).alias("level"), F.element_at("path", 2).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    levels = mains.unionByName(subs).groupBy("level").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "name", "n"))).alias("k"))
    levels = cut(levels.select("level", F.transform("k", lambda x: x["name"]).alias("names"), F.transform("k", lambda x: x["n"]).alias("counts")))
    moves = cut(M.combined(levels, "level", "census", model))
    moves.write.mode("overwrite").json(f"{out}/census")
    write_markdown(moves.orderBy("level", "into", "name"), "Census", f"{out}/CENSUS.md")
    return moves


def spike(spark: SparkSession, root: str, out: str, model: ModelFn | None = None, limit: int = 20) -> DataFrame:
    """Open naming of a few documents, then the combination of the names: each row keeps what it was tagged, and from which name it moved."""
    docs = records(spark, root).where("extraction_ok").select("doc_id", "rel_path", "text").orderBy("rel_path").limit(limit)  # a spike is a trial on a few
    tagged = cut(M.layer_names(cut(docs), "doc_id", [], model, stage="spike", shown=8_000))
    mains = tagged.where(F.size("path") > 0).groupBy(F.element_at("path", 1).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    level = mains.agg(F.array_sort(F.collect_list("name")).alias("names"), F.array_sort(F.collect_list("n")).alias("counts")).select(F.lit("mains").alias("level"), "names", "counts")
    moves = M.combined(level, "level", "census", model).select(F.col("name").alias("_n"), "into")
    main = F.get("path", F.lit(0))
    rows = tagged.withColumn("_n", main).join(moves, "_n", "left")
    rows = rows.select("doc_id", F.col("path").alias("tagged"), F.coalesce("into", "_n").alias("main"), F.when(F.col("into").isNotNull(), F.col("_n")).alias("combined_from"))
    rows.write.mode("overwrite").json(f"{out}/spike")
    return spark.read.schema(rows.schema).json(f"{out}/spike")


def find(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Ranked search of a folder; writes SEARCH.md and PEOPLE.md."""
    rows = cut(extract(expand_archives(inventory(spark, root))).select(F.xxhash64("rel_path").alias("id"), "rel_path", "text"))
    hits = search(rows, "id", "rel_path", "text").select("rel_path", "score", "kind")
    write_markdown(hits, "Search", f"{out}/SEARCH.md")
    write_markdown(people(rows, "id", "text").orderBy("person"), "People", f"{out}/PEOPLE.md")
    return hits


def compare(spark: SparkSession, left: str, right: str, out: str) -> DataFrame:
    """Agreement of two runs on the main folder; writes COMPARE.md with the rows that differ."""
    side = lambda folder: stage_rows(spark, folder, "layers").select("doc_id", kebab(F.coalesce(F.get("path", F.lit(0)), F.lit(""))).alias("main"))
    both = cut(compare_runs(side(left), side(right), "doc_id", ["main"]))
    write_markdown(both.where("side <> 'both' OR NOT same_main").orderBy("doc_id"), "Differences", f"{out}/COMPARE.md")
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("documents"), F.count_if("same_main").alias("same"))


def watch(spark: SparkSession, root: str, out: str, files_per_batch: int = 25, every: int = 1) -> list[dict]:
    """Review a folder as a stream to its present end: each file once, reports after each ``every`` batches; gives the watcher's rows."""
    ensure_checkpoint_dir(spark)
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
        state = f"{out}/stream/ledger"
        schema = "rel_path string, at timestamp, severity string, kinds array<string>, extraction_ok boolean"

        def keep(batch: DataFrame, number: int) -> None:
            named = batch.select(F.regexp_replace("path", "^file:", "").alias("rel_path"), "content", F.col("modificationTime").alias("at"))
            rows = extract(expand_archives(named)).withColumn("kinds", F.map_keys(P.scan_map(F.col("text"))))
            at = batch.agg(F.max("modificationTime")).first()[0]
            rows = rows.select("rel_path", F.lit(at).cast("timestamp").alias("at"), P.severity(F.col("kinds")).alias("severity"), "kinds", "extraction_ok")
            upsert_batches(state, "rel_path", "at")(rows, number)

        def tell(number: int) -> None:
            now = upserted(spark, state, spark.createDataFrame([], schema).schema)
            write_markdown(now.groupBy("severity").agg(F.count(F.lit(1)).alias("files")).orderBy("severity"), f"Files by severity after batch {number}", f"{out}/STREAM.md")

        run_into(files, f"{out}/stream/checkpoint", report_every(every, tell, keep)).awaitTermination()
    finally:
        spark.streams.removeListener(log)
    return log.rows()


def progress(spark: SparkSession, out: str) -> DataFrame:
    """Documents in the ledger and answered by each stage."""
    ledger = latest(spark, f"{out}/ledger")
    counts = [("ledger", ledger.count() if ledger is not None else 0)]
    for name in ("first-pass", "second-pass", "placement", "rich-tags", "layers"):
        rows = stage_rows(spark, out, name)
        counts.append((name, rows.count() if rows is not None else 0))
    return spark.createDataFrame(counts, "step string, documents long")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="docloom", description="Review folders of documents and query their tables")
    commands = parser.add_subparsers(dest="command", required=True)
    step = commands.add_parser("review", help="review a folder into a ledger, through all stages")
    step.add_argument("intake")
    step.add_argument("--out", default="out")
    step.add_argument("--priors-only", action="store_true", help="scan only, ask no model")
    step.add_argument("--limit", type=int, help="ask each stage for so many documents at most")
    step.add_argument("--force", action="store_true", help="ask again for documents that have answers")
    for name, about in (("report", "write the reports again"), ("walk", "place the documents into a tree"), ("audit", "audit the tree"), ("maintain", "find child folders to combine"), ("census", "find names to combine"), ("progress", "how far each stage is"), ("plan-moves", "where delete candidates would be moved to")):
        commands.add_parser(name, help=about).add_argument("--out", default="out")
    for name, about in (("search", "ranked search of a folder"), ("stream", "review a folder as a stream"), ("spike", "open naming of a few documents")):
        step = commands.add_parser(name, help=about)
        step.add_argument("intake")
        step.add_argument("--out", default="out")
    step = commands.add_parser("compare", help="agreement of two runs")
    step.add_argument("left")
    step.add_argument("right")
    step.add_argument("--out", default="out")
    step = commands.add_parser("query", help="run a registered query over a folder of tables")
    step.add_argument("name")
    step.add_argument("tables")
    step.add_argument("--out", help="write parquet here instead of showing rows")
    commands.add_parser("list", help="names of the registered queries")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return
    spark = local_session("*")
    if given.command == "review":
        print(run(spark, given.intake, given.out, given.priors_only, given.limit, given.force))
    elif given.command == "query":
        result = catalog.queries()[given.name](spark, given.tables)
        result.write.parquet(given.out) if given.out else result.show(20, truncate=80)
    elif given.command in ("search", "spike", "stream"):
        out = {"search": find, "spike": spike, "stream": watch}[given.command](spark, given.intake, given.out)
        print(out) if isinstance(out, list) else out.show(20, truncate=80)
    elif given.command == "compare":
        compare(spark, given.left, given.right, given.out).show()
    elif given.command == "plan-moves":
        second = stage_rows(spark, given.out, "second-pass").where("recommendation = 'delete_candidate'").join(latest(spark, f"{given.out}/ledger").select("doc_id", "rel_path"), "doc_id")
        move_plan(second, "rel_path", "quarantine").show(20, truncate=80)
    else:
        out = {"report": report, "walk": walk, "audit": audit, "maintain": maintain, "census": census, "progress": progress}[given.command](spark, given.out)
        if isinstance(out, DataFrame):
            out.show(20, truncate=80)
        elif out is not None:
            print(out)


if __name__ == "__main__":
    main()
