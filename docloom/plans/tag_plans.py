"""Queries over tags: inventory, concepts, clusters, placement, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.modelio import capped_terms, clamp, closed_terms
from docloom.functions.terms import GENERIC_TOKENS, SAME_TOKENS, content_tokens, form_k, match_tokens
from docloom.operators.concepts import clusters, concept_pairs, concepts, inventory, place_leftovers
from docloom.operators.merge import last_write
from docloom.operators.tree import chains
from docloom.session import cut, table


def _current(spark: SparkSession, d: str) -> DataFrame:
    return last_write(table(spark, d, "tags").where("doc_id IS NOT NULL"), ["doc_id"], [F.col("stamped_at")])


def tag_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The 40 most frequent tags; of ties the one seen first, in the order of paths and within a document."""
    each = _current(spark, d).select("rel_path", "doc_id", F.posexplode("tags").alias("pos", "tag")).where(F.trim("tag") != "")
    counted = each.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rel_path", "doc_id", "pos")).alias("seen"))
    return counted.orderBy(F.desc("n"), "seen").limit(40).select("tag", "n")


def tag_inventory(spark: SparkSession, d: str) -> DataFrame:
    return inventory(_current(spark, d))


def prompt_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The 180 most frequent tags of at least two documents."""
    return inventory(_current(spark, d)).where("docs >= 2").orderBy(F.desc("docs"), "tag").limit(180)


def tags_per_document(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size(F.filter("tags", lambda t: F.trim(t) != "")), F.lit(0))
    return _current(spark, d).agg(F.count(F.lit(1)).alias("documents"), F.sum(n.cast("long")).alias("tags"), F.avg(n).alias("average"), F.max(n).cast("long").alias("most"))


def rich_tags(spark: SparkSession, d: str) -> DataFrame:
    """Term lists within their caps, confidence in bounds, and whether the row needs a look."""
    t = _current(spark, d).alias("t")
    capped = {"tags": 30, "entities": 20, "audiences": 12, "artifact_types": 12, "years": 8}
    cols = {c: capped_terms(F.col(f"t.{c}"), n) for c, n in capped.items()}
    c = clamp(F.nanvl("t.confidence", F.lit(None).cast("double")))
    review = F.coalesce("t.needs_review", F.lit(False)) | (c < 0.4) | (F.size(cols["tags"]) < 6) | (F.trim(F.coalesce("t.summary", F.lit(""))) == "")
    return t.select("t.doc_id", *[F.array_join(v, "|").alias(k) for k, v in cols.items()], c.alias("confidence"), review.alias("needs_review"))


def facet_terms(spark: SparkSession, d: str) -> DataFrame:
    """Audiences and kinds clamped to a closed vocabulary (the terms of at least 1 % of the rows)."""
    t = _current(spark, d)
    each = t.select(F.explode("audiences").alias("term")).where(F.trim("term") != "").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = t.count()
    # at most a hundred times the mean number of audiences
    allowed = [r["term"] for r in each.where(F.col("n") * 100 >= total).select("term").collect()]
    terms = F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>")
    return t.select("doc_id", F.array_join(closed_terms(F.coalesce("audiences", F.array().cast("array<string>")), terms), "|").alias("audiences"))


def facet_tallies(spark: SparkSession, d: str) -> DataFrame:
    """How often each term leads a facet."""
    t = _current(spark, d)
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.coalesce(F.try_element_at(F.col(f), F.lit(1)), F.lit("unmapped")).alias("term")) for f in ("audiences", "artifact_types", "years")])
    return t.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.term").agg(F.count(F.lit(1)).alias("documents"))


def token_sets(spark: SparkSession, d: str) -> DataFrame:
    each = inventory(_current(spark, d)).select("tag")
    return each.select("tag", F.array_join(content_tokens(F.col("tag")), " ").alias("content"), F.array_join(match_tokens(F.col("tag")), " ").alias("match"))


def tag_concepts(spark: SparkSession, d: str) -> DataFrame:
    named, _ = concepts(_current(spark, d))
    return named.select("concept_id", "preferred", F.array_join("aliases", "|").alias("aliases"), "docs").orderBy(F.desc("docs"), "preferred", "concept_id")


def tag_concept_pairs(spark: SparkSession, d: str) -> DataFrame:
    named, members = concepts(_current(spark, d))
    return concept_pairs(named, members)


def tag_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of concepts with their size, members and documents."""
    named, members = concepts(_current(spark, d))
    named, members = cut(named), cut(members)
    c = cut(clusters(named, concept_pairs(named, members)))
    docs = c.join(members, "concept_id").groupBy("seed").agg(F.countDistinct("doc_id").alias("docs"))
    shape = c.join(named, "concept_id").groupBy("seed").agg(F.count(F.lit(1)).alias("members"), F.sum(F.size("aliases").cast("long")).alias("aliases"))
    return shape.join(docs, "seed").orderBy(F.desc("docs"), "seed")


def _plan_tags(spark: SparkSession, d: str) -> DataFrame:
    """Region tree of the filing plan: its names as the tags of its folders."""
    return table(spark, d, "file_plan").select(F.col("plan_id").alias("region_id"), F.col("plan_name").alias("tag"), F.col("plan_id").alias("pos"))


def leftover_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags that are no folder's own, placed by common words or sent to review."""
    each = inventory(_current(spark, d)).select("tag")
    plan = _plan_tags(spark, d).withColumn("region_id", F.col("region_id").cast("string"))
    rest = each.join(plan.select("tag"), "tag", "left_anti")
    return place_leftovers(rest, plan)


def document_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of each document by its tags in order, with the top levels and the first tag that led to each."""
    plan = table(spark, d, "file_plan").select(F.col("plan_id").alias("id"), "parent_id", F.col("plan_name").alias("tag"))
    tops = chains(plan).select(F.col("tag").alias("_tag"), F.col("id").alias("region"), F.element_at("chain", 1).alias("top"))
    each = _current(spark, d).select("doc_id", F.posexplode("tags").alias("pos", "raw")).withColumn("_tag", form_k(F.col("raw")))
    hit = each.join(tops, "_tag").groupBy("doc_id", "region", "top").agg(F.min("pos").alias("pos"), F.min_by("raw", "pos").alias("raw"))
    ordered = lambda v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", v))), lambda x: x[v].cast("string")), "|")
    return hit.groupBy("doc_id").agg(ordered("region").alias("regions"), ordered("top").alias("tops"), ordered("raw").alias("matched"))


def tag_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many documents and tags the plan's folders reach."""
    t = _current(spark, d)
    names = table(spark, d, "file_plan").select(F.col("plan_name").alias("term"))
    each = t.select("doc_id", F.explode("tags").alias("raw")).select("doc_id", form_k(F.col("raw")).alias("term")).where("term <> ''")
    marked = each.join(names.withColumn("hit", F.lit(1)), "term", "left")
    return marked.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct(F.when(F.col("hit") == 1, F.col("doc_id"))).alias("placed"), F.count(F.lit(1)).alias("uses"), F.count("hit").alias("mapped_uses"))


def first_use(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each tag by stamp, then id (first row of each group)."""
    each = _current(spark, d).select("doc_id", "stamped_at", F.explode("tags").alias("raw")).select("doc_id", "stamped_at", form_k(F.col("raw")).alias("term")).where("term <> ''").distinct()
    w = Window.partitionBy("term").orderBy("stamped_at", "doc_id")
    return each.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("term", "doc_id", "stamped_at")


def exclusive_terms(spark: SparkSession, d: str) -> DataFrame:
    """For each document the tags that are not entities too, and those that are (set difference and intersection)."""
    k = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), form_k), lambda x: x != ""))
    return _current(spark, d).select("doc_id", F.array_join(F.array_sort(F.array_except(k("tags"), k("entities"))), "|").alias("only_tags"), F.array_join(F.array_sort(F.array_intersect(k("tags"), k("entities"))), "|").alias("in_both"), F.size(F.array_union(k("tags"), k("entities"))).cast("long").alias("any_terms"))


_CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stamped_at DESC NULLS LAST) AS rn FROM tags WHERE doc_id IS NOT NULL) WHERE rn = 1)"
_KF = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_EACH = f"WITH {_CUR}, each AS (SELECT DISTINCT doc_id, tag FROM (SELECT doc_id, unnest(tags) AS tag FROM cur) WHERE trim(tag) <> '')"
_INV = _EACH + ", inv AS (SELECT tag, count(*) AS docs FROM each GROUP BY 1)"
_GEN = ", ".join(f"'{g}'" for g in GENERIC_TOKENS)
_SAME = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SAME_TOKENS.items())
_LABEL = _KF.format("tag")


def _content(tag: str = "tag") -> str:
    label = _KF.format(tag)
    words = f"list_sort(list_distinct(list_transform(list_filter(string_split({label}, '-'), lambda w: length(w) > 2 AND w NOT IN ({_GEN}) AND NOT regexp_matches(w, '^\\d+$')), lambda w: CASE w {_SAME} ELSE w END)))"
    return f"CASE WHEN len({words}) > 0 THEN array_to_string({words}, ' ') WHEN {label} <> '' THEN {label} ELSE {tag} END"


_MATCH = f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(tag, '')), '[-_/\\s]+'), lambda w: length(w) > 2 AND w NOT IN ({_GEN}) AND NOT regexp_matches(w, '^\\d+$'))))"
_CONCEPTS = f"""{_EACH}, c AS (SELECT doc_id, tag, {_content()} AS concept_id FROM each),
counts AS (SELECT concept_id, tag, count(*) AS n FROM c GROUP BY ALL),
heads AS (SELECT concept_id, tag AS head, row_number() OVER (PARTITION BY concept_id ORDER BY n DESC, length(tag), tag DESC) AS rn FROM counts),
al AS (SELECT concept_id, string_agg(tag, '|' ORDER BY n DESC, tag) AS aliases FROM counts GROUP BY 1),
sized AS (SELECT concept_id, count(DISTINCT doc_id) AS docs FROM c GROUP BY 1),
named AS (SELECT s.concept_id, coalesce(nullif({_KF.format('head')}, ''), head) AS preferred, aliases, docs FROM sized s JOIN al ON al.concept_id = s.concept_id JOIN heads h ON h.concept_id = s.concept_id AND h.rn = 1)"""


def _capped(col: str, n: int) -> str:
    clean = f"list_filter(list_transform(coalesce({col}, []), lambda v: trim(v)), lambda v: v IS NOT NULL AND v <> '')"
    return f"array_to_string(list_filter({clean}, lambda v, i: list_position(list_transform({clean}, lambda y: lower(y)), lower(v)) = i)[1:{n}], '|') AS {col}"


def queries() -> dict:
    names = "tag_histogram tag_inventory prompt_inventory tags_per_document rich_tags facet_terms facet_tallies token_sets tag_concepts tag_concept_pairs tag_clusters leftover_tags document_regions tag_coverage first_use exclusive_terms"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    tags30 = _capped("tags", 30).rsplit(" AS ", 1)[0]
    return {
        "tag_histogram": f"WITH {_CUR} SELECT tag, n FROM (SELECT tag, count(*) AS n, min({{'p': rel_path, 'd': doc_id, 'i': i}}) AS seen FROM (SELECT rel_path, doc_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM cur) WHERE trim(tag) <> '' GROUP BY 1) ORDER BY n DESC, seen LIMIT 40",
        "tag_inventory": _INV + " SELECT tag, docs FROM inv",
        "prompt_inventory": _INV + " SELECT tag, docs FROM inv WHERE docs >= 2 ORDER BY docs DESC, tag LIMIT 180",
        "tags_per_document": f"WITH {_CUR}, n AS (SELECT coalesce(len(list_filter(tags, lambda t: trim(t) <> '')), 0) AS n FROM cur) SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS tags, avg(n) AS average, max(n) AS most FROM n",
        "rich_tags": f"""WITH {_CUR}, v AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE confidence END)) AS c FROM cur)
 SELECT doc_id, {', '.join(_capped(c, n) for c, n in (("tags", 30), ("entities", 20), ("audiences", 12), ("artifact_types", 12), ("years", 8)))}, c AS confidence,
 coalesce(needs_review, false) OR c < 0.4 OR len(string_split({tags30}, '|')) < 6 OR trim(coalesce(summary, '')) = '' AS needs_review FROM v""",
        "facet_terms": f"""WITH {_CUR}, e AS (SELECT unnest(audiences) AS term FROM cur), a AS (SELECT list(term) AS allowed FROM (SELECT term, count(*) AS n FROM e WHERE trim(term) <> '' GROUP BY 1) WHERE n * 100 >= (SELECT count(*) FROM cur)),
 p AS (SELECT doc_id, list_filter(coalesce(audiences, []), lambda x: list_contains(allowed, x)) AS k FROM cur, a),
 u AS (SELECT doc_id, list_filter(k, lambda x, i: list_position(k, x) = i)[1:2] AS k FROM p) SELECT doc_id, CASE WHEN len(k) > 0 THEN array_to_string(k, '|') ELSE 'unmapped' END AS audiences FROM u""",
        "facet_tallies": f"WITH {_CUR} " + " UNION ALL ".join(f"SELECT '{f}' AS facet, coalesce({f}[1], 'unmapped') AS term, count(*) AS documents FROM cur GROUP BY 2" for f in ("audiences", "artifact_types", "years")),
        "token_sets": _INV + f" SELECT tag, {_content()} AS content, array_to_string({_MATCH}, ' ') AS match FROM inv",
        "tag_concepts": _CONCEPTS + " SELECT concept_id, preferred, aliases, docs FROM named",
        "tag_concept_pairs": _CONCEPTS
        + f""", w AS (SELECT concept_id, unnest(string_split({_content('preferred')}, ' ')) AS word FROM named), m AS (SELECT DISTINCT concept_id, doc_id FROM c),
 k AS (SELECT DISTINCT x.concept_id AS a, y.concept_id AS b FROM w x JOIN w y ON x.word = y.word AND x.concept_id < y.concept_id),
 s AS (SELECT k.a, k.b, count(*) AS shared FROM k JOIN m ma ON ma.concept_id = k.a JOIN m mb ON mb.concept_id = k.b AND mb.doc_id = ma.doc_id GROUP BY 1, 2)
 SELECT s.a, s.b, shared, shared / (na.docs + nb.docs - shared) AS jaccard FROM s JOIN named na ON na.concept_id = s.a JOIN named nb ON nb.concept_id = s.b WHERE shared >= 2 AND shared / (na.docs + nb.docs - shared) >= 0.25""",
        "leftover_tags": _INV
        + f""", l AS (SELECT tag, {_MATCH} AS w FROM inv WHERE tag NOT IN (SELECT plan_name FROM file_plan)), p AS (SELECT plan_id, {_MATCH} AS w FROM (SELECT plan_id, plan_name AS tag FROM file_plan)),
 lw AS (SELECT tag, len(w) AS n, unnest(w) AS word FROM l), pw AS (SELECT plan_id, len(w) AS n, unnest(w) AS word FROM p),
 h AS (SELECT lw.tag, pw.plan_id, count(*) / least(any_value(lw.n), any_value(pw.n)) AS score FROM lw JOIN pw ON lw.word = pw.word GROUP BY 1, 2),
 b AS (SELECT tag, plan_id, score, row_number() OVER (PARTITION BY tag ORDER BY score DESC, plan_id) AS rn FROM h)
 SELECT l.tag, CASE WHEN score >= 0.5 THEN CAST(plan_id AS VARCHAR) ELSE 'needs-review' END AS region_id, coalesce(score, 0.0) AS score FROM l LEFT JOIN b ON b.tag = l.tag AND rn = 1""",
        "document_regions": f"""WITH RECURSIVE {_CUR}, up AS (SELECT plan_id AS region, plan_name, plan_id AS top, parent_id FROM file_plan UNION ALL SELECT region, up.plan_name, f.plan_id, f.parent_id FROM up JOIN file_plan f ON f.plan_id = up.parent_id),
 tops AS (SELECT region, plan_name, top FROM up WHERE parent_id IS NULL),
 e AS (SELECT doc_id, unnest(tags) AS raw, generate_subscripts(tags, 1) AS pos FROM cur), h AS (SELECT doc_id, region, top, min(pos) AS pos, arg_min(raw, pos) AS raw FROM e JOIN tops ON {_KF.format('raw')} = plan_name GROUP BY 1, 2, 3)
 SELECT doc_id, string_agg(region, '|' ORDER BY pos) AS regions, string_agg(top, '|' ORDER BY pos) AS tops, string_agg(raw, '|' ORDER BY pos) AS matched FROM h GROUP BY 1""",
        "tag_coverage": f"""WITH {_CUR}, e AS (SELECT doc_id, {_KF.format('raw')} AS term FROM (SELECT doc_id, unnest(tags) AS raw FROM cur)), m AS (SELECT doc_id, plan_id FROM e LEFT JOIN file_plan ON plan_name = term WHERE term <> '')
 SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT CASE WHEN plan_id IS NOT NULL THEN doc_id END) AS placed, count(*) AS uses, count(plan_id) AS mapped_uses FROM m""",
        "first_use": f"""WITH {_CUR}, e AS (SELECT DISTINCT doc_id, stamped_at, {_KF.format('raw')} AS term FROM (SELECT doc_id, stamped_at, unnest(tags) AS raw FROM cur))
 SELECT term, doc_id, stamped_at FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY stamped_at NULLS FIRST, doc_id) AS rn FROM e WHERE term <> '') WHERE rn = 1""",
        "exclusive_terms": f"""WITH {_CUR}, k AS (SELECT doc_id, list_distinct(list_filter(list_transform(coalesce(tags, []), lambda v: {_KF.format('v')}), lambda v: v <> '')) AS a, list_distinct(list_filter(list_transform(coalesce(entities, []), lambda v: {_KF.format('v')}), lambda v: v <> '')) AS b FROM cur)
 SELECT doc_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|') AS only_tags, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), '|') AS in_both, len(list_distinct(list_concat(a, b))) AS any_terms FROM k""",
    }
