"""Queries of audits and maps, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.coercion import EMPTY_PHRASES, child_choice, closed_main, layers, looks_empty, main_choice, short_label, valid_folder
from docloom.functions.terms import CHANNELS, VAGUE, YEAR_ONLY, form_k
from docloom.operators.audit import apply_verdicts, flag_rates, mixed_groups, whole_verdicts
from docloom.operators.versions import current_rows
from docloom.operators.mapping import fattest_roots, remap, spread_in_clusters, tag_regions
from docloom.plans.layer_plans import _PRIMARY, _layers, audit_groups, primary_regions
from docloom.session import table

_WORDS = {"reuse": "confirm", "invent": "wrong-parent", "combine": "merge"}


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts as a second clerk gives them: the last walk action of each path, and the main named there."""
    walk = table(spark, d, "walk_home").where("rel_path IS NOT NULL").groupBy("rel_path").agg(F.max_by(F.struct("walk_action", "main"), "walk_id").alias("w"))
    words = F.create_map(*[F.lit(x) for p in _WORDS.items() for x in p])
    named = walk.select("rel_path", F.try_element_at(words, F.col("w.walk_action")).alias("verdict"), form_k(F.coalesce("w.main", F.lit(""))).alias("name"))
    plan = table(spark, d, "file_plan").select(F.col("plan_id").cast("string").alias("better_home"), F.col("plan_name").alias("name"))
    groups = audit_groups(spark, d).select("rel_path", "chunk_id")
    return named.join(plan, "name", "left").join(groups, "rel_path").select("chunk_id", "rel_path", "verdict", "better_home").where("verdict IS NOT NULL")


def audit_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return whole_verdicts(audit_groups(spark, d), _verdicts(spark, d))


def audit_flag_rates(spark: SparkSession, d: str) -> DataFrame:
    return flag_rates(audit_verdicts(spark, d), ["chunk_id"])


def audit_applied(spark: SparkSession, d: str) -> DataFrame:
    homes = primary_regions(spark, d).select("rel_path", F.array(F.col("region_id").cast("string")).alias("region_ids"))
    nodes = table(spark, d, "file_plan").select(F.col("plan_id").cast("string").alias("id"))
    return apply_verdicts(homes, audit_verdicts(spark, d), nodes).select("rel_path", F.array_join("region_ids", "|").alias("regions"), "applied")


def audit_mixed_groups(spark: SparkSession, d: str) -> DataFrame:
    return mixed_groups(audit_verdicts(spark, d), ["14"])


def tag_region_map(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the plan's folders (name, title in form K) with synonyms given as pairs of folder words."""
    plan = table(spark, d, "file_plan")
    nodes = plan.select(F.col("plan_id").alias("region_id"), F.col("plan_id").alias("pos"), F.array_distinct(F.array("plan_name", form_k(F.col("title")))).alias("tags"))
    synonyms = plan.where(F.col("plan_name").contains("-")).select(F.col("plan_name").alias("preferred"), F.split_part("plan_name", F.lit("-"), F.lit(1)).alias("alias"))
    return tag_regions(nodes, synonyms)


def cluster_regions(spark: SparkSession, d: str) -> DataFrame:
    """Walk names spread over the siblings of a plan branch: unmapped names take the region of the branch's first mapped one."""
    plan = table(spark, d, "file_plan")
    members = plan.select(F.coalesce("parent_id", "plan_id").alias("cluster"), F.col("plan_id").alias("pos"), F.col("plan_name").alias("tag"))
    mapped = plan.where("plan_level = 3").select(F.col("plan_name").alias("tag"), F.col("plan_id").alias("region_id"))
    return spread_in_clusters(mapped, members)


def remapped_mains(spark: SparkSession, d: str) -> DataFrame:
    rows = _layers(spark, d).select("doc_id", form_k(F.coalesce("main", F.lit(""))).alias("main"))
    groups = spark.createDataFrame([("outings", "travel"), ("vehicles", "travel"), ("first-aid", "safety")], "name string, into string")
    return remap(rows, "main", groups)


def root_sources(spark: SparkSession, d: str) -> DataFrame:
    return fattest_roots(remapped_mains(spark, d).withColumn("source", F.coalesce("main_from", "main")), "main", "source")


_ALIASES = {"repairs": "premises", "payslips": "staffing", "lodging": "vehicles", "nowhere": "no-such-main"}
_MAINS = ("staffing", "field-work", "budget", "contracts", "systems", "premises", "vehicles", "safety", "outreach", "learning", "clients", "wellbeing", "governance", "private")


def closed_mains(spark: SparkSession, d: str) -> DataFrame:
    """Filed mains brought into the first level of the plan."""
    return _layers(spark, d).select("doc_id", closed_main(F.col("main"), list(_MAINS), _ALIASES).alias("main"))


def layer_lists(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d).select("doc_id", F.array_join(layers(F.col("main"), F.col("sub"), F.col("detail")), "/").alias("layers"))


def folder_names(spark: SparkSession, d: str) -> DataFrame:
    """Which tags could become folders beside the plan's, and their labels."""
    tags = table(spark, d, "tags").select(F.explode("tags").alias("raw")).select(form_k(F.col("raw")).alias("tag")).where("tag <> ''").distinct()
    return tags.select("tag", valid_folder(F.col("tag"), list(_MAINS)).alias("valid"), short_label(F.col("tag")).alias("label"))


def empty_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extract_record").select("extract_id", looks_empty(F.col("text")).alias("looks_empty"))


def walk_choices(spark: SparkSession, d: str) -> DataFrame:
    """Typed walk steps made safe against the folders of the plan's first level."""
    w = table(spark, d, "walk_home")
    siblings = F.array(*map(F.lit, _MAINS))
    c = child_choice(F.col("walk_action"), F.try_element_at("home", F.lit(1)), F.transform("home", form_k), siblings, [])
    return w.select("walk_id", c["action"].alias("action"), c["name"].alias("name"), F.array_join(c["merge"], "|").alias("merge"))


def main_choices(spark: SparkSession, d: str) -> DataFrame:
    """The filed main of each extraction, made safe against the plan's first level and the text."""
    e = table(spark, d, "extract_record").select("extract_id", "doc_id", "text")
    filed = current_rows(table(spark, d, "layer_record"), ["main", "reasoning"])
    c = main_choice(F.col("main"), F.col("reasoning"), F.col("text"), list(_MAINS))
    return e.join(filed, "doc_id", "left").select("extract_id", c["main"].alias("main"), c["reason"].alias("reason"))


def sample_roster(spark: SparkSession, d: str) -> DataFrame:
    """The first 28 documents with their first 18 tags: the sample shown to a model (top-k report)."""
    t = table(spark, d, "tags").groupBy("doc_id").agg(F.max_by(F.struct("rel_path", "tags"), "stamped_at").alias("r"))
    return t.select("doc_id", "r.rel_path", F.array_join(F.slice("r.tags", 1, 18), ", ").alias("tags")).orderBy("rel_path", "doc_id").limit(28)


_V = (
    _PRIMARY
    + """, grp AS (SELECT rel_path, CAST(region_id AS VARCHAR) AS region, row_number() OVER (PARTITION BY region_id ORDER BY rel_path) - 1 AS k FROM prim),
 plan AS (SELECT rel_path, region, region || '#' || CASE WHEN k // 12 + 1 < 100 THEN lpad(CAST(k // 12 + 1 AS VARCHAR), 2, '0') ELSE CAST(k // 12 + 1 AS VARCHAR) END AS chunk_id FROM grp),
 last AS (SELECT rel_path, arg_max({'a': walk_action, 'm': main}, walk_id) AS x FROM walk_home WHERE rel_path IS NOT NULL GROUP BY 1),
 said AS (SELECT rel_path, CASE x.a WHEN 'reuse' THEN 'confirm' WHEN 'invent' THEN 'wrong-parent' WHEN 'combine' THEN 'merge' END AS verdict, CAST(plan_id AS VARCHAR) AS better_home
  FROM last LEFT JOIN file_plan ON plan_name = regexp_replace(regexp_replace(lower(coalesce(x.m, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')),
 ver AS (SELECT p.chunk_id, p.rel_path, coalesce(s.verdict, 'cannot-tell') AS verdict, CASE WHEN s.verdict IS NOT NULL THEN better_home END AS better_home FROM plan p LEFT JOIN said s ON s.rel_path = p.rel_path)"""
)
_MAIN = "regexp_replace(regexp_replace(lower(coalesce(main, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_REMAP = f"""WITH cur AS (SELECT doc_id, {_MAIN} AS m FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stamped_at DESC NULLS LAST) AS rn FROM layer_record WHERE doc_id IS NOT NULL) WHERE rn = 1),
r AS (SELECT doc_id, CASE WHEN m IN ('outings', 'vehicles') THEN 'travel' WHEN m = 'first-aid' THEN 'safety' ELSE m END AS main, CASE WHEN m IN ('outings', 'vehicles', 'first-aid') THEN m END AS main_from FROM cur)"""


def queries() -> dict:
    names = "audit_verdicts audit_flag_rates audit_applied audit_mixed_groups tag_region_map cluster_regions remapped_mains root_sources closed_mains layer_lists folder_names empty_texts walk_choices main_choices sample_roster"
    return {n: globals()[n] for n in names.split()}


_K0 = "regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _kebab(x: str) -> str:
    return f"left({_K0.format(x)}, 48)"


def _banned(slug: str) -> str:
    blob = f"replace({slug} || ' ' || {slug}, '-', ' ')"
    return f"(regexp_matches(trim({blob}), '{CHANNELS}') OR len(list_filter(regexp_split_to_array(lower(trim({blob})), '\\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '{YEAR_ONLY}'))) = 0)"


_CURL = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stamped_at DESC NULLS LAST) AS rn FROM layer_record WHERE doc_id IS NOT NULL) WHERE rn = 1)"
_IN = ", ".join(f"'{m}'" for m in _MAINS)


def oracle_sql() -> dict[str, str]:
    alias = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _ALIASES.items() if b in _MAINS)
    valid = lambda n, taken: f"({n} <> '' AND {n} NOT IN ({taken}) AND NOT {_banned(n)} AND NOT regexp_matches({n}, '{VAGUE}'))"
    phrases = " OR ".join(f"contains(lower(b), '{p}')" for p in ("no content", "no text", "empty document", "cannot determine", "blank page", "unreadable"))
    title = "array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(replace(tag, '-', ' '), '\\b(?:19|20)\\d\\d\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
    return {
        "closed_mains": f"WITH {_CURL}, k AS (SELECT doc_id, {_kebab('main')} AS m FROM cur) SELECT doc_id, CASE WHEN m IN ('', 'unmapped') OR {_banned('m')} THEN '' WHEN m IN ({_IN}) THEN m ELSE CASE m {alias} ELSE '' END END AS main FROM k",
        "layer_lists": f"""WITH {_CURL}, k AS (SELECT doc_id, {_kebab('main')} AS m, {_kebab('sub')} AS s, {_kebab('detail')} AS e FROM cur),
 o AS (SELECT *, s = '' OR NOT {_banned('s')} AS ok FROM k), p AS (SELECT doc_id, m, list_filter([m, CASE WHEN ok THEN s ELSE '' END, CASE WHEN ok AND NOT {_banned('e')} THEN e ELSE '' END], lambda x: x <> '') AS a FROM o)
 SELECT doc_id, CASE WHEN m = '' THEN '' ELSE array_to_string(list_filter(a, lambda x, i: i = 1 OR x <> a[i - 1]), '/') END AS layers FROM p""",
        "folder_names": f"""WITH t AS (SELECT DISTINCT {_K0.format('raw')} AS tag FROM (SELECT unnest(tags) AS raw FROM tags WHERE tags IS NOT NULL) WHERE raw IS NOT NULL), u AS (SELECT tag, left(tag, 48) AS n, {title} AS title FROM t WHERE tag <> '')
 SELECT tag, {valid('n', _IN + ", 'unmapped'")} AS valid, CASE WHEN length(title) <= 26 THEN title WHEN regexp_extract(title, '^(.{{1,26}})(?:\\s|$)', 1) <> '' THEN regexp_extract(title, '^(.{{1,26}})(?:\\s|$)', 1) ELSE left(title, 26) END AS label FROM u""",
        "empty_texts": f"WITH t AS (SELECT extract_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS b FROM extract_record) SELECT extract_id, length(b) < 40 OR {phrases} AS looks_empty FROM t",
        "main_choices": rf"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stamped_at DESC NULLS LAST) AS rn FROM layer_record WHERE doc_id IS NOT NULL) WHERE rn = 1),
 t AS (SELECT extract_id, regexp_replace(coalesce(text, ''), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g') AS bare, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS body, coalesce(reasoning, '') AS reason, {_kebab('main')} AS m FROM extract_record e LEFT JOIN l ON l.doc_id = e.doc_id),
 c AS (SELECT *, length(body) < 40 OR {" OR ".join(f"contains(lower(reason || ' ' || body), '{p}')" for p in EMPTY_PHRASES)} AS looks_empty FROM t)
 SELECT extract_id, CASE WHEN bare = '' THEN '' WHEN m = 'unmapped' AND looks_empty THEN 'unmapped' WHEN m IN ({_IN}) THEN m ELSE '' END AS main,
 CASE WHEN bare = '' THEN 'extract missing' WHEN (m = 'unmapped' AND looks_empty) OR m IN ({_IN}) THEN reason ELSE '' END AS reason FROM c""",
        "walk_choices": f"""WITH w AS (SELECT walk_id, lower(coalesce(walk_action, '')) AS act, {_kebab('home[1]')} AS n, list_filter(list_transform(coalesce(home, []), lambda v: {_K0.format('v')}), lambda v: v IN ({_IN})) AS k FROM walk_home),
 u AS (SELECT *, list_filter(k, lambda x, i: list_position(k, x) = i) AS m, {valid('n', "'unmapped'")} AS free FROM w),
 c AS (SELECT walk_id, n, m, CASE WHEN act = 'combine' AND len(m) >= 2 AND free THEN 'combine' WHEN act IN ('reuse', 'invent', '') AND n IN ({_IN}) THEN 'reuse' WHEN act IN ('reuse', 'invent', '') AND free THEN 'invent' ELSE 'empty' END AS action FROM u)
 SELECT walk_id, action, CASE WHEN action = 'empty' THEN '' ELSE n END AS name, CASE WHEN action = 'combine' THEN array_to_string(m, '|') ELSE '' END AS merge FROM c""",
        "sample_roster": "WITH t AS (SELECT doc_id, rel_path, tags FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stamped_at DESC NULLS LAST) AS rn FROM tags) WHERE rn = 1) SELECT doc_id, rel_path, array_to_string(tags[1:18], ', ') AS tags FROM t ORDER BY rel_path, doc_id LIMIT 28",
        "audit_verdicts": _V + " SELECT * FROM ver",
        "audit_flag_rates": _V + " SELECT chunk_id, count(*) AS files, CAST(count_if(verdict <> 'confirm') AS BIGINT) AS flags, count_if(verdict <> 'confirm') / count(*) AS rate FROM ver GROUP BY 1",
        "audit_applied": _V + """ SELECT p.rel_path, CASE WHEN verdict = 'wrong-parent' AND better_home IS NOT NULL AND better_home <> CAST(region_id AS VARCHAR) THEN better_home || '|' || region_id ELSE CAST(region_id AS VARCHAR) END AS regions,
 CASE WHEN verdict = 'wrong-parent' AND better_home IS NOT NULL THEN 'moved' ELSE 'kept' END AS applied FROM prim p JOIN ver v ON v.rel_path = p.rel_path""",
        "audit_mixed_groups": _V + " SELECT split_part(chunk_id, '#', 1) AS region, count(*) AS wrong FROM ver WHERE verdict = 'wrong-parent' AND split_part(chunk_id, '#', 1) <> '14' GROUP BY 1",
        "tag_region_map": """WITH own AS (SELECT tag, min(plan_id) AS region_id FROM (SELECT plan_name AS tag, plan_id FROM file_plan UNION ALL SELECT regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), plan_id FROM file_plan) GROUP BY 1),
 lent AS (SELECT split_part(plan_name, '-', 1) AS tag, min(region_id) AS region_id FROM file_plan JOIN own ON own.tag = plan_name WHERE contains(plan_name, '-') GROUP BY 1)
 SELECT * FROM own UNION ALL SELECT * FROM lent WHERE tag NOT IN (SELECT tag FROM own)""",
        "cluster_regions": """WITH f AS (SELECT coalesce(parent_id, plan_id) AS cluster, min(plan_id) AS region_id FROM file_plan WHERE plan_level = 3 GROUP BY 1)
 SELECT plan_name AS tag, plan_id AS region_id FROM file_plan WHERE plan_level = 3 UNION ALL SELECT plan_name, f.region_id FROM file_plan JOIN f ON f.cluster = coalesce(parent_id, plan_id) WHERE plan_level <> 3""",
        "remapped_mains": _REMAP + " SELECT doc_id, main, main_from FROM r",
        "root_sources": _REMAP + " SELECT main, count(DISTINCT coalesce(main_from, main)) AS sources, count(*) AS files FROM r GROUP BY 1",
    }
