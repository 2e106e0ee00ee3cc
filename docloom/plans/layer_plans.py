"""Queries over filings: layers, homes, folder trees, audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.terms import CHANNELS, VAGUE, YEAR_ONLY, form_k, human_label, is_banned_head, is_vague, kebab, node_id
from docloom.operators.chunking import group_chunks
from docloom.operators.fold import rehome, rehome_log, walk_fold
from docloom.operators.merge import last_write
from docloom.operators.graph import browse_graph
from docloom.operators.tree import FAT_MIN, chains, collapse_homes, depth_first, findings, fold_small_children, folder_segments, nearest_kept, prefix_counts, prefixes, primary_region, regions_of, revise, second_parents, sunburst, topic_pairs, with_unmapped
from docloom.session import table


def _layers(spark: SparkSession, d: str) -> DataFrame:
    return last_write(table(spark, d, "layer_record").where("doc_id IS NOT NULL"), ["doc_id"], [F.col("stamped_at")])


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d).select("doc_id", "rel_path", folder_segments(F.col("main"), F.col("sub"), F.col("detail")).alias("path"))


def _homes(spark: SparkSession, d: str) -> DataFrame:
    return collapse_homes(_segments(spark, d), "doc_id")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_plan").select(F.col("plan_id").alias("id"), "parent_id", F.col("plan_name").alias("name"), F.col("title").alias("label"), F.col("plan_level").alias("depth"))


def _walk_regions(spark: SparkSession, d: str) -> DataFrame:
    """(rel_path, region_id): every plan folder named in the last walk of a path, null where none is."""
    walk = last_write(table(spark, d, "walk_home").where("rel_path IS NOT NULL"), ["rel_path"], [F.col("stamped_at"), F.col("walk_id")])
    each = walk.select("rel_path", F.explode_outer("home").alias("raw")).select("rel_path", form_k(F.coalesce("raw", F.lit(""))).alias("name"))
    plan = table(spark, d, "file_plan").select(F.col("plan_id").alias("region_id"), F.col("plan_name").alias("name"))
    hit = each.join(plan, "name", "left").groupBy("rel_path", "region_id").agg(F.lit(1).alias("_one")).select("rel_path", "region_id")
    named = hit.where("region_id IS NOT NULL")
    none = hit.where("region_id IS NULL").join(named.select("rel_path").distinct(), "rel_path", "left_anti")
    return named.unionAll(none)


def folder_paths(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    return s.select("doc_id", F.array_join(F.slice("path", 1, 3), "/").alias("path"), node_id(F.slice("path", 1, 3)).alias("node"), human_label(F.element_at("path", -1)).alias("label"))


def head_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which main folders are channels, years or vague words."""
    mains = _layers(spark, d).select(kebab(F.col("main")).alias("main")).where("main <> ''").distinct()
    odd = mains.unionAll(table(spark, d, "documents").select(kebab(F.element_at(F.split("rel_path", "/"), 1)).alias("main")).distinct())
    return odd.distinct().select("main", is_banned_head(F.col("main")).alias("banned"), is_vague(F.col("main")).alias("vague"))


def folder_counts(spark: SparkSession, d: str) -> DataFrame:
    return prefix_counts(_segments(spark, d)).select(F.array_join("prefix", "/").alias("prefix"), "n")


def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows by main and sub with subtotals (rollup); level 0 is the total."""
    rows = _layers(spark, d).select(kebab(F.col("main")).alias("main"), kebab(F.col("sub")).alias("sub"))
    out = rows.rollup("main", "sub").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, 0).when(F.col("g") == 1, 1).otherwise(2)
    return out.select(F.coalesce("main", F.lit("*")).alias("main"), F.coalesce("sub", F.lit("*")).alias("sub"), level.alias("level"), "n")


def collapsed_homes(spark: SparkSession, d: str) -> DataFrame:
    return _homes(spark, d).select("doc_id", F.array_join("home", "/").alias("home"))


def browse_regions(spark: SparkSession, d: str) -> DataFrame:
    return regions_of(_homes(spark, d))


def walk_regions(spark: SparkSession, d: str) -> DataFrame:
    """Folders of the paths as they are, however few documents they hold."""
    return regions_of(_segments(spark, d), "path")


def home_metrics(spark: SparkSession, d: str) -> DataFrame:
    h = _homes(spark, d)
    return h.agg(F.count(F.lit(1)).alias("documents"), F.avg(F.size("home")).alias("depth_mean"), F.count_if(F.element_at("home", 1) == "unmapped").alias("unmapped"), F.countDistinct("home").alias("homes_used"))


def main_counts(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d).groupBy(kebab(F.col("main")).alias("main")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(kebab(F.col("sub"))).alias("subs"))


def child_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).where(F.size("path") > 1)
    return s.groupBy(F.element_at("path", 1).alias("parent"), F.element_at("path", 2).alias("child")).agg(F.count(F.lit(1)).alias("n"))


def busy_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders below the roots with enough files and at least two children: worth a look at merging."""
    rows = prefix_counts(_segments(spark, d))
    kids = rows.where(F.size("prefix") > 1).groupBy(F.slice("prefix", 1, F.size("prefix") - 1).alias("prefix")).agg(F.count(F.lit(1)).alias("children"))
    return rows.join(kids, "prefix").where((F.col("n") >= FAT_MIN) & (F.col("children") >= 2)).select(F.array_join("prefix", "/").alias("folder"), "n", "children")


def plan_chains(spark: SparkSession, d: str) -> DataFrame:
    """Breadcrumbs of each folder of the plan."""
    p = _plan(spark, d)
    names = p.select(F.col("id").alias("_i"), "name")
    c = chains(p).select("id", F.posexplode("chain").alias("pos", "_i")).join(names, "_i")
    return c.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "/").alias("crumbs"), F.count(F.lit(1)).alias("depth"))


def plan_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of each folder in the depth-first listing by label; the private branch counts as a bin and comes last."""
    bins = [14]
    ordered = depth_first(_plan(spark, d).drop("depth"), "label", bins)
    from pyspark.sql.window import Window

    # one row for each folder of the fixed plan
    return ordered.select("id", "depth", F.row_number().over(Window.orderBy("path_key")).cast("long").alias("place"))


def plan_without_banned(spark: SparkSession, d: str) -> DataFrame:
    """The plan with every second-level folder of several words taken out and its children hung higher."""
    p = _plan(spark, d)
    return nearest_kept(p, (F.col("depth") == 2) & F.col("name").contains("-")).select("id", "parent_id")


def tree_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings(_plan(spark, d), _walk_regions(spark, d))


def primary_regions(spark: SparkSession, d: str) -> DataFrame:
    return primary_region(_walk_regions(spark, d).where("region_id IS NOT NULL"), _plan(spark, d), [14])


#: Subjects that people look for and the plan has no broad folder for: (id, label, words). A parameter.
FAMILIES = (("kiosk-desk", "Kiosk desk", ("kiosk",)), ("chargers", "Chargers", ("charger",)), ("grant-office", "Grant office", ("grant", "grants")))


def browse_topics(spark: SparkSession, d: str) -> DataFrame:
    """The browse graph of the plan's two upper levels: topics, subtopics with up to two parents, and their documents."""
    plan = table(spark, d, "file_plan").where("plan_level < 3")
    names = plan.select(F.col("plan_id").alias("parent_id"), F.col("plan_name").alias("parent"))
    nodes = plan.join(names, "parent_id", "left").select(F.col("plan_name").alias("id"), F.col("parent").alias("parent_id"), F.col("title").alias("label"))
    found = _walk_regions(spark, d).join(plan.select(F.col("plan_id").alias("region_id"), F.col("plan_name").alias("id")), "region_id")
    tags = table(spark, d, "tags").where("rel_path IS NOT NULL").select(F.col("rel_path").alias("doc"), F.explode("tags").alias("tag")).where(F.trim("tag") != "")
    families = spark.createDataFrame([(i, n, list(w)) for i, n, w in FAMILIES], "id string, label string, words array<string>")
    graph = browse_graph(nodes, found.select("id", F.col("rel_path").alias("doc")), tags, families)
    return graph.select("id", "label", "kind", F.array_join("broader", "|").alias("broader"), "docs")


def audit_groups(spark: SparkSession, d: str) -> DataFrame:
    """Files of each primary region in chunks of twelve."""
    p = primary_regions(spark, d).withColumn("region", F.col("region_id").cast("string"))
    return group_chunks(p, "region", ["rel_path"]).select("rel_path", "region", "chunk_id", "place")


def folded_children(spark: SparkSession, d: str) -> DataFrame:
    return fold_small_children(_plan(spark, d), primary_regions(spark, d)).select("rel_path", "region_id")


def browse_sunburst(spark: SparkSession, d: str) -> DataFrame:
    return sunburst(_homes(spark, d))


def shared_parents(spark: SparkSession, d: str) -> DataFrame:
    """Second parents of sub folders: other mains that hold enough of the same owners."""
    s = _layers(spark, d).select(kebab(F.col("main")).alias("main"), kebab(F.col("sub")).alias("sub"), "owner_id").where("main <> '' AND sub <> ''")
    members = s.select(F.col("main").alias("id"), F.col("owner_id").alias("doc")).unionAll(s.select(F.concat_ws("/", "main", "sub").alias("id"), F.col("owner_id").alias("doc"))).distinct()
    nodes = s.select(F.concat_ws("/", "main", "sub").alias("id"), F.col("main").alias("topic_id")).distinct()
    return second_parents(members, s.select(F.col("main").alias("id")).distinct(), nodes)


def topic_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Main folders whose documents belong to the same owners."""
    s = _layers(spark, d).select(kebab(F.col("main")).alias("id"), F.col("owner_id").alias("doc")).where("id <> '' AND doc IS NOT NULL")
    return topic_pairs(s, 3)


def revised_plan(spark: SparkSession, d: str) -> DataFrame:
    """The plan after a few revisions: one folder renamed, one split, one dissolved; with the unmapped folder."""
    changes = spark.createDataFrame([(2, "rename", "On site", None), (8, "split", None, ["Fire and smoke", "Ladders"]), (14, "dissolve", None, None), (15, "keep", None, None)], "id int, action string, label string, parts array<string>")
    nodes, _ = revise(_plan(spark, d), changes)
    return with_unmapped(nodes)


def moved_homes(spark: SparkSession, d: str) -> DataFrame:
    """Homes after two sibling folders are combined into one."""
    homes = _segments(spark, d).select("doc_id", F.col("path").alias("home"))
    return rehome(homes, "doc_id", [], ["vehicles", "outings"], "transport").select("doc_id", F.array_join("home", "/").alias("home"), "facet", "moved")


def move_log(spark: SparkSession, d: str) -> DataFrame:
    before = _segments(spark, d)
    after = rehome(before, "doc_id", [], ["vehicles", "outings"], "transport", home="path")
    return rehome_log(before, after, "doc_id", "path")


def walk_placements(spark: SparkSession, d: str) -> DataFrame:
    """Ordered fold: each document placed among the folders that those before it opened."""
    rows = _layers(spark, d).select("doc_id", "stamped_at", kebab(F.col("main")).alias("main"), kebab(F.col("sub")).alias("sub"), kebab(F.col("detail")).alias("detail"))
    return walk_fold(rows, "doc_id", "main", ["stamped_at"], ["sub", "detail"]).select("doc_id", F.array_join("home", "/").alias("home"), F.array_join("actions", ",").alias("actions"))


def prefix_lists(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "walk_home").where("home IS NOT NULL")
    return w.select("walk_id", F.array_join(F.transform(prefixes(F.col("home")), lambda p: F.concat_ws(">", p)), "|").alias("prefixes"))


_CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stamped_at DESC NULLS LAST) AS rn FROM layer_record WHERE doc_id IS NOT NULL) WHERE rn = 1)"
_KF = "regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _kb(x: str) -> str:
    return f"left({_KF.format(x)}, 48)"


_SEG = f"""WITH {_CUR}, l AS (SELECT doc_id, rel_path, [{_kb('main')}, {_kb('sub')}, {_kb('detail')}] AS a FROM cur),
f AS (SELECT doc_id, rel_path, a[1] = '' AS no_main, list_filter(a, lambda x: x <> '') AS s FROM l),
seg AS (SELECT doc_id, rel_path, CASE WHEN no_main THEN ['unmapped'] ELSE list_filter(s, lambda x, i: i = 1 OR x <> s[i - 1]) END AS path FROM f)"""
_PRE = _SEG + """, pre AS (SELECT prefix, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(path) + 1), lambda i: path[1:i])) AS prefix FROM seg) GROUP BY 1)"""
_HOME = _PRE + f""", h AS (SELECT doc_id, CASE WHEN len(path) > 1 AND EXISTS (SELECT 1 FROM pre WHERE prefix = path[1:2] AND n >= {FAT_MIN})
 THEN CASE WHEN len(path) > 2 AND EXISTS (SELECT 1 FROM pre WHERE prefix = path[1:3] AND n >= {FAT_MIN}) THEN path[1:3] ELSE path[1:2] END ELSE path[1:1] END AS home FROM seg),
hp AS (SELECT prefix, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(home) + 1), lambda i: home[1:i])) AS prefix FROM h) GROUP BY 1)"""
_LABEL = "array_to_string(list_transform(string_split({0}, '-'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
_REGION = f"""WITH w AS (SELECT rel_path, home FROM (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY stamped_at DESC NULLS LAST, walk_id DESC) AS rn FROM walk_home WHERE rel_path IS NOT NULL) WHERE rn = 1),
e AS (SELECT rel_path, {_KF.format('raw')} AS name FROM (SELECT rel_path, unnest(home) AS raw FROM w)),
named AS (SELECT DISTINCT rel_path, plan_id AS region_id FROM e JOIN file_plan ON plan_name = name),
reg AS (SELECT * FROM named UNION ALL SELECT rel_path, NULL FROM w WHERE rel_path NOT IN (SELECT rel_path FROM named))"""
_PRIMARY = _REGION + """, prim AS (SELECT rel_path, region_id FROM (SELECT rel_path, region_id, row_number() OVER (PARTITION BY rel_path ORDER BY region_id = 14, plan_level DESC, region_id) AS rn FROM named JOIN file_plan ON plan_id = region_id) WHERE rn = 1)"""


def queries() -> dict:
    names = "folder_paths head_checks folder_counts rollup_counts collapsed_homes browse_regions walk_regions home_metrics main_counts child_counts busy_folders plan_chains plan_order plan_without_banned tree_findings primary_regions browse_topics audit_groups folded_children browse_sunburst shared_parents topic_overlaps revised_plan moved_homes move_log walk_placements prefix_lists"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    label = lambda x: f"CASE WHEN {x} IN ('', 'unmapped') THEN 'Unmapped' ELSE {_LABEL.format(x)} END"
    banned = f"regexp_matches(trim(replace(main || ' ' || main, '-', ' ')), '{CHANNELS}') OR len(list_filter(regexp_split_to_array(lower(trim(replace(main || ' ' || main, '-', ' '))), '\\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '{YEAR_ONLY}'))) = 0"
    return {
        "folder_paths": _SEG + f" SELECT doc_id, array_to_string(path[1:3], '/') AS path, array_to_string(path[1:3], '--') AS node, {label('path[-1]')} AS label FROM seg",
        "head_checks": f"WITH {_CUR}, m AS (SELECT {_kb('main')} AS main FROM cur UNION SELECT {_kb('string_split(rel_path, chr(47))[1]')} FROM documents) SELECT main, {banned} AS banned, regexp_matches(main, '{VAGUE}') AS vague FROM m WHERE main <> ''",
        "folder_counts": _PRE + " SELECT array_to_string(prefix, '/') AS prefix, n FROM pre",
        "rollup_counts": f"WITH {_CUR}, k AS (SELECT {_kb('main')} AS main, {_kb('sub')} AS sub FROM cur) SELECT coalesce(main, '*') AS main, coalesce(sub, '*') AS sub, CAST(CASE grouping_id(main, sub) WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INT) AS level, count(*) AS n FROM k GROUP BY ROLLUP (main, sub)",
        "collapsed_homes": _HOME + " SELECT doc_id, array_to_string(home, '/') AS home FROM h",
        "browse_regions": _HOME + f""", held AS (SELECT home, count(*) AS docs_at FROM h GROUP BY 1) SELECT array_to_string(prefix, '--') AS id, CASE WHEN len(prefix) > 1 THEN array_to_string(prefix[1:len(prefix) - 1], '--') END AS parent_id,
 {label('prefix[-1]')} AS label, CAST(len(prefix) AS INT) AS depth, coalesce(docs_at, 0) AS docs_at, n AS docs_under FROM hp LEFT JOIN held ON home = prefix""",
        "walk_regions": _PRE + f""", held AS (SELECT path, count(*) AS docs_at FROM seg GROUP BY 1) SELECT array_to_string(prefix, '--') AS id, CASE WHEN len(prefix) > 1 THEN array_to_string(prefix[1:len(prefix) - 1], '--') END AS parent_id,
 {label('prefix[-1]')} AS label, CAST(len(prefix) AS INT) AS depth, coalesce(docs_at, 0) AS docs_at, n AS docs_under FROM pre LEFT JOIN held ON path = prefix""",
        "move_log": _SEG + " SELECT doc_id, array_to_string(path, '/') AS home_from, array_to_string((list_concat(['transport'], path))[1:3], '/') AS home_to FROM seg WHERE path[1] IN ('vehicles', 'outings')",
        "home_metrics": _HOME + " SELECT count(*) AS documents, avg(len(home)) AS depth_mean, count(*) FILTER (home[1] = 'unmapped') AS unmapped, count(DISTINCT home) AS homes_used FROM h",
        "main_counts": f"WITH {_CUR} SELECT {_kb('main')} AS main, count(*) AS n, count(DISTINCT {_kb('sub')}) AS subs FROM cur GROUP BY 1",
        "child_counts": _SEG + " SELECT path[1] AS parent, path[2] AS child, count(*) AS n FROM seg WHERE len(path) > 1 GROUP BY 1, 2",
        "busy_folders": _PRE + f", k AS (SELECT prefix[1:len(prefix) - 1] AS p, count(*) AS children FROM pre WHERE len(prefix) > 1 GROUP BY 1) SELECT array_to_string(prefix, '/') AS folder, n, children FROM pre JOIN k ON p = prefix WHERE n >= {FAT_MIN} AND children >= 2",
        "plan_chains": """WITH RECURSIVE c AS (SELECT plan_id AS id, plan_name AS crumbs, parent_id, 1 AS depth FROM file_plan UNION ALL SELECT id, f.plan_name || '/' || crumbs, f.parent_id, depth + 1 FROM c JOIN file_plan f ON f.plan_id = c.parent_id)
 SELECT id, crumbs, CAST(depth AS BIGINT) AS depth FROM c WHERE parent_id IS NULL""",
        "plan_order": """WITH RECURSIVE k AS (SELECT plan_id, parent_id, CASE WHEN plan_id = 14 THEN '1' ELSE '0' END || lower(title) || chr(1) || plan_id AS key FROM file_plan),
 c AS (SELECT plan_id AS id, key AS path_key, parent_id, 1 AS depth FROM k UNION ALL SELECT id, k.key || chr(2) || path_key, k.parent_id, depth + 1 FROM c JOIN k ON k.plan_id = c.parent_id)
 SELECT id, CAST(depth AS INT) AS depth, row_number() OVER (ORDER BY path_key) AS place FROM c WHERE parent_id IS NULL""",
        "plan_without_banned": """WITH g AS (SELECT plan_id, parent_id FROM file_plan WHERE plan_level = 2 AND contains(plan_name, '-')) SELECT f.plan_id AS id, CASE WHEN g.plan_id IS NOT NULL THEN g.parent_id ELSE f.parent_id END AS parent_id
 FROM file_plan f LEFT JOIN g ON f.parent_id = g.plan_id WHERE f.plan_id NOT IN (SELECT plan_id FROM g)""",
        "tree_findings": _REGION + """, cnt AS (SELECT region_id, count(*) AS n FROM named GROUP BY 1), s AS (SELECT plan_id, parent_id, coalesce(n, 0) AS n FROM file_plan LEFT JOIN cnt ON plan_id = region_id),
 x AS (SELECT c.region_id, count(*) AS docs FROM named c JOIN file_plan f ON f.plan_id = c.region_id WHERE f.parent_id IN (SELECT region_id FROM cnt) AND NOT EXISTS (SELECT 1 FROM named p WHERE p.region_id = f.parent_id AND p.rel_path = c.rel_path) GROUP BY 1)
 SELECT CASE WHEN n = 0 THEN 'empty-node' WHEN parent_id IS NOT NULL AND n <= 1 THEN 'singularity' ELSE 'fat-branch' END AS kind, CAST(plan_id AS VARCHAR) AS region_id, n AS docs FROM s WHERE n = 0 OR (parent_id IS NOT NULL AND n <= 1) OR n >= 40
 UNION ALL SELECT 'scope-drift', CAST(x.region_id AS VARCHAR), docs FROM x JOIN cnt ON cnt.region_id = x.region_id WHERE docs > n * 0.25
 UNION ALL SELECT 'unassigned', 'unassigned', count(*) FROM reg WHERE region_id IS NULL HAVING count(*) > 0""",
        "primary_regions": _PRIMARY + " SELECT rel_path, region_id FROM prim",
        "audit_groups": _PRIMARY + """, n AS (SELECT rel_path, CAST(region_id AS VARCHAR) AS region, row_number() OVER (PARTITION BY region_id ORDER BY rel_path) - 1 AS k FROM prim)
 SELECT rel_path, region, region || '#' || CASE WHEN k // 12 + 1 < 100 THEN lpad(CAST(k // 12 + 1 AS VARCHAR), 2, '0') ELSE CAST(k // 12 + 1 AS VARCHAR) END AS chunk_id, CAST(k % 12 AS INT) AS place FROM n""",
        "folded_children": _PRIMARY + """, s3 AS (SELECT region_id FROM prim JOIN file_plan ON plan_id = region_id WHERE plan_level = 3 GROUP BY 1 HAVING count(*) < 2),
 p3 AS (SELECT rel_path, CASE WHEN region_id IN (SELECT region_id FROM s3) THEN parent_id ELSE region_id END AS region_id FROM prim JOIN file_plan ON plan_id = region_id),
 s2 AS (SELECT region_id FROM p3 JOIN file_plan ON plan_id = region_id WHERE plan_level = 2 GROUP BY 1 HAVING count(*) < 2)
 SELECT rel_path, CASE WHEN region_id IN (SELECT region_id FROM s2) THEN parent_id ELSE region_id END AS region_id FROM p3 JOIN file_plan ON plan_id = region_id""",
        "browse_sunburst": _HOME + f""" SELECT 0 AS ring, 'root' AS id, '' AS parent, 'All' AS label, count(*) AS value FROM h UNION ALL SELECT CAST(len(prefix) AS INT), array_to_string(prefix, '/'), CASE WHEN len(prefix) > 1 THEN array_to_string(prefix[1:len(prefix) - 1], '/') ELSE 'root' END, {label('prefix[-1]')}, n FROM hp""",
        "shared_parents": f"""WITH {_CUR}, s AS (SELECT {_kb('main')} AS main, {_kb('sub')} AS sub, owner_id FROM cur), t AS (SELECT * FROM s WHERE main <> '' AND sub <> ''),
 a AS (SELECT DISTINCT main, main || '/' || sub AS id, owner_id FROM t), b AS (SELECT DISTINCT main AS topic_id, owner_id FROM t),
 c AS (SELECT id, topic_id, count(*) AS shared FROM a JOIN b ON a.owner_id = b.owner_id AND topic_id <> main GROUP BY 1, 2 HAVING count(*) >= 5)
 SELECT id, topic_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, topic_id DESC) AS rn FROM c) WHERE rn = 1""",
        "topic_overlaps": f"""WITH {_CUR}, m AS (SELECT DISTINCT {_kb('main')} AS id, owner_id FROM cur WHERE owner_id IS NOT NULL), k AS (SELECT * FROM m WHERE id <> '')
 SELECT x.id AS a, y.id AS b, count(*) AS shared FROM k x JOIN k y ON x.owner_id = y.owner_id AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 3""",
        "revised_plan": """WITH RECURSIVE g AS (SELECT plan_id FROM file_plan WHERE plan_id = 14 UNION ALL SELECT f.plan_id FROM file_plan f JOIN g ON f.parent_id = g.plan_id)
 SELECT CAST(plan_id AS VARCHAR) AS id, CAST(parent_id AS VARCHAR) AS parent_id, CASE WHEN plan_id = 2 THEN 'On site' ELSE title END AS label FROM file_plan WHERE plan_id NOT IN (SELECT plan_id FROM g)
 UNION ALL SELECT '8--fire-and-smoke', '8', 'Fire And Smoke' UNION ALL SELECT '8--ladders', '8', 'Ladders' UNION ALL SELECT 'unmapped', NULL, 'Unmapped'""",
        "moved_homes": _SEG + """, m AS (SELECT doc_id, path[1] IN ('vehicles', 'outings') AS moved, CASE WHEN path[1] IN ('vehicles', 'outings') THEN list_concat(['transport'], path) ELSE path END AS p FROM seg)
 SELECT doc_id, array_to_string(p[1:3], '/') AS home, p[4] AS facet, moved FROM m""",
        "prefix_lists": "SELECT walk_id, array_to_string(list_transform(range(1, len(home) + 1), lambda i: array_to_string(list_filter(home[1:i], lambda v: v IS NOT NULL), '>')), '|') AS prefixes FROM walk_home WHERE home IS NOT NULL",
    }
