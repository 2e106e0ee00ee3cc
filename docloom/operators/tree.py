"""Folder trees as adjacency tables: chains, orders, roll-ups, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import cut
from docloom.functions.terms import UNMAPPED, human_label, is_banned_head, kebab, node_id

DEPTH = 3
FAT_MIN = 8
FAT_BRANCH = 40
DRIFT = 0.25


def chains(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Add ``chain``: ids from the root to the node (nodes: id, parent_id, ...), for trees of at most ``depth`` levels."""
    parents = nodes.select(F.col("id").alias("_p"), F.col("parent_id").alias("_pp"))
    out = nodes.withColumn("chain", F.array("id")).withColumn("_up", F.col("parent_id"))
    for _ in range(depth - 1):
        out = out.join(parents, F.col("_up") == F.col("_p"), "left")
        out = out.withColumn("chain", F.when(F.col("_up").isNotNull() & F.col("_p").isNotNull(), F.concat(F.array("_up"), "chain")).otherwise(F.col("chain")))
        out = out.withColumn("_up", F.col("_pp")).drop("_p", "_pp")
    return out.drop("_up")


def depth_first(nodes: DataFrame, label: str, bins: list, depth: int = DEPTH) -> DataFrame:
    """Add ``depth`` and ``path_key``: sorting by it lists the tree depth first, by label, review bins last."""
    chained = chains(nodes, depth)
    sort_key = F.concat(F.when(F.col("id").isin(*bins) if bins else F.lit(False), "1").otherwise("0"), F.lower(label), F.lit("\u0001"), F.col("id").cast("string"))
    keys = nodes.select(F.col("id").alias("_i"), sort_key.alias("_k"))
    parts = chained.select("id", F.posexplode("chain").alias("_at", "_i")).join(keys, "_i").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_at", "_k"))).alias("_s"))
    joined = chained.join(parts, "id")
    return joined.select(*nodes.columns, F.size("chain").alias("depth"), F.array_join(F.transform("_s", lambda x: x["_k"]), "\u0002").alias("path_key"))


def prefixes(path: Column) -> Column:
    """All prefixes of a path, shortest first."""
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, 1, i))).otherwise(F.array().cast("array<array<string>>"))


def prefix_counts(homes: DataFrame, path: str = "path") -> DataFrame:
    """(prefix, n): rows at or under each prefix."""
    return homes.select(F.explode(prefixes(F.col(path))).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


def folder_segments(main: Column, sub: Column, detail: Column, parent: Column | None = None) -> Column:
    """Kebab layers without empty ones and repeats of the one before; an unused main is the unmapped folder."""
    layers = [kebab(main), kebab(sub), kebab(detail)]
    if parent is not None:
        p = kebab(parent)
        layers = [F.when((p != layers[0]) & ~is_banned_head(p), p).otherwise(F.lit("")), *layers]
    some = F.filter(F.array(*layers), lambda x: x != "")
    kept = F.filter(some, lambda x, i: (i == 0) | (x != F.try_element_at(some, F.greatest(i, F.lit(1)))))
    return F.when(kebab(main) == "", F.array(F.lit(UNMAPPED))).otherwise(kept)


def collapse_homes(homes: DataFrame, key: str, path: str = "path", fat_min: int = FAT_MIN, depth: int = DEPTH) -> DataFrame:
    """(key, home): a folder below the root opens only if it holds ``fat_min`` rows; a row stays at the last open one.

    Counts of the prefixes are joined back level by level, so that nothing but the counts is shuffled twice.
    """
    counts = prefix_counts(homes.withColumn(path, F.slice(path, 1, depth)), path).where((F.size("prefix") > 1) & (F.col("n") >= fat_min)).select("prefix")
    out = homes.select(key, F.slice(path, 1, depth).alias("_p"), F.slice(path, 1, 1).alias("home"), F.lit(True).alias("_open"))
    for level in range(2, depth + 1):
        fat = counts.where(F.size("prefix") == level).select(F.col("prefix").alias("_f"))
        step = F.when(F.size("_p") >= level, F.slice("_p", 1, level))
        out = out.withColumn("_s", step).join(fat, F.col("_s") == F.col("_f"), "left")
        out = out.withColumn("_open", F.col("_open") & F.col("_f").isNotNull()).withColumn("home", F.when(F.col("_open"), F.col("_s")).otherwise(F.col("home"))).drop("_s", "_f")
    return out.select(key, "home")


def regions_of(homes: DataFrame, path: str = "home") -> DataFrame:
    """(id, parent_id, label, depth, docs_at, docs_under) of every folder on the homes."""
    at = homes.groupBy(path).agg(F.count(F.lit(1)).alias("docs_at")).withColumnRenamed(path, "prefix")
    under = prefix_counts(homes, path).withColumnRenamed("n", "docs_under")
    up = F.slice("prefix", 1, F.size("prefix") - 1)
    parent = F.when(F.size("prefix") > 1, node_id(up))
    return under.join(at, "prefix", "left").select(
        node_id(F.col("prefix")).alias("id"), parent.alias("parent_id"), human_label(F.element_at("prefix", -1)).alias("label"), F.size("prefix").alias("depth"), F.coalesce("docs_at", F.lit(0)).alias("docs_at"), "docs_under"
    )


def nearest_kept(nodes: DataFrame, dropped: Column, depth: int = DEPTH) -> DataFrame:
    """Nodes without those that ``dropped`` says; their children hang on the nearest kept ancestor."""
    gone = nodes.where(dropped).select(F.col("id").alias("_g"), F.col("parent_id").alias("_gp"))
    out = nodes.where(~dropped)
    for _ in range(depth):
        out = out.join(gone, F.col("parent_id") == F.col("_g"), "left").withColumn("parent_id", F.when(F.col("_g").isNotNull(), F.col("_gp")).otherwise(F.col("parent_id"))).drop("_g", "_gp")
    return out


def findings(nodes: DataFrame, assignments: DataFrame, fat_at: int = FAT_BRANCH, drift: float = DRIFT) -> DataFrame:
    """(kind, region_id, docs): empty nodes, single children, fat branches, scope drift, and the unassigned.

    ``nodes`` has id and parent_id, ``assignments`` (rel_path, region_id) with one row for each region, null for none; rows without a path are no
    files. In the order of kind and region.
    """
    ids = nodes.select(F.col("id").alias("region_id"), "parent_id", F.lit(True).alias("known"))
    marked = assignments.where("rel_path IS NOT NULL").join(ids, "region_id", "left")
    counts = marked.where("known").groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
    # the regions of a file are a set of nodes at most, added up in each task before the shuffle
    per = cut(marked.groupBy("rel_path").agg(F.collect_set(F.when(F.col("known"), F.col("region_id"))).alias("regions")))
    outside = per.select("regions", F.explode("regions").alias("region_id")).join(ids.where("parent_id IS NOT NULL"), "region_id")
    extra = outside.where(~F.array_contains("regions", F.col("parent_id"))).groupBy("region_id").agg(F.count(F.lit(1)).alias("extra"))
    filled = counts.select(F.col("region_id").alias("parent_id"), F.lit(True).alias("filled"))
    sized = ids.join(counts, "region_id", "left").join(extra, "region_id", "left").join(filled, "parent_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind = F.when(F.col("n") == 0, "empty-node").when(F.col("parent_id").isNotNull() & (F.col("n") <= 1), "singularity").when(F.col("n") >= fat_at, "fat-branch")
    drifted = F.col("filled") & (F.col("extra") > F.col("n") * drift)
    said = F.array_compact(F.array(F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.col("n").alias("docs"))), F.when(drifted, F.struct(F.lit("scope-drift").alias("kind"), F.col("extra").alias("docs")))))
    shape = sized.select(F.explode(said).alias("f"), F.col("region_id").cast("string").alias("region_id")).select("f.kind", "region_id", "f.docs")
    loose = per.where(F.size("regions") == 0).agg(F.count(F.lit(1)).alias("docs")).where("docs > 0")
    return shape.unionAll(loose.select(F.lit("unassigned").alias("kind"), F.lit("unassigned").alias("region_id"), "docs")).orderBy("kind", "region_id")


def primary_region(assignments: DataFrame, nodes_with_depth: DataFrame, bins: list) -> DataFrame:
    """(rel_path, region_id): the deepest real region of each row, ties by id; a bin only where nothing else is."""
    joined = assignments.join(nodes_with_depth.select(F.col("id").alias("region_id"), "depth"), "region_id")
    is_bin = F.col("region_id").isin(*bins) if bins else F.lit(False)
    return joined.groupBy("rel_path").agg(F.min_by("region_id", F.struct(is_bin.cast("int"), -F.col("depth"), F.col("region_id"))).alias("region_id"))


def fold_small_children(nodes: DataFrame, homes: DataFrame, least: int = 2, depth: int = DEPTH) -> DataFrame:
    """(rel_path, region_id) after children with fewer than ``least`` rows are folded into their parents, from below."""
    parents = nodes.select(F.col("id").alias("_i"), "parent_id", "depth")
    out = homes.select("rel_path", "region_id")
    for level in range(depth, 1, -1):
        counts = out.groupBy("region_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < least).join(parents.where(F.col("depth") == level), F.col("region_id") == F.col("_i"))
        out = out.join(counts.select(F.col("region_id").alias("_r"), F.col("parent_id").alias("_to")), F.col("region_id") == F.col("_r"), "left").select("rel_path", F.coalesce("_to", "region_id").alias("region_id"))
    return out


def sunburst(homes: DataFrame, path: str = "home", depth: int = DEPTH) -> DataFrame:
    """(ring, id, parent, label, value): rings of a chart; the value of a node is the sum of those below it."""
    root = homes.agg(F.count(F.lit(1)).alias("value")).select(F.lit(0).alias("ring"), F.lit("root").alias("id"), F.lit("").alias("parent"), F.lit("All").alias("label"), "value")
    rings = prefix_counts(homes.withColumn(path, F.slice(path, 1, depth)), path)
    ring = rings.select(
        F.size("prefix").alias("ring"),
        F.array_join("prefix", "/").alias("id"),
        F.when(F.size("prefix") > 1, F.array_join(F.slice("prefix", 1, F.size("prefix") - 1), "/")).otherwise("root").alias("parent"),
        human_label(F.element_at("prefix", -1)).alias("label"),
        F.col("n").alias("value"),
    )
    return root.unionAll(ring)


def second_parents(members: DataFrame, topics: DataFrame, nodes: DataFrame, least: int = 5, most: int = 1) -> DataFrame:
    """(id, topic_id, shared): for each node the topics, other than its own, that share enough of its documents.

    ``members`` (id, doc), ``topics`` (id), ``nodes`` (id, topic_id). At most ``most`` by (shared, id) descending.
    """
    own = nodes.select("id", F.col("topic_id").alias("_own"))
    docs = members.join(topics.select(F.col("id").alias("topic_id")), F.col("id") == F.col("topic_id"), "left_semi").select(F.col("id").alias("topic_id"), "doc")
    shared = members.join(own, "id").join(docs, "doc").where(F.col("topic_id") != F.col("_own")).groupBy("id", "topic_id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    at = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), F.desc("topic_id")))
    return shared.withColumn("_at", at).where(F.col("_at") <= most).drop("_at")


def with_unmapped(nodes: DataFrame) -> DataFrame:
    """Nodes (id, parent_id, label) with the unmapped folder added once, and no second one."""
    extra = nodes.sparkSession.createDataFrame([(UNMAPPED, None, "Unmapped")], "id string, parent_id string, label string")
    base = nodes.select(F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent_id"), "label")
    return base.unionAll(extra.join(base.where(F.col("id") == UNMAPPED).select("id"), "id", "left_anti").select("id", "parent_id", "label"))


def revise(nodes: DataFrame, changes: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Nodes after changes (id, action, label, parts): rename gives a label, dissolve takes a node and all below it out,
    split adds a child for each part; other actions keep. Also (id, to): where rows of nodes that went are to be filed.
    """
    c = changes.select(F.col("id").alias("_c"), F.lower("action").alias("_act"), F.col("label").alias("_label"), "parts")
    gone = chains(nodes, depth).select("id", F.posexplode("chain").alias("_at", "_c")).join(c.where("_act = 'dissolve'"), "_c")
    # the highest dissolved node above decides; its parent takes the rows
    top = gone.groupBy("id").agg(F.min_by("_c", "_at").alias("_top"))
    to = top.join(nodes.select(F.col("id").alias("_top"), F.col("parent_id").alias("to")), "_top").select("id", "to")
    rest = nodes.join(top.select("id"), "id", "left_anti").join(c, F.col("id") == F.col("_c"), "left")
    kept = rest.select("id", "parent_id", F.when((F.col("_act") == "rename") & (F.trim("_label") != ""), F.col("_label")).otherwise(F.col("label")).alias("label"))
    parts = rest.where("_act = 'split'").select(F.explode("parts").alias("part"), "id")
    new = parts.select(F.concat_ws("--", F.col("id").cast("string"), kebab(F.col("part"))).alias("id"), F.col("id").cast("string").alias("parent_id"), human_label(kebab(F.col("part"))).alias("label"))
    text = kept.select(F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent_id"), "label")
    return text.unionAll(new), to


def topic_pairs(members: DataFrame, least: int = 5) -> DataFrame:
    """(a, b, shared), a < b: topics of (id, doc) with at least ``least`` documents in common; candidates meet by document."""
    m = members.select("id", "doc").distinct()
    both = m.withColumnRenamed("id", "a").join(m.withColumnRenamed("id", "b"), "doc").where("a < b")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
