"""Maps from terms to regions and from old folders to new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag_regions(nodes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(tag, region_id) from nodes (region_id, pos, tags) and synonyms (preferred, alias).

    A tag of several nodes belongs to the first. A synonym without a region takes that of its other side.
    """
    own = nodes.select("region_id", "pos", F.explode("tags").alias("tag")).where(F.trim("tag") != "").groupBy("tag").agg(F.min_by("region_id", "pos").alias("region_id"))
    sides = synonyms.select(F.col("preferred").alias("tag"), F.col("alias").alias("other")).unionAll(synonyms.select(F.col("alias").alias("tag"), F.col("preferred").alias("other")))
    lent = sides.join(own.select(F.col("tag").alias("other"), "region_id"), "other").groupBy("tag").agg(F.min("region_id").alias("region_id"))
    return own.unionAll(lent.join(own.select("tag"), "tag", "left_anti").select("tag", "region_id"))


def spread_in_clusters(mapped: DataFrame, members: DataFrame) -> DataFrame:
    """(tag, region_id): every tag of a cluster (cluster, pos, tag) takes the region of the cluster's first mapped tag, if it has none."""
    first = members.join(mapped, "tag").groupBy("cluster").agg(F.min_by("region_id", "pos").alias("region_id"))
    lent = members.join(first, "cluster").groupBy("tag").agg(F.min("region_id").alias("region_id"))
    return mapped.select("tag", "region_id").unionAll(lent.join(mapped.select("tag"), "tag", "left_anti").select("tag", "region_id"))


def remap(df: DataFrame, column: str, groups: DataFrame, scope: str | None = None) -> DataFrame:
    """Values of ``column`` that are in groups (name, into[, scope]) replaced; the old value is kept as ``<column>_from``."""
    keys = ["_name", *(["_scope"] if scope else [])]
    side = groups.select(F.col("name").alias("_name"), F.col("into").alias("_into"), *([F.col("scope").alias("_scope")] if scope else [])).groupBy(*keys).agg(F.min("_into").alias("_into"))
    on = F.col(column) == F.col("_name")
    if scope:
        on = on & (F.col(scope) == F.col("_scope"))
    joined = df.join(side, on, "left")
    changed = F.col("_into").isNotNull()
    return joined.withColumn(f"{column}_from", F.when(changed, F.col(column))).withColumn(column, F.when(changed, F.col("_into")).otherwise(F.col(column))).drop("_into", *keys)


def fattest_roots(rows: DataFrame, root: str, source: str) -> DataFrame:
    """(root, sources, files): roots by how many former folders they took in, then the smallest; else by size."""
    sized = rows.groupBy(root).agg(F.countDistinct(source).alias("sources"), F.count(F.lit(1)).alias("files"))
    return sized.orderBy(F.desc(F.col("sources") >= 2), F.desc("sources"), F.when(F.col("sources") >= 2, F.col("files")).otherwise(-F.col("files")), root)
