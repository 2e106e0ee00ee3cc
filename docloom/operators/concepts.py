"""Concepts and clusters of tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.terms import content_tokens, kebab_label, match_tokens
from docloom.session import cut


def inventory(records: DataFrame, tags: str = "tags", key: str = "doc_id") -> DataFrame:
    """(tag, docs): records that carry each tag; blank tags are none."""
    each = records.select(key, F.explode(tags).alias("tag")).where(F.trim("tag") != "").distinct()
    return each.groupBy("tag").agg(F.count(F.lit(1)).alias("docs"))


def concepts(records: DataFrame, tags: str = "tags", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(concept_id, preferred, aliases, docs) and (concept_id, key).

    Tags with the same content words are one concept, named by the kebab form of its most frequent tag (then the
    shortest, then the last in order). Documents are counted once for each concept; two light aggregations take the
    place of a set of documents in each concept.
    """
    each = records.select(key, F.explode(tags).alias("tag")).where(F.trim("tag") != "").distinct()
    each = each.withColumn("concept_id", F.array_join(content_tokens(F.col("tag")), " "))
    counts = each.groupBy("concept_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("tag", F.struct("n", -F.char_length("tag"), "tag"))
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "tag"))), lambda x: x["tag"])
    named = counts.groupBy("concept_id").agg(best.alias("head"), order.alias("aliases"))
    members = each.select("concept_id", key).distinct()
    sized = members.groupBy("concept_id").agg(F.count(F.lit(1)).alias("docs"))
    out = named.join(sized, "concept_id").select("concept_id", F.coalesce(F.nullif(kebab_label(F.col("head")), F.lit("")), F.col("head")).alias("preferred"), "aliases", "docs")
    return out, members


def concept_pairs(named: DataFrame, members: DataFrame, key: str = "doc_id", least_shared: int = 2, least_jaccard: float = 0.25) -> DataFrame:
    """(a, b, shared, jaccard), a < b: concepts that share a content word, documents and enough of their union.

    The concepts of a document are collapsed to baskets, identical ones to one with a weight; a pair is listed once for each
    distinct basket, and only if its words meet, so nothing is joined with itself.
    """
    worded = members.join(named.select("concept_id", content_tokens(F.col("preferred")).alias("words")), "concept_id")
    baskets = worded.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("concept_id", "words"))).alias("basket")).where(F.size("basket") > 1)
    weighted = baskets.groupBy("basket").agg(F.count(F.lit(1)).alias("weight"))
    firsts = weighted.select("basket", "weight", F.posexplode("basket").alias("_pos", "x"))
    later = F.filter("basket", lambda y, i: (i > F.col("_pos")) & F.arrays_overlap(y["words"], F.col("x.words")))
    pairs = firsts.select("weight", F.col("x.concept_id").alias("a"), F.explode(F.transform(later, lambda y: y["concept_id"])).alias("b"))
    shared = pairs.groupBy("a", "b").agg(F.sum("weight").alias("shared"))
    size = lambda x: named.select(F.col("concept_id").alias(x), F.col("docs").alias(f"n_{x}"))
    jaccard = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    both = shared.where(F.col("shared") >= least_shared).join(size("a"), "a").join(size("b"), "b")
    return both.withColumn("jaccard", jaccard).where(F.col("jaccard") >= least_jaccard).select("a", "b", "shared", "jaccard")


def clusters(named: DataFrame, pairs: DataFrame, most_members: int = 16) -> DataFrame:
    """(concept_id, seed): greedy clusters around the most frequent concepts.

    A concept joins the first seed, by (documents descending, name), that it is paired with; a seed is a concept
    that no earlier seed has taken. That is the lexicographically first independent set: in each round every
    undecided concept that is before all its undecided neighbours becomes a seed, and its neighbours join their
    first seed once no neighbour before that seed is undecided. A seed keeps its first ``most_members`` - 1
    neighbours, so one joins only if all undecided neighbours of the seed before it have room too; those turned away
    are decided among themselves. The first undecided concept is decided or turned away in each round, so the rounds
    end with all decided.
    """
    # numbers that rise with the sorted ranges; they need not be dense, so that no single task numbers all concepts
    order = cut(named.select("concept_id", "docs", "preferred").orderBy(F.desc("docs"), "preferred", "concept_id").select("concept_id", F.monotonically_increasing_id().alias("rank")))
    ranks = lambda x: order.select(F.col("concept_id").alias(x), F.col("rank").alias(f"r_{x}"))
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(both.join(ranks("a"), "a").join(ranks("b"), "b").where("r_b < r_a").select("r_a", "r_b"))  # a may join the earlier b
    state = cut(order.select("rank", F.lit(None).cast("long").alias("seed")))
    while not state.where("seed IS NULL").isEmpty():
        open_ = state.where("seed IS NULL").select("rank")
        seeds = state.where("seed = rank").select(F.col("rank").alias("r_b"))
        at = F.row_number().over(Window.partitionBy("r_b").orderBy("r_a"))
        asked = edges.join(open_.withColumnRenamed("rank", "r_a"), "r_a").join(seeds, "r_b").select("r_a", "r_b", at.alias("at"))
        taken = asked.groupBy("r_a").agg(F.min(F.struct(F.col("r_b").alias("s"), "at")).alias("t")).select("r_a", "t.*")
        waiting = edges.join(open_.withColumnRenamed("rank", "r_b"), "r_b").join(taken, "r_a", "left").where("s IS NULL OR r_b < s").select(F.col("r_a").alias("rank")).distinct()
        proposed = open_.join(waiting, "rank", "left_anti").join(taken.withColumnRenamed("r_a", "rank"), "rank", "left")
        full = state.where("seed IS NOT NULL").groupBy(F.col("seed").alias("s")).agg(F.count(F.lit(1)).alias("held"))
        proposed = cut(proposed.join(full, "s", "left").select("rank", "s", "at", "held"))
        accepted = proposed.where((F.col("s").isNull()) | (F.col("at") + F.col("held") <= most_members)).select("rank", F.coalesce("s", "rank").alias("_s"))
        refused = proposed.where(F.col("held") >= most_members).select(F.col("rank").alias("r_a"), F.col("s").alias("r_b"))
        edges = cut(edges.join(refused, ["r_a", "r_b"], "left_anti"))
        state = cut(state.join(accepted, "rank", "left").select("rank", F.coalesce("seed", "_s").alias("seed")))
    seed = order.select(F.col("rank").alias("seed"), F.col("concept_id").alias("seed_id"))
    return state.join(order, "rank").join(seed, "seed").select("concept_id", F.col("seed_id").alias("seed"))


def place_leftovers(tags: DataFrame, mapped: DataFrame, least: float = 0.5, bin_id: str = "needs-review") -> DataFrame:
    """(tag, region_id, score) for ``tags`` (tag) that have no region: that of the most similar tag in ``mapped``
    (tag, region_id, pos), or the review bin.

    Similarity is the common words over the smaller word set; ties go to the earliest mapped tag.
    """
    a = tags.select("tag", match_tokens(F.col("tag")).alias("wa"))
    b = mapped.select("region_id", "pos", match_tokens(F.col("tag")).alias("wb"))
    left = a.select("tag", F.size("wa").alias("na"), F.explode("wa").alias("word"))
    right = b.select("region_id", "pos", F.size("wb").alias("nb"), F.explode("wb").alias("word"))
    hits = left.join(right, "word").groupBy("tag", "na", "region_id", "pos", "nb").agg(F.count(F.lit(1)).alias("overlap"))
    scored = hits.withColumn("score", F.col("overlap") / F.least("na", "nb"))
    best = scored.groupBy("tag").agg(F.max_by("region_id", F.struct("score", -F.col("pos"))).alias("best"), F.max("score").alias("score"))
    good = F.col("score") >= least
    return tags.select("tag").join(best, "tag", "left").select("tag", F.when(good, F.col("best")).otherwise(bin_id).alias("region_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
