"""A browse graph over a folder tree: entry points that the tree buried, second parents, and nodes that belong to two topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.terms import content_tokens, kebab_label


def telling_words(text: Column, shortest: int = 5) -> Column:
    """Content words long enough to stand for a subject."""
    return F.filter(content_tokens(text), lambda w: F.length(w) >= shortest)


def promoted_topics(topic_words: DataFrame, tags: DataFrame, families: DataFrame, least: int = 5, shortest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Families (id, label, words) that no topic has a word of and whose tags stand on ``least`` documents: (id, label), and (id, doc)."""
    words = families.select("id", "label", F.explode("words").alias("word"))
    known = words.join(topic_words.select("word").distinct(), "word", "left_semi").select("id").distinct()
    wanted = words.join(known, "id", "left_anti")
    tagged = tags.select("tag").distinct().select("tag", F.explode(telling_words(F.col("tag"), shortest)).alias("word"))
    docs = wanted.join(tagged, "word").select("id", "label", "tag").distinct().join(tags, "tag").select("id", "label", "doc").distinct()
    enough = docs.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("id", "label")
    return enough, docs.join(enough.select("id"), "id", "left_semi").select("id", "doc")


def compound_nodes(topic_words: DataFrame, tags: DataFrame, least: int = 5, shortest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes of two topics: (id, a, b), a < b, and (id, doc).

    A tag with a telling word of each of two topics speaks for the pair; a pair whose tags stand on ``least`` documents is a
    node, named by the tag of most documents (then the first in order). Pairs are formed within a tag only, from the topics its words name.
    """
    tagged = tags.select("tag").distinct().select("tag", F.explode(telling_words(F.col("tag"), shortest)).alias("word"))
    topics = tagged.join(topic_words, "word").groupBy("tag").agg(F.array_sort(F.collect_set("id")).alias("topics")).where(F.size("topics") > 1)
    firsts = topics.select("tag", "topics", F.posexplode("topics").alias("_pos", "a"))
    pairs = firsts.select("tag", "a", F.explode(F.slice("topics", F.col("_pos") + 2, F.size("topics"))).alias("b"))
    docs = pairs.join(tags, "tag").select("a", "b", "tag", "doc").distinct()
    sized = docs.groupBy("a", "b").agg(F.countDistinct("doc").alias("n")).where(F.col("n") >= least)
    best = docs.groupBy("a", "b", "tag").agg(F.count(F.lit(1)).alias("n")).groupBy("a", "b").agg(F.min(F.struct((-F.col("n")).alias("n"), "tag")).alias("best"))
    named = sized.join(best, ["a", "b"]).select("a", "b", kebab_label(F.col("best.tag")).alias("id"))
    return named.select("id", "a", "b"), named.join(docs, ["a", "b"]).select("id", "doc").distinct()


def browse_graph(nodes: DataFrame, members: DataFrame, tags: DataFrame, families: DataFrame | None = None, least: int = 5, most_parents: int = 2, shortest: int = 5) -> DataFrame:
    """(id, label, kind, broader, docs): topics and subtopics with at most ``most_parents`` broader topics each.

    ``nodes`` (id, parent_id, label) is a tree whose roots are the topics, ``members`` (id, doc) the documents of its nodes, ``tags``
    (tag, doc) those of the tags. Families that the tree has no topic for are promoted to topics; a subtopic gets a second parent
    where it shares ``least`` documents and a telling word with another topic (most shared first, then the last id); tags that name
    two topics make a node of both, or give their node its parents where there is one already. A node without documents stays with 0.
    """
    members, tags = members.select("id", "doc").distinct(), tags.select("tag", "doc").distinct()
    words = lambda df: df.select("id", F.explode(telling_words(F.concat_ws("-", "id", "label"), shortest)).alias("word")).distinct()
    topics = nodes.where("parent_id IS NULL").select("id", "label")
    topic_words = words(topics)
    if families is not None:
        new, docs = promoted_topics(topic_words, tags, families.join(nodes.select("id"), "id", "left_anti"), least, shortest)
        topics, members = topics.unionByName(new), members.unionByName(docs)
        topic_words = topic_words.unionByName(families.join(new.select("id"), "id", "left_semi").select("id", F.explode("words").alias("word"))).distinct()
    below = nodes.where("parent_id IS NOT NULL")
    near = words(below).join(topic_words.withColumnRenamed("id", "topic"), "word").select("id", "topic").distinct()
    near = near.join(below.select("id", "parent_id"), "id").where("topic <> parent_id").select("id", "topic")
    docs = near.join(members, "id").join(members.select(F.col("id").alias("topic"), "doc"), ["topic", "doc"])
    shared = docs.groupBy("id", "topic").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    both, both_docs = compound_nodes(topic_words, tags, least, shortest)
    mixed = both.select("id", F.explode(F.array("a", "b")).alias("topic"), F.lit(0).cast("long").alias("shared")).distinct()
    # parents in order: the tree's own, then by shared documents, then those of compounds
    wanted = (
        below.select("id", F.col("parent_id").alias("topic"), F.lit(0).alias("o"), F.lit(0).cast("long").alias("shared"))
        .unionByName(shared.withColumn("o", F.lit(1)))
        .unionByName(mixed.withColumn("o", F.lit(2)))
        .join(topics.select("id"), "id", "left_anti")
    )
    once = wanted.groupBy("id", "topic").agg(F.min(F.struct("o", (-F.col("shared")).alias("s"))).alias("at"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("at.o", "at.s", F.when(F.col("at.o") == 1, None).otherwise(F.col("topic")), F.desc("topic")))
    kept = once.withColumn("_at", place).where(F.col("_at") <= most_parents)
    broader = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "topic"))), lambda x: x["topic"]).alias("broader"))
    fresh = both.select("id").distinct().join(nodes.select("id").unionByName(topics.select("id")), "id", "left_anti").select("id", F.initcap(F.translate("id", "-", " ")).alias("label"))
    every = topics.withColumn("kind", F.lit("topic")).unionByName(below.select("id", "label", F.lit("subtopic").alias("kind"))).unionByName(fresh.withColumn("kind", F.lit("subtopic")))
    sizes = members.unionByName(both_docs).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("docs"))
    out = every.join(broader, "id", "left").join(sizes, "id", "left")
    out = out.select("id", "label", "kind", F.coalesce("broader", F.array().cast("array<string>")).alias("broader"), F.coalesce("docs", F.lit(0)).alias("docs"))
    return out.orderBy(F.desc(F.col("kind") == "topic"), F.desc("docs"), "id")
