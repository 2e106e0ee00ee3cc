import random

import pytest
from pyspark.sql import functions as F

from docloom.operators.chunking import group_chunks, overlap_chunks
from docloom.operators.concepts import clusters, concept_pairs, concepts, place_leftovers
from docloom.operators.fold import merge_groups, rehome, walk_fold
from docloom.operators.merge import compare_runs, last_write, not_in, upsert
from docloom.operators.tree import chains, collapse_homes, depth_first, findings, fold_small_children, nearest_kept, prefix_counts
from docloom.operators.versions import current_rows


def test_overlap_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 3), (2, "short"), (3, None), (4, "")], "id int, text string")
    rows = overlap_chunks(df, "id", "text", threshold=12, size=10, overlap=4).orderBy("id", "chunk_no").collect()
    assert [r["start"] for r in rows if r["id"] == 1] == [0, 6, 12, 18, 24]
    assert [len(r["chunk"]) for r in rows if r["id"] == 1] == [10, 10, 10, 10, 6]
    assert [(r["id"], r["chunk"]) for r in rows if r["id"] > 1] == [(2, "short"), (3, ""), (4, "")]
    with pytest.raises(ValueError):
        overlap_chunks(df, "id", "text", size=10, overlap=10)


def test_group_chunks(spark):
    df = spark.createDataFrame([("g", i) for i in range(25)], "g string, i int")
    got = group_chunks(df, "g", ["i"]).groupBy("chunk_id").count().orderBy("chunk_id").collect()
    assert [tuple(r) for r in got] == [("g#01", 12), ("g#02", 12), ("g#03", 1)]


def test_current_rows(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), (None, 9, "x"), ("b", None, "only")], "doc_id string, s int, v string")
    df = df.withColumn("stamped_at", F.timestamp_seconds("s"))
    assert sorted(map(tuple, current_rows(df, ["v"]).collect())) == [("a", "new"), ("b", "only")]
    assert current_rows(df.limit(0), ["v"]).count() == 0


def test_upsert_invalidates_on_change(spark):
    old = spark.createDataFrame([("a", "h1", "done", "q"), ("b", "h2", "done", "q"), ("c", "h3", "done", "q")], "id string, h string, p string, q string")
    new = spark.createDataFrame([("a", "h1"), ("b", "h9"), ("d", "h4")], "id string, h string")
    got = {r["id"]: tuple(r)[1:] for r in upsert(old, new, "id", "h", ["p"], ["q"]).collect()}
    assert got == {"a": ("h1", "done", "q", "same"), "b": ("h9", None, "q", "update"), "c": ("h3", "done", "q", "keep"), "d": ("h4", None, None, "insert")}


def test_last_write_and_anti(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, n int")
    assert sorted(map(tuple, last_write(df, ["k"], [F.col("n")]).collect())) == [("a", 3), ("b", 2)]
    done = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r["k"] for r in not_in(df, done, "k").collect()] == ["b"]


def test_compare_runs(spark):
    a = spark.createDataFrame([("x", "m"), ("y", "m")], "k string, f string")
    b = spark.createDataFrame([("y", "n"), ("z", "m")], "k string, f string")
    got = {r["k"]: (r["side"], r["same_f"]) for r in compare_runs(a, b, "k", ["f"]).collect()}
    assert got == {"x": ("left", None), "y": ("both", False), "z": ("right", None)}


def greedy(order, docs, tokens, most=16):
    """The greedy definition, straight."""
    unused, out = list(order), {}
    while unused:
        seed = unused.pop(0)
        out[seed], held, kept = seed, 1, []
        for c in unused:
            shared = len(docs[seed] & docs[c])
            if held < most and shared >= 2 and shared / len(docs[seed] | docs[c]) >= 0.25 and tokens[seed] & tokens[c]:
                out[c] = seed
                held += 1
            else:
                kept.append(c)
        unused = kept
    return out


@pytest.mark.parametrize("most", [2, 3, 16])
def test_clusters_are_the_greedy_ones(spark, most):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    tags = [f"{a}-{b}" for a in words for b in words if a < b] + words
    records = [(str(i), rng.sample(tags, 5)) for i in range(40)]
    df = spark.createDataFrame(records, "doc_id string, tags array<string>")
    named, members = concepts(df)
    named, members = named.cache(), members.cache()
    got = {r["concept_id"]: r["seed"] for r in clusters(named, concept_pairs(named, members), most_members=most).collect()}
    docs = {r["concept_id"]: set() for r in named.collect()}
    for r in members.collect():
        docs[r["concept_id"]].add(r["doc_id"])
    order = [r["concept_id"] for r in named.orderBy(F.desc("docs"), "preferred", "concept_id").collect()]
    assert got == greedy(order, docs, {c: set(c.split()) for c in order}, most)


def test_concepts_merge_spellings(spark):
    rows = [(f"d{i}", ["curriculum_admin"]) for i in range(3)] + [("e1", ["curriculum-administration", "quote"]), ("e2", ["purchasing-quote", ""])]
    named, _ = concepts(spark.createDataFrame(rows, "doc_id string, tags array<string>"))
    got = {r["preferred"]: r["docs"] for r in named.collect()}
    assert got == {"curriculum-admin": 4, "quote": 1, "purchasing-quote": 1}


def test_leftovers(spark):
    tags = spark.createDataFrame([("curriculum_administration",), ("zebra",), ("the",)], "tag string")
    mapped = spark.createDataFrame([("curriculum", "r1", 1), ("administration-x", "r2", 2)], "tag string, region_id string, pos int")
    got = {r["tag"]: r["region_id"] for r in place_leftovers(tags, mapped).collect()}
    assert got == {"curriculum_administration": "r1", "zebra": "needs-review", "the": "needs-review"}


NODES = [(1, None, "root"), (2, 1, "kid"), (3, 2, "leaf"), (4, None, "alone")]


def test_tree(spark):
    nodes = spark.createDataFrame(NODES, "id int, parent_id int, label string")
    assert {r["id"]: r["chain"] for r in chains(nodes).collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [4]}
    assert [r["id"] for r in depth_first(nodes, "label", [4]).orderBy("path_key").collect()] == [1, 2, 3, 4]
    assert {tuple(r) for r in nearest_kept(nodes, F.col("label") == "kid").select("id", "parent_id").collect()} == {(1, None), (3, 1), (4, None)}


def test_findings(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, None)], "id int, parent_id int")
    rows = [(f"f{i}", 1) for i in range(3)] + [("f0", 2), ("g1", 3), ("g2", 3), ("h", None)]
    got = {(r["kind"], r["region_id"], r["docs"]) for r in findings(nodes, spark.createDataFrame(rows, "rel_path string, region_id int"), fat_at=3).collect()}
    assert got == {("fat-branch", "1", 3), ("singularity", "2", 1), ("empty-node", "4", 0), ("scope-drift", "3", 2), ("unassigned", "unassigned", 1)}


def test_collapse_and_counts(spark):
    rows = [(i, ["sports", "hockey"]) for i in range(12)] + [(20 + i, ["sports", "bowling", "x"]) for i in range(2)] + [(30, ["music"])]
    df = spark.createDataFrame(rows, "id int, path array<string>")
    homes = {tuple(r["home"]) for r in collapse_homes(df, "id").collect()}
    assert homes == {("sports", "hockey"), ("sports",), ("music",)}
    assert {tuple(r["prefix"]): r["n"] for r in prefix_counts(df).collect()}[("sports",)] == 14


def test_fold_small_children(spark):
    nodes = spark.createDataFrame([(1, None, 1), (2, 1, 2), (3, 2, 3)], "id int, parent_id int, depth int")
    homes = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "rel_path string, region_id int")
    assert {tuple(r) for r in fold_small_children(nodes, homes).collect()} == {("a", 2), ("b", 2), ("c", 1)}


def test_rehome(spark):
    df = spark.createDataFrame([(1, ["tech", "windows", "drivers"]), (2, ["tech", "macos"]), (3, ["tech", "linux"])], "id int, home array<string>")
    got = {r["id"]: (r["home"], r["facet"], r["moved"]) for r in rehome(df, "id", ["tech"], ["windows", "macos"], "systems").collect()}
    assert got == {1: (["tech", "systems", "windows"], "drivers", True), 2: (["tech", "systems", "macos"], None, True), 3: (["tech", "linux"], None, False)}


def test_merge_groups():
    assert merge_groups([(["a"], "x")], ["a", "b"]) == []
    assert merge_groups([(["a", "b"], "x")], ["a", "b"]) == []
    assert merge_groups([(["a", "b"], "x"), (["b", "c"], "y")], ["a", "b", "c"]) == [(["a", "b"], "x")]


def test_walk_fold_reuses_what_came_before(spark):
    rows = [("d1", 1, "sport", "hockey", ""), ("d2", 2, "sport", "ice-hockey", "cup"), ("d3", 3, "", "x", ""), ("d4", 1, "art", "", "")]
    df = spark.createDataFrame(rows, "id string, o int, main string, sub string, detail string")
    got = {r["id"]: (r["home"], r["actions"]) for r in walk_fold(df, "id", "main", ["o"], ["sub", "detail"]).collect()}
    assert got["d2"] == (["sport", "hockey", "cup"], ["reuse", "invent"])
    assert got["d3"][0] == ["unmapped"] and got["d4"] == (["art"], ["empty"])
