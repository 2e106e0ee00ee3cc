import pytest
from pyspark.sql import functions as F

from docloom.config import Settings, load
from docloom.functions.coercion import child_choice, clock, wanted_files
from docloom.operators.audit import apply_verdicts, audit_loop, flag_rates, mixed_groups, stop_reason, whole_verdicts
from docloom.operators.mapping import fattest_roots, remap, spread_in_clusters, tag_regions
from docloom.streaming.ingest import record_stream, run_into
from docloom.streaming.walk import walk_stream


def test_verdicts(spark):
    plan = spark.createDataFrame([("g#01", "a"), ("g#01", "b"), ("h#01", "c")], "chunk_id string, rel_path string")
    said = [("g#01", "a", "confirm", None), ("g#01", "z", "split", None), ("h#01", "c", "nonsense", "x")]
    whole = whole_verdicts(plan, spark.createDataFrame(said, "chunk_id string, rel_path string, verdict string, better_home string"))
    assert {(r["rel_path"], r["verdict"]) for r in whole.collect()} == {("a", "confirm"), ("b", "cannot-tell"), ("c", "cannot-tell")}
    assert flag_rates(whole).first()["flags"] == 2


def test_apply(spark):
    homes = spark.createDataFrame([("a", ["1"]), ("b", ["1"]), ("c", ["2"])], "rel_path string, region_ids array<string>")
    v = spark.createDataFrame([("1#01", "a", "wrong-parent", "2"), ("1#01", "b", "wrong-parent", "99"), ("2#01", "c", "confirm", None)], "chunk_id string, rel_path string, verdict string, better_home string")
    nodes = spark.createDataFrame([("1",), ("2",)], "id string")
    got = {r["rel_path"]: (r["region_ids"], r["applied"]) for r in apply_verdicts(homes, v, nodes).collect()}
    assert got == {"a": (["2", "1"], "moved"), "b": (["1"], "invalid-home"), "c": (["2"], "kept")}
    assert [tuple(r) for r in mixed_groups(v, ["9"]).collect()] == [("1", 2)]


def test_stop():
    assert stop_reason([0.2, 0.3], 1, 1) == "flags-rose"
    assert stop_reason([0.3, 0.2], 1, 3) == "max-rounds"
    assert stop_reason([0.3, 0.2], 0, 1) == "no-applies"
    assert stop_reason([0.1], 1, 1) == "flag-rate" and stop_reason([0.5], 1, 1) is None


def test_maps(spark):
    nodes = spark.createDataFrame([("r1", 1, ["a", "b"]), ("r2", 2, ["b", " "])], "region_id string, pos int, tags array<string>")
    syn = spark.createDataFrame([("a", "x"), ("y", "b"), ("q", "w")], "preferred string, alias string")
    assert {tuple(r) for r in tag_regions(nodes, syn).collect()} == {("a", "r1"), ("b", "r1"), ("x", "r1"), ("y", "r1")}
    members = spark.createDataFrame([("c", 1, "m"), ("c", 2, "a"), ("c", 3, "n")], "cluster string, pos int, tag string")
    mapped = spark.createDataFrame([("a", "r1")], "tag string, region_id string")
    assert {tuple(r) for r in spread_in_clusters(mapped, members).collect()} == {("a", "r1"), ("m", "r1"), ("n", "r1")}
    rows = spark.createDataFrame([(1, "a", "s"), (2, "a", "t"), (3, "b", "s")], "id int, main string, box string")
    groups = spark.createDataFrame([("a", "z", "s")], "name string, into string, scope string")
    got = {r["id"]: (r["main"], r["main_from"]) for r in remap(rows, "main", groups, "box").collect()}
    assert got == {1: ("z", "a"), 2: ("a", None), 3: ("b", None)}
    roots = spark.createDataFrame([("r", "x"), ("r", "y"), ("s", "z"), ("s", "z"), ("s", "z")], "root string, src string")
    assert [r["root"] for r in fattest_roots(roots, "root", "src").collect()] == ["r", "s"]


def test_settings(tmp_path):
    assert load(folder=str(tmp_path)) == Settings()
    (tmp_path / "docloom.toml").write_text("chunk_size = 5000\n")
    assert load(folder=str(tmp_path)).chunk_size == 5000
    (tmp_path / "bad.toml").write_text("nope = 1\n")
    with pytest.raises(ValueError):
        load(str(tmp_path / "bad.toml"))


def test_loop_ends_when_flags_are_few(spark):
    homes = spark.createDataFrame([(f"f{i}", ["1"]) for i in range(4)], "rel_path string, region_ids array<string>")
    nodes = spark.createDataFrame([("1",), ("2",)], "id string")

    def judge(df):
        wrong = (df["rel_path"] < "f2") & (df["region_ids"][0] == "1")
        return df.select(F.lit("1#01").alias("chunk_id"), "rel_path", F.when(wrong, "wrong-parent").otherwise("confirm").alias("verdict"), F.when(wrong, "2").alias("better_home"))

    last, log = audit_loop(homes, nodes, judge)
    assert [r["applied"] for r in log] == [2, 0] and log[-1]["stop"] == "no-applies" and log[-1]["rate"] == 0
    assert {r["rel_path"]: r["region_ids"][0] for r in last.collect()} == {"f0": "2", "f1": "2", "f2": "1", "f3": "1"}


def test_walk_stream_keeps_its_tree(spark, tmp_path):
    source = tmp_path / "src"
    for rows in ([("d1", "sport", "hockey", 1)], [("d2", "sport", "ice-hockey", 2), ("d3", "", "x", 2)]):
        spark.createDataFrame(rows, "id string, main string, sub string, o int").coalesce(1).write.mode("append").parquet(str(source))
    rows = record_stream(spark, str(source), spark.read.parquet(str(source)).schema)
    got = {}
    query = run_into(walk_stream(rows, "id", "main", "o", ["sub"]), str(tmp_path / "cp"), lambda df, n: got.update({r["id"]: r["home"] for r in df.collect()}))
    query.awaitTermination()
    assert got["d3"] == ["unmapped"] and got["d1"][0] == got["d2"][0] == "sport" and got["d1"] == got["d2"]


@pytest.mark.parametrize(("seconds", "text"), [(3723, "1h02m03s"), (63, "1m03s"), (5, "5s"), (-1, "0s")])
def test_clock(spark, seconds, text):
    assert spark.range(1).select(clock(F.lit(seconds))).first()[0] == text


def test_child_choice(spark):
    siblings, taken = F.array(F.lit("a"), F.lit("b"), F.lit("c")), ["sport"]
    for action, name, merge, expected in [
        ("combine", "new", ["a", "b", "z"], ("combine", "new", ["a", "b"])),
        ("combine", "new", ["a"], ("empty", "", [])),
        ("reuse", "A", [], ("reuse", "a", [])),
        ("reuse", "fresh", [], ("invent", "fresh", [])),
        ("invent", "misc", [], ("empty", "", [])),
        (None, "sport", None, ("empty", "", [])),
    ]:
        df = spark.createDataFrame([(action, name, merge)], "a string, n string, m array<string>")
        assert tuple(df.select(child_choice(F.col("a"), F.col("n"), F.col("m"), siblings, taken).alias("x")).first()["x"]) == expected
    files = spark.createDataFrame([(["./a.txt", "a.txt", "zz"], ["a.txt", "b"])], "x array<string>, y array<string>")
    assert files.select(wanted_files(F.col("x"), F.col("y"))).first()[0] == ["a.txt"]
