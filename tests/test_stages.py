import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.models import stages as S
from docloom.sources.state import flatten_trees


def fixed(answer):
    return lambda prompts: prompts.map(lambda p: answer if isinstance(answer, str) else json.dumps(answer(json.loads(p))))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a", "x/a.txt", ["w2"], "The budget and the budget of the grants office for 2024, near Harrow Vale.", ["ssn"]), ("b", "x/b.txt", [], "", []), ("c", "x/c.txt", None, None, None)]
    return spark.createDataFrame(rows, "id string, rel_path string, hints array<string>, text string, kinds array<string>")


def by(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_first_pass_and_merge(spark, docs):
    got = by(S.first_pass(docs, "id"))
    assert got["a"]["tags"][0] == "budget" and got["a"]["custody"] == "work" and got["b"]["custody"] == "unclear" and got["c"]["tags"] == []
    wild = by(S.first_pass(docs, "id", fixed('Sure:\n```json\n{"tags": ["A b", "a-B", null], "custody": "MINE", "confidence": "High",}\n```')))
    assert wild["a"]["tags"] == ["a-b"] and wild["a"]["custody"] == "unclear" and wild["a"]["confidence"] == "high" and wild["a"]["readable"]
    parts = spark.createDataFrame(
        [("a", 1, True, ["x", "y"], "x", "work", "high", "one"), ("a", 2, True, ["y", "z"], "z", "personal", "low", "two"), ("b", 1, True, [], "", "unclear", "medium", ""), ("c", 1, False, [], "", "unclear", "low", "")],
        "id string, n int, readable boolean, tags array<string>, primary_tag string, custody string, confidence string, summary string",
    )
    m = by(S.merge_first_pass(parts, "id", "n"))
    assert (m["a"]["tags"], m["a"]["primary_tag"], m["a"]["custody"], m["a"]["confidence"], m["a"]["summary"], m["a"]["chunk_count"]) == (["x", "y", "z"], "x", "personal", "low", "one two", 2)
    assert m["b"]["tags"] == ["unknown"] and set(m) == {"a", "b"}


def test_unreadable_answers_are_asked_again(spark, docs, tmp_path):
    log = str(tmp_path / "asked")

    def flaky(prompts: pd.Series) -> pd.Series:
        with open(log, "a+") as f:
            f.seek(0)
            before = f.read()
            out = []
            for p in prompts:
                key = json.loads(p)["path"] or ""
                out.append('{"tags": ["ok"]}' if key in before or key.endswith("b.txt") else "no json" if key.endswith("a.txt") else '{"error": "down"}')
                f.write(key)
        return pd.Series(out)

    got = by(S.first_pass(docs, "id", flaky))
    assert {k: (r["readable"], r["tags"]) for k, r in got.items()} == {k: (True, ["ok"]) for k in "abc"}
    assert not any(r["readable"] for r in S.first_pass(docs, "id", fixed("never json")).collect())


def test_second_pass_and_placements(spark, docs):
    first = docs.withColumns({"primary_tag": F.lit("budget"), "custody": F.lit("work"), "confidence": F.lit("high")})
    got = by(S.second_pass(first, "id"))
    assert got["a"]["recommendation"] == "keep" and got["a"]["rationale"] == "first pass: budget"
    assert by(S.second_pass(first, "id", fixed('{"recommendation": "burn it"}')))["a"]["recommendation"] == "review"
    facets = {"program": ["grants", "sport"], "function": ["budget"], "audience": ["staff"]}
    p = by(S.placements(docs, "id", facets))
    assert (p["a"]["program"], p["a"]["function"], p["a"]["audience"], p["a"]["needs_review"]) == (["grants"], ["budget"], ["unmapped"], False)
    assert p["b"]["program"] == ["unmapped"] and p["b"]["needs_review"]
    odd = by(S.placements(docs, "id", facets, fixed('{"program": ["sport", "x", "grants", "sport"], "confidence": 7}')))
    assert odd["a"]["program"] == ["sport", "grants"] and odd["a"]["confidence"] == 1.0 and odd["a"]["needs_review"]


def test_rich_tags_and_stitch(spark, docs):
    r = by(S.rich_tags(docs, "id"))
    assert r["a"]["years"] == ["2024"] and r["a"]["entities"] == ["Harrow Vale"] and r["b"]["needs_review"]
    inventory = spark.createDataFrame([("lab-plan", 9), ("lab-list", 3), ("tax", 5), ("lab-rare", 1)], "tag string, docs long")
    tree = flatten_trees(S.stitched(inventory))
    assert [(x["id"], x["tags"]) for x in tree.collect()] == [("lab", ["lab-list", "lab-plan"])]


def test_clerk_and_layers(spark, docs):
    homes = [("grants-desk", "Grants desk"), ("budget", "Budget")]
    assert {k: r["home"] for k, r in by(S.clerk_homes(docs, "id", homes)).items()} == {"a": "budget", "b": "unmapped", "c": "unmapped"}
    assert by(S.clerk_homes(docs, "id", homes, fixed('{"home": " grants DESK "}')))["a"]["home"] == "grants-desk"
    assert by(S.clerk_homes(docs, "id", homes, fixed('{"home": "elsewhere"}')))["a"]["home"] == "unmapped"
    got = by(S.layer_names(docs, "id", ["budget"]))
    assert got["a"]["path"][0] == "budget" and len(got["a"]["path"]) == 3 and got["b"]["path"] == []
    assert by(S.layer_names(docs, "id", [], fixed('{"main": "usenet", "sub": "x"}')))["a"]["path"] == []
    assert by(S.layer_names(docs, "id", [], fixed('{"main": "Tools", "sub": "tools", "detail": "Saws"}'), "spike"))["a"]["path"] == ["tools", "saws"]


def test_combining_names(spark):
    levels = spark.createDataFrame([("r", ["lab-a", "lab-b", "tax"], [3, 2, 1]), ("one", ["x-a", "x-b"], [1, 1]), ("none", [], [])], "id string, names array<string>, counts array<long>")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(S.combined(levels, "id", "maintain")) == [("r", "lab-a", "lab"), ("r", "lab-b", "lab")]
    assert ("one", "x-a", "x") in rows(S.combined(levels, "id", "roll-up", leave_one=False))
    odd = fixed('{"groups": [{"merge": ["lab-a", "nowhere", "tax"], "into": "Office Lab"}, {"merge": ["tax", "lab-b"], "into": "misc"}, {"merge": null}]}')
    assert rows(S.combined(levels, "id", "census", odd)) == [("r", "lab-a", "office-lab"), ("r", "tax", "office-lab")]
    files = levels.withColumn("files", F.array(F.lit("a/b.txt"), F.lit("c.txt")))
    assert by(S.wanted(files, "id", "files", fixed('{"need_files": ["./c.txt", "zzz", "c.txt"]}')))["r"]["files"] == ["c.txt"]


def test_audit_and_revise(spark):
    chunks = spark.createDataFrame([("tax#01", "tax", [("tax/a.txt", ["tax-form"]), ("x/lab.txt", ["lab-plan"])])], "chunk_id string, region string, files array<struct<rel_path:string,tags:array<string>>>")
    got = {r["rel_path"]: (r["verdict"], r["better_home"]) for r in S.chunk_verdicts(chunks, ["tax", "lab"]).collect()}
    assert got == {"tax/a.txt": ("confirm", None), "x/lab.txt": ("wrong-parent", "lab")}
    groups = spark.createDataFrame([("a", "Alpha", ["m1", "m2"]), ("b", "Beta", ["m1"])], "id string, label string, members array<string>")
    assert {k: r["action"] for k, r in by(S.revisions(groups, "id")).items()} == {"a": "keep", "b": "dissolve"}
    assert by(S.revisions(groups, "id", fixed('{"action": "explode", "parts": ["A b", "a-b"]}')))["a"]["parts"] == ["a-b"]
