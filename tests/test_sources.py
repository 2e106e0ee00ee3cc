import pytest
import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from docloom.models.step import keyword_model, merge_chunk_answers, run_model
from docloom.plans.pipeline import run
from docloom.functions.textops import names_in_filename
from docloom.operators.tree import depth_first, revise
from docloom.sinks.reports import chart_html, markdown_table, move_plan, safe_sidecar, tree_text
from docloom.sources.files import expand_archives, extract, inventory
from docloom.sources.state import first_available, flatten_trees, read_state, vocabulary
from docloom.streaming.ingest import new_documents, record_stream, run_into, upsert_batches, upserted


def office(kind: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if kind == "docx":
            z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>Hello</w:t></w:p><w:p><w:t>there</w:t></w:p></w:d>')
        if kind == "pptx":
            for n in (2, 10):
                z.writestr(f"ppt/slides/slide{n}.xml", f'<p xmlns:a="u"><a:t>slide {n}</a:t></p>')
        if kind == "xlsx":
            z.writestr("xl/sharedStrings.xml", '<s xmlns="u"><si><t>cell</t></si></s>')
    return out.getvalue()


def make_dump(root):
    (root / "sub").mkdir()
    (root / "page_files").mkdir()
    files = {"2023-W2-notes.txt": b"SSN 123-45-6789", "sub/meeting.md": b"nothing here to see", "sub/bad.txt": b"caf\xe9", "README.md": b"skip", "x.js": b"skip", ".hidden": b"skip", "page_files/a.txt": b"skip", "blank.txt": b"  \n"}
    files |= {"a.docx": office("docx"), "b.pptx": office("pptx"), "c.xlsx": office("xlsx"), "d.png": b"\x89PNG", "e.pdf": b"%PDF-broken", "f.html": b"<p>Hi</p>", "copy.txt": b"SSN 123-45-6789"}
    for name, content in files.items():
        (root / name).write_bytes(content)
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        z.writestr("../escape.txt", "out")
        z.writestr("ok/in.txt", "inside the archive")
    (root / "broken.zip").write_bytes(b"PK nothing")


def test_extract_dump(spark, tmp_path):
    make_dump(tmp_path)
    rows = {r["rel_path"]: r for r in extract(expand_archives(inventory(spark, str(tmp_path)))).collect()}
    assert "README.md" not in rows and "x.js" not in rows and ".hidden" not in rows and "page_files/a.txt" not in rows
    assert rows["a.docx"]["text"] == "Hello\nthere" and rows["c.xlsx"]["text"] == "cell"
    assert rows["b.pptx"]["text"] == "slide 10\n\nslide 2"
    assert rows["sub/bad.txt"]["text"] == "caf�" and rows["f.html"]["text"] == "Hi"
    assert rows["z.zip/ok/in.txt"]["text"] == "inside the archive" and not any("escape" in k for k in rows)
    assert rows["blank.txt"]["extraction_error"] == "no text extracted" and rows["blank.txt"]["extraction_method"] == "text"
    for bad in ("d.png", "e.pdf"):
        assert rows[bad]["extraction_ok"] is False and rows[bad]["extraction_error"]


def test_pipeline_keeps_versions(spark, tmp_path):
    intake, out = tmp_path / "in", tmp_path / "out"
    intake.mkdir()
    make_dump(intake)
    run(spark, str(intake), str(out))
    first = spark.read.parquet(f"{out}/ledger/v=0")
    doc = first.where("rel_path = 'copy.txt'").first()
    assert doc["severity"] == "high" and first.where("content_hash = '%s'" % doc["content_hash"]).count() == 1
    (intake / "new.txt").write_text("a new file")
    run(spark, str(intake), str(out))
    actions = {r["merge_action"] for r in spark.read.parquet(f"{out}/ledger/v=1").collect()}
    assert actions == {"same", "insert"}
    assert "high" in (out / "SUMMARY.md").read_text()


def test_model_step_and_merge(spark):
    df = spark.createDataFrame([(1, 0, "budget and travel"), (1, 1, "budget"), (2, 0, None)], "id int, n int, text string")
    calls = run_model(df.withColumn("k", F.concat_ws("-", "id", "n")), "k", "text", keyword_model({"money": "budget", "trip": "travel"}))
    answers = calls.select(F.split("k", "-")[0].cast("int").alias("id"), F.split("k", "-")[1].cast("int").alias("n"), "answer")
    got = {r["id"]: r for r in merge_chunk_answers(answers, "id", "n").collect()}
    assert got[1]["tags"] == ["money", "trip"] and got[1]["confidence"] == "medium" and got[1]["chunk_count"] == 2
    assert got[2]["tags"] == ["unknown"] and got[2]["confidence"] == "low"


def test_failing_model_is_an_answer(spark):
    def broken(prompts: pd.Series) -> pd.Series:
        raise TimeoutError("no answer")

    got = run_model(spark.createDataFrame([("a", "p")], "k string, p string"), "k", "p", broken).first()
    assert "no answer" in json.loads(got["answer"])["error"]


def test_sinks(spark):
    df = spark.createDataFrame([("a/x.txt",), ("b/x.txt",), ("../up.txt",), ("/abs.txt",)], "p string")
    assert [r["s"] for r in df.select(safe_sidecar(F.col("p")).alias("s")).collect()] == ["a/x.txt.json", "b/x.txt.json", None, None]
    assert {r["destination"] for r in move_plan(df, "p", "q").collect()} == {"q/x.txt", "q/x.txt.dup2"}
    assert "further rows" in markdown_table(df, "T", most=2)


def test_stream_keeps_last_row(spark, tmp_path):
    source, schema = tmp_path / "src", "k string, n int, at timestamp"
    for i, rows in enumerate([[("a", 1, 1), ("b", 1, 1)], [("a", 2, 5)], [("a", 0, 2)]]):
        df = spark.createDataFrame(rows, "k string, n int, s int").withColumn("at", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(source))
    records = record_stream(spark, str(source), spark.read.parquet(str(source)).schema)
    run_into(records, str(tmp_path / "cp"), upsert_batches(str(tmp_path / "out"), "k", "at")).awaitTermination()
    assert {(r["k"], r["n"]) for r in upserted(spark, str(tmp_path / "out"), records.schema).collect()} == {("a", 2), ("b", 1)}
    assert new_documents(record_stream(spark, str(source), spark.read.parquet(str(source)).schema), "at", key="k").isStreaming
    assert schema


def test_trees_and_pages(spark):
    tree = json.dumps([{"id": "a", "label": "A<b>", "tags": ["x", ""], "children": [{"id": "b"}, {"label": "no id", "children": [{"id": "lost"}]}]}, {"id": "c"}])
    flat = flatten_trees(spark.createDataFrame([(tree,), ("not json",), (None,)], "tree string"))
    assert [(r["id"], r["parent_id"], r["depth"], r["tags"]) for r in flat.orderBy("pos").collect()] == [("a", None, 1, ["x"]), ("b", "a", 2, []), ("c", None, 1, [])]
    text = tree_text(depth_first(flat.select("id", "parent_id", "label"), "label", ["a"]))
    assert text == "- c\n- A<b>\n  - b\n"
    rings = spark.createDataFrame([(0, "root", "", "All", 3), (1, "a", "root", "A<b>", 2)], "ring int, id string, parent string, label string, value long")
    page = chart_html(rings, "T")
    assert "A&lt;b&gt; (2)" in page and page.index("All") < page.index("A&lt;")


def test_revise(spark):
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, None, "d")], "id int, parent_id int, label string")
    changes = spark.createDataFrame([(2, "dissolve", None, None), (4, "split", None, ["New part"]), (1, "rename", "A", None)], "id int, action string, label string, parts array<string>")
    out, to = revise(nodes, changes)
    assert {tuple(r) for r in out.collect()} == {("1", None, "A"), ("4", None, "d"), ("4--new-part", "4", "New Part")}
    assert {tuple(r) for r in to.collect()} == {(2, 1), (3, 1)}


def test_state_file(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"version": 1, "items": [{"k": "a"}, {"k": "b"}], "documents": {"x": {"n": 1}, "y": {"n": 2}}}))
    assert read_state(spark, str(tmp_path / "s.json"), "items").count() == 2
    assert {r["key"] for r in read_state(spark, str(tmp_path / "s.json"), "documents").collect()} == {"x", "y"}
    empty = spark.createDataFrame([], "a int")
    assert first_available(None, empty, spark.range(2)).count() == 2 and first_available(empty) is None
    assert vocabulary(spark, {"f": {"t": "about"}}).count() == 2


def test_names_in_filename(spark):
    df = spark.createDataFrame([("a/Travel Form_Jane Q Doe.pdf",), ("b/notes.txt",)], "p string")
    assert [r["n"] for r in df.select(names_in_filename(F.col("p")).alias("n")).collect()][1] == []


def test_pdf_readers_in_turn(monkeypatch):
    from docloom.sources import files

    def missing(content):
        raise ImportError

    def broken(content):
        raise OSError("damaged")

    monkeypatch.setattr(files, "PDF_READERS", [("a", missing), ("b", broken), ("c", lambda c: "short"), ("d", lambda c: "long enough to be taken for the text of a page")])
    assert files.pdf_text(b"%PDF")[1] == "d"
    monkeypatch.setattr(files, "PDF_READERS", [("b", broken), ("c", lambda c: "short")])
    assert files.pdf_text(b"%PDF") == ("short", "c")
    for readers, message in (([("b", broken)], "damaged"), ([("a", missing)], "no PDF reader")):
        monkeypatch.setattr(files, "PDF_READERS", readers)
        with pytest.raises(ValueError, match=message):
            files.pdf_text(b"%PDF")
    with pytest.raises(ValueError, match="locked"):
        files.pdf_text(b"%PDF /Encrypt")


def test_files_behind_a_client(spark, tmp_path):
    from docloom.sources.remote import fetch, remote_listing, trash_plan

    (tmp_path / "p_files").mkdir()
    for name in ("a.txt", "b c.txt", "p_files/x.txt"):
        (tmp_path / name).write_text(f"text of {name}")
    paths = remote_listing(spark, f"find {tmp_path} -name '*.txt' -printf '%P\\n'")
    assert sorted(r["rel_path"] for r in paths.collect()) == ["a.txt", "b c.txt"]
    more = paths.unionByName(spark.createDataFrame([("gone.txt",)], "rel_path string"))
    got = {r["rel_path"]: (r["content"] and bytes(r["content"]), bool(r["error"])) for r in fetch(more, ["no-such-client {path}", f"cat {tmp_path}/{{path}}"]).collect()}
    assert got == {"a.txt": (b"text of a.txt", False), "b c.txt": (b"text of b c.txt", False), "gone.txt": (None, True)}
    assert trash_plan(paths).where("command LIKE '%a.txt'").count() == 1


def test_decisions_in_files_of_their_own(spark, tmp_path):
    from docloom.sinks.reports import write_decision_index, write_regions, write_sidecars

    df = spark.createDataFrame([("a/x.txt", '{"k": 1}'), ("../up.txt", "{}"), ("b.txt", None)], "p string, r string")
    assert {r["path"]: r["written"] for r in write_sidecars(df, "p", "r", str(tmp_path / "d")).collect()} == {"a/x.txt": True, "../up.txt": False, "b.txt": True}
    assert (tmp_path / "d" / "a" / "x.txt.json").read_text() == '{"k": 1}' and not (tmp_path / "up.txt.json").exists()
    write_decision_index(df, str(tmp_path / "index"))
    assert spark.read.json(str(tmp_path / "index" / "manifest")).first()["documents"] == 3
    nodes = depth_first(spark.createDataFrame([("a", None, "A"), ("b", "a", "B: c")], "id string, parent_id string, label string"), "label", [])
    write_regions(nodes, str(tmp_path / "tree"))
    assert (tmp_path / "tree" / "regions.yml").read_text() == '- {id: "a", label: "A"}\n  - {id: "b", label: "B: c"}\n'
    assert spark.read.json(str(tmp_path / "tree" / "regions")).count() == 2
