import json

import pytest

from docloom.plans import pipeline as R
from docloom.sources.state import work_list


@pytest.fixture(scope="module")
def reviewed(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("run")
    intake, out = base / "in", base / "out"
    (intake / "sub").mkdir(parents=True)
    (intake / "budget.txt").write_text("The budget and the budget of the grants office for staff. SSN 123-45-6789.")
    (intake / "sub" / "trip.txt").write_text("The travel and the travel of visitors: hotel, itinerary and training for staff.")
    (intake / "sub" / "broken.docx").write_bytes(b"no archive")
    (intake / "mine.txt").write_text("my family recipe for soup, and my holiday at home with soup")
    return intake, out, R.run(spark, str(intake), str(out))


def test_one_run_gives_all_reports(spark, reviewed):
    _, out, taken = reviewed
    assert taken == {"ledger": 4, "first-pass": 3, "second-pass": 3, "placement": 3, "rich-tags": 3, "layers": 3}
    assert "budget.txt" in (out / "PII-MAP.md").read_text() and "trip.txt" not in (out / "PII-MAP.md").read_text()
    queue = (out / "REVIEW-QUEUE.md").read_text()
    assert "sub/broken.docx | extract failed" in queue and "mine.txt" in queue and "budget.txt" not in queue
    for name in ("SUMMARY", "DOCUMENT-MAP", "DELETE-CANDIDATES", "TAGS", "TOPIC-MAP"):
        assert (out / f"{name}.md").read_text().startswith("# ")
    assert spark.read.json(str(out / "decisions")).count() == 4 and spark.read.json(str(out / "tags")).count() == 3


def test_a_second_run_does_nothing(spark, reviewed):
    intake, out, _ = reviewed

    def never(prompts):
        raise AssertionError("no model may be asked")

    assert not any(R.run(spark, str(intake), str(out), model=never).values())
    assert [p.name for p in (out / "ledger").iterdir() if p.name.startswith("v=")] == ["v=0"]
    (intake / "budget.txt").write_text("Another text about the purchasing of chairs for partners, with chairs.")
    assert R.run(spark, str(intake), str(out))["first-pass"] == 1
    assert not any(R.run(spark, str(intake), str(out), priors_only=True).values())


def test_tree_audit_and_names(spark, reviewed):
    _, out, _ = reviewed
    assert R.walk(spark, str(out)).count() >= 3 and (out / "REGIONS.md").read_text().startswith("- ")
    log = R.audit(spark, str(out))
    assert log[-1]["stop"] and all((out / name).exists() for name in ("AUDIT.md", "AUDIT-PLAN.md", "AUDIT-GRAPH.md", "regions.yml"))
    assert R.maintain(spark, str(out), least=1).columns == ["parent", "name", "into"]
    assert R.census(spark, str(out)).columns == ["level", "name", "into"]
    same = {r["side"]: (r["documents"], r["same"]) for r in R.compare(spark, str(out), str(out), str(out)).collect()}
    assert list(same) == ["both"] and same["both"][0] == same["both"][1]
    assert {r["step"] for r in R.progress(spark, str(out)).collect()} >= {"ledger", "layers"}


def test_failing_model_leaves_the_rest(spark, tmp_path):
    intake = tmp_path / "in"
    intake.mkdir()
    (intake / "a.txt").write_text("a text about the budget and the budget of chairs")
    (intake / "b.txt").write_text("a text about nothing that can be named at all")

    def half(prompts):
        return prompts.map(lambda p: "garbage" if "b.txt" in p else json.dumps({"tags": ["x"], "primary_tag": "x"}))

    R.run(spark, str(intake), str(tmp_path / "out"), model=half)
    got = {r["primary_tag"]: r["status"] for r in R.stage_rows(spark, str(tmp_path / "out"), "first-pass").collect()}
    assert got == {"x": "done", None: "skipped"}
    assert "pass 1 skipped" in (tmp_path / "out" / "REVIEW-QUEUE.md").read_text()


def test_search_spike_and_stream(spark, reviewed, tmp_path):
    intake, _, _ = reviewed
    assert R.find(spark, str(intake), str(tmp_path)).where("rel_path LIKE '%trip.txt'").count() == 1
    rows = R.spike(spark, str(intake), str(tmp_path)).collect()
    assert len(rows) == 3 and all(r["main"] for r in rows)
    states = {r["state"] for r in R.watch(spark, str(intake), str(tmp_path), files_per_batch=2)}
    assert "started" in states and "| high | 0 |" not in (tmp_path / "STREAM.md").read_text()
    first = (tmp_path / "STREAM.md").read_text()
    R.watch(spark, str(intake), str(tmp_path), files_per_batch=2)
    assert (tmp_path / "STREAM.md").read_text() == first


def test_commands(capsys):
    R.main(["list"])
    assert "review_queue" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        R.main(["nothing"])


def test_work_list(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 1), ("b", 2)], "rel_path string, n int")
    assert [r["rel_path"] for r in work_list(None, rows.limit(0), rows).collect()] == ["a", "b"] and work_list(rows.limit(0)) is None
