from docloom.llm import subjects


def test_a_hot_document_keeps_no_labelled_row_out(spark, monkeypatch):
    """Rows are bounded, not documents, and hand-labelled rows have a bound of their own."""
    text = "The court and the lease of the tribunal. The verdict on that clause and the statute."
    hot = [(i, "hot", text) for i in range(400)]
    hand = [(1000 + i, f"d{i}", text) for i in range(15)]
    t = spark.createDataFrame(hot + hand, "extract_id long, doc_id string, text string")
    lab = spark.createDataFrame([(1000 + i, "law") for i in range(15)], "extract_id long, subject string")
    lay = spark.createDataFrame([("hot", "contracts"), ("d0", "contracts")], "doc_id string, main string").selectExpr("*", "timestamp'2024-01-01' AS stamped_at")
    areas = spark.createDataFrame([(1, "law"), (2, "sport")], "subject_id int, subject string")
    seen = {}
    monkeypatch.setattr(subjects, "fit", lambda feats, first, doc, prior, truth, names, held, group: seen.update(rows=len(prior), labelled=len(truth)))
    subjects.train_subjects(t, lab, lay, areas, labelled_rows=20, hinted_rows=30)
    assert seen == {"rows": 45, "labelled": 15}


def test_a_model_is_stored_whole(spark, tmp_path):
    import numpy as np

    model = subjects.Model(["law", "sport"], np.arange(6, dtype=np.float32).reshape(3, 2), np.array([0.5, -1], dtype=np.float32), np.array([0.2, 0.3]))
    subjects.store_model(spark, model, str(tmp_path / "model"))
    again = subjects.stored_model(spark, str(tmp_path / "model"))
    assert again.names == model.names and all((getattr(again, k) == getattr(model, k)).all() for k in ("weights", "bias", "threshold"))


def test_more_subjects_than_any_limit(spark):
    areas = spark.createDataFrame([(i, f"s{i}") for i in range(300)], "subject_id int, subject string")
    t = spark.createDataFrame([(1, "d", "The court and the lease of the tribunal stand.")], "extract_id long, doc_id string, text string")
    lab = spark.createDataFrame([(1, "s299")], "extract_id long, subject string")
    lay = spark.createDataFrame([("d", "m")], "doc_id string, main string").selectExpr("*", "timestamp'2024-01-01' AS stamped_at")
    assert len(subjects.train_subjects(t, lab, lay, areas).names) == 300
