import random

import numpy as np

from docloom.llm.subjects import assign_subjects, features, subject_makeup, train_subjects

VOCABULARY = {"law": "court lease clause verdict tribunal statute".split(), "sport": "team goal coach match league paddle".split(), "software": "server kernel patch compiler cache schema".split()}
OFFICE = "the box is next to that desk and goes over there by friday".split()


def sentence(rng, subject):
    return " ".join([*rng.sample(OFFICE, 4), *(rng.sample(VOCABULARY[subject], 3) if subject else rng.sample(OFFICE, 3))]) + "."


def tables(spark, n=240):
    rng = random.Random(3)
    texts, labels, layers, truth = [], [], [], {}
    for i in range(n):
        subjects = rng.sample(list(VOCABULARY), rng.choice([0, 1, 1, 1, 2]))
        parts = [sentence(rng, s) for s in subjects for _ in range(6)] + [sentence(rng, None) for _ in range(4)]
        if rng.random() < 0.3:
            parts.append(sentence(rng, rng.choice(list(VOCABULARY))))  # a passing mention
        rng.shuffle(parts)
        texts.append((i, f"d{i}", " ".join(parts)))
        truth[i] = set(subjects)
        if i % 3 == 0:
            labels += [(i, s.upper() if rng.random() < 0.3 else s) for s in subjects]
        main = {"law": "Contracts", "sport": "leagues", "software": "it_desk"}.get(subjects[0] if subjects else "", "operations")
        layers.append((f"d{i}", main))
    texts += [(9000, None, None), (9001, "d1", ""), (9002, "zz", "word " * 20_000), (None, None, "The court and the lease. The verdict of the tribunal.")]
    t = spark.createDataFrame(texts, "extract_id long, doc_id string, text string")
    lab = spark.createDataFrame(labels + [(1, None), (2, "no such")], "extract_id long, subject string")
    lay = spark.createDataFrame(layers, "doc_id string, main string").selectExpr("*", "timestamp'2024-01-01' AS stamped_at")
    areas = spark.createDataFrame([(1, "law"), (2, "sport"), (3, "software")], "subject_id int, subject string")
    return t, lab, lay, areas, truth


def test_held_out_accuracy(spark):
    t, lab, lay, areas, truth = tables(spark)
    model = train_subjects(t, lab, lay, areas)
    got = {}
    rows = assign_subjects(t, model)
    for r in rows.collect():
        got.setdefault(r["extract_id"], set()).add(r["subject"])
    held_out = [i for i in truth if i % 3]
    assert np.mean([got.get(i, set()) == truth[i] for i in held_out]) > 0.95
    assert not {9000, 9001} & set(got)
    makeup = {r["subject"]: r["texts"] for r in subject_makeup(rows, t).collect()}
    assert makeup[None] == t.count() - len(got)


def test_no_labels_and_no_texts(spark):
    t, lab, lay, areas, _ = tables(spark, 12)
    assert assign_subjects(t, train_subjects(t.limit(0), lab.limit(0), lay.limit(0), areas)).count() == 0
    assert assign_subjects(t.limit(0), train_subjects(t, lab.limit(0), lay, areas)).count() == 0


def test_sentences_and_hashes():
    feats, first, text = features(["One two three four. Short one. Five six seven eight nine", "ONE TWO THREE FOUR!"])
    assert text.tolist() == [0, 0, 1] and first.tolist() == [0, 4, 9]
    assert (feats[:4, 0] == feats[9:, 0]).all() and feats[0, 1] == -1
    assert len(features([""])[1]) == 0 and len(features(["\0.\0"])[1]) == 0
