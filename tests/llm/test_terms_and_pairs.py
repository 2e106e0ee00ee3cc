import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from docloom.llm.cooccurrence import basket_pairs, frequent_pairs, term_baskets
from docloom.llm.term_frequency import explode_terms, field_totals, mark_terms, term_frequency

SCHEMA = "field string, record string, term string"


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [("f", f"r{rng.randrange(30)}", rng.choice("aaaabcdefg")) for _ in range(600)]
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_frequency(spark.createDataFrame(rows, SCHEMA), salts=3).collect()}
    occurrences = Counter(t for _, _, t in rows)
    records = {t: len({r for _, r, x in rows if x == t}) for t in occurrences}
    assert got == {t: (n, records[t]) for t, n in occurrences.items()}


def test_hot_term_is_spread(spark):
    rows = spark.range(3000).select(F.lit("f").alias("field"), (F.col("id") % 1000).cast("string").alias("record"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("term"))
    got = {r["term"]: r["records"] for r in term_frequency(rows).where("term = 'hot'").collect()}
    assert got == {"hot": 1000}


def test_edge_rows_of_counts(spark):
    rows = [("f", None, "a"), ("f", "r", None), ("f", "r", ""), ("f", "r", "a"), ("f", "r", "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_salt", F.lit(9)).withColumn("occurrences", F.lit("clash"))
    assert [tuple(r) for r in term_frequency(df).collect()] == [("f", "a", 2, 1)]
    assert term_frequency(df.limit(0)).count() == 0


def test_explode_and_marks(spark):
    rows = [(f"d{i}", ["Common", "common!", None, "--", f"only {i}"]) for i in range(30)] + [("e", None), ("g", [])]
    tokens = explode_terms(spark.createDataFrame(rows, "doc_id string, tags array<string>"), "doc_id", F.col("tags"), "tags")
    marks = {r["term"]: r["marks"] for r in mark_terms(term_frequency(tokens), field_totals(tokens)).collect()}
    assert marks["common"] == ["common"] and marks["only-3"] == ["rare"] and len(marks) == 31


def brute_pairs(baskets, least, share):
    n = len(baskets)
    single = Counter(t for b in baskets for t in set(b))
    both = Counter(p for b in baskets for p in combinations(sorted(set(b)), 2))
    return {(a, b): (n, single[a], single[b], k) for (a, b), k in both.items() if k >= least and k >= share * n}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    baskets = [rng.choices("abcdefghijkl", k=rng.randrange(1, 7)) for _ in range(200)] + [["x", "y", "z"]] * 100
    rows = [("f", str(i), t) for i, b in enumerate(baskets) for t in b]
    got = {(r["item_a"], r["item_b"]): (r["n"], r["a"], r["b"], r["ab"]) for r in frequent_pairs(spark.createDataFrame(rows, SCHEMA), 5, 0.02).collect()}
    assert got == brute_pairs(baskets, 5, 0.02)


def test_pair_measures_and_edges(spark):
    rows = [("f", str(i), t) for i in range(6) for t in ("a", "b")] + [("f", "z", "c"), ("f", None, "a"), ("f", "y", None), ("f", "y", "")]
    r = frequent_pairs(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r["n"], r["ab"]) == (7, 6) and abs(r["lift"] - 7 / 6) < 1e-9 and r["conviction"] is None
    assert frequent_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_baskets_of_arrays(spark):
    df = spark.createDataFrame([("d", ["B b", "a", "A", None, "--"], None), ("e", [], ["x"]), (None, ["q"], ["q"])], "doc_id string, tags array<string>, field array<string>")
    got = term_baskets(df, "doc_id", {"tags": F.col("tags"), "other": F.col("field")})
    assert sorted((r["field"], str(r["record"]), r["basket"]) for r in got.collect()) == [("other", "None", ["q"]), ("other", "e", ["x"]), ("tags", "None", ["q"]), ("tags", "d", ["a", "b-b"])]
    assert basket_pairs(got).count() == 0


def test_long_baskets_and_hot_copies(spark):
    rng = random.Random(4)
    baskets = [[f"t{rng.randrange(2000)}" for _ in range(60)] for _ in range(300)] + [["hot-1", "hot-2", *[f"t{i}" for i in range(40)]]] * 200
    df = spark.createDataFrame([("f", str(i), sorted(set(b))) for i, b in enumerate(baskets)], "field string, record string, basket array<string>")
    got = {(r["item_a"], r["item_b"]): (r["n"], r["a"], r["b"], r["ab"]) for r in basket_pairs(df, 5, 0.02).collect()}
    assert got == brute_pairs(baskets, 5, 0.02)
