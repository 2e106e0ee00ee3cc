from docloom.operators.concepts import clusters


def run(spark, n, pairs, most):
    named = spark.createDataFrame([(f"c{i:03}", f"c{i:03}", 1000 - i) for i in range(n)], "concept_id string, preferred string, docs long")
    edges = spark.createDataFrame([(f"c{a:03}", f"c{b:03}") for a, b in pairs], "a string, b string")
    return {int(r["concept_id"][1:]): int(r["seed"][1:]) for r in clusters(named, edges, most_members=most).collect()}


def test_no_concept_of_a_large_family_is_lost(spark):
    n = 102
    assert run(spark, n, [(a, b) for b in range(n) for a in range(b)], 200) == dict.fromkeys(range(n), 0)


def test_a_seed_keeps_its_first_neighbours(spark):
    """3 waits for 2, which waits for 1; 4 is ready sooner, but 3 is before it."""
    assert run(spark, 5, [(1, 2), (0, 3), (2, 3), (0, 4)], 2) == {0: 0, 1: 1, 2: 1, 3: 0, 4: 4}
