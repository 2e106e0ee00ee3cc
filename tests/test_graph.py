from docloom.operators.graph import browse_graph, compound_nodes


def tables(spark):
    nodes = spark.createDataFrame(
        [("housing", None, "Housing"), ("vehicles", None, "Vehicles"), ("repairs", "housing", "Vehicles repairs"), ("leases", "housing", "Leases"), ("garage", "vehicles", "Garage")],
        "id string, parent_id string, label string",
    )
    members = [("housing", f"d{i}") for i in range(12)] + [("vehicles", f"d{i}") for i in range(6, 14)] + [("repairs", f"d{i}") for i in range(5, 12)] + [("leases", f"d{i}") for i in range(8)] + [("repairs", "d5")]
    tags = [("housing-vehicles-plan", f"d{i}") for i in range(6)] + [("Housing/Vehicles note", "d9"), ("mobile-clinic-van", "c1")] + [("clinic visits", f"c{i}") for i in range(5)] + [("lease", "d1")]
    families = [("mobile-clinic", "Mobile clinic", ["clinic", "trailer"]), ("rare", "Rare", ["falcon"]), ("homes", "Homes", ["housing"])]
    return (
        nodes,
        spark.createDataFrame(members, "id string, doc string"),
        spark.createDataFrame(tags, "tag string, doc string"),
        spark.createDataFrame(families, "id string, label string, words array<string>"),
    )


def test_browse_graph(spark):
    nodes, members, tags, families = tables(spark)
    got = {r["id"]: (r["kind"], r["broader"], r["docs"]) for r in browse_graph(nodes, members, tags, families).collect()}
    assert got == {
        "housing": ("topic", [], 12),
        "vehicles": ("topic", [], 8),
        "mobile-clinic": ("topic", [], 5),
        "repairs": ("subtopic", ["housing", "vehicles"], 7),  # six shared documents and the word
        "leases": ("subtopic", ["housing"], 8),  # no common word
        "garage": ("subtopic", ["vehicles"], 0),
        "housing-vehicles-plan": ("subtopic", ["housing", "vehicles"], 7),
    }
    order = [r["id"] for r in browse_graph(nodes, members, tags).collect()]
    assert order[:2] == ["housing", "vehicles"] and "mobile-clinic" not in order


def test_small_and_empty_graphs(spark):
    nodes, members, tags, families = tables(spark)
    assert browse_graph(nodes.limit(0), members.limit(0), tags.limit(0), families).where("id <> 'mobile-clinic'").count() == 0
    one = browse_graph(nodes, members, tags.where("doc = 'd9'"))
    assert {r["id"] for r in one.collect()} == {r["id"] for r in nodes.collect()}
    words = spark.createDataFrame([], "id string, word string")
    assert compound_nodes(words, tags)[0].count() == 0
