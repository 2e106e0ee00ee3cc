"""State and vocabulary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_state(spark: SparkSession, path: str, items: str | None = None) -> DataFrame:
    """A JSON state file (one object); with ``items`` the rows of its list or map of that name."""
    state = spark.read.option("multiLine", "true").json(path)
    if items is None:
        return state
    kind = state.schema[items].dataType.typeName()
    if kind == "array":
        return state.select(F.explode(items).alias("item")).select("item.*")
    # a map read as a struct: one field for each key
    keys = state.schema[items].dataType.names
    return state.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.to_json(F.col(f"{items}.`{k}`")).alias("value")) for k in keys])).alias("e")).select("e.*")


def vocabulary(spark: SparkSession, facets: dict[str, dict[str, str]]) -> DataFrame:
    """(facet, term, description) of a closed vocabulary; each facet has the unmapped mark too."""
    rows = [(f, t, about) for f, terms in facets.items() for t, about in {**terms, "unmapped": "nothing fits"}.items()]
    return spark.createDataFrame(rows, "facet string, term string, description string")


def first_available(*sources: DataFrame | None) -> DataFrame | None:
    """The first source that has rows; sources are only probed until one has."""
    for s in sources:
        if s is not None and not s.isEmpty():
            return s
    return None


def work_list(*sources: DataFrame | None, path: str = "rel_path") -> DataFrame | None:
    """The first source that has rows, each path once, in the order of paths."""
    found = first_available(*sources)
    return None if found is None else found.dropDuplicates([path]).orderBy(path)


def flatten_trees(trees: DataFrame, column: str = "tree") -> DataFrame:
    """(root, id, parent_id, label, description, tags, depth, pos) from JSON trees of nodes with children.

    Spark has no recursive type, so a tree is read in the task that holds its row; nodes without an id are skipped
    with all below them, and a text that is no tree gives no rows. pos is the place in depth-first order.
    """
    import json
    from collections.abc import Iterator

    import pandas as pd

    def walk(nodes, parent, depth, out):
        for node in nodes if isinstance(nodes, list) else [nodes]:
            name = str(node.get("id") or "").strip() if isinstance(node, dict) else ""
            if name:
                tags = [str(t) for t in node.get("tags") or [] if str(t).strip()]
                out.append((name, parent, str(node.get("label") or name), str(node.get("description") or ""), tags, depth, len(out)))
                walk(node.get("children") or [], name, depth + 1, out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for root, text in zip(pdf["_root"], pdf["_text"]):
                out: list[tuple] = []
                try:
                    walk(json.loads(text), None, 1, out)
                except (TypeError, ValueError):
                    out = []
                rows += [(root, *r) for r in out]
            yield pd.DataFrame(rows, columns=["root", "id", "parent_id", "label", "description", "tags", "depth", "pos"])

    source = trees.select(F.xxhash64(column).alias("_root"), F.col(column).alias("_text"))
    return source.mapInPandas(run, "root long, id string, parent_id string, label string, description string, tags array<string>, depth int, pos int")
