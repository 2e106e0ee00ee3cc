"""The walk as a stream: rows placed into a growing tree, one state for each main folder."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.fold import Chooser, reuse_or_invent


def walk_stream(rows: DataFrame, key: str, main: str, order: str, children: list[str], choose: Chooser = reuse_or_invent, depth: int = 3) -> DataFrame:
    """(key, home): each arriving row placed given the folders that earlier rows of its main opened.

    The state of a main is its folders with their counts, never its rows; rows of a batch are taken in order.
    Decisions are appended and never changed.
    """
    kind = rows.schema[key].dataType.simpleString()
    columns = [F.coalesce(F.col(main), F.lit("")).alias("_main"), F.col(key).alias("_key"), F.col(order).alias("_order"), *[F.coalesce(F.col(c), F.lit("")).alias(f"_c{i}") for i, c in enumerate(children)]]

    def place(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tree = {tuple(p): n for p, n in json.loads(state.get[0])} if state.exists else {}
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["_order", "_key"], ignore_index=True)
        out = []
        for r in pdf.itertuples(index=False):
            home = [group[0]] if group[0] else ["unmapped"]
            for wanted in r[3:] if group[0] else ():
                if len(home) >= depth:
                    break
                siblings = tree.setdefault(tuple(home), {})
                action, name = choose(wanted, siblings)
                if action == "empty" or not name:
                    break
                siblings[name] = siblings.get(name, 0) + 1
                home = [*home, name]
            out.append((r[1], home))
        state.update((json.dumps([[list(p), n] for p, n in tree.items()]),))
        yield pd.DataFrame(out, columns=["_key", "home"])

    placed = rows.select(*columns).groupBy("_main").applyInPandasWithState(place, f"_key {kind}, home array<string>", "tree string", "append", "NoTimeout")
    return placed.withColumnRenamed("_key", key)
