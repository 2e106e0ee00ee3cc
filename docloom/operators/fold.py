"""Ordered folds: placing rows one after another into a growing tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (kebab child wanted, siblings so far with counts) -> (action, name)
Chooser = Callable[[str, dict[str, int]], tuple[str, str]]


def reuse_or_invent(wanted: str, siblings: dict[str, int]) -> tuple[str, str]:
    """The rule-based default: an existing sibling of that name, else one whose words contain it, else a new folder."""
    if not wanted:
        return "empty", ""
    if wanted in siblings:
        return "reuse", wanted
    words = set(wanted.split("-"))
    near = [s for s in siblings if words and (words < set(s.split("-")) or set(s.split("-")) < words)]
    if near:
        return "reuse", max(near, key=lambda s: (siblings[s], s))
    return "invent", wanted


def walk_fold(rows: DataFrame, key: str, main: str, order: list[str], children: list[str], choose: Chooser = reuse_or_invent, depth: int = 3) -> DataFrame:
    """(key, home, actions): each row placed in turn under its main, given the folders that earlier rows opened.

    The order of a main's rows is the fold's meaning, so a main is one sequence; the rows of a partition are streamed
    through in order and only the folders of the current main are held, never its rows.
    """
    columns = [F.col(key).alias("_key"), F.coalesce(F.col(main), F.lit("")).alias("_main"), *[F.coalesce(F.col(c), F.lit("")).alias(f"_c{i}") for i, c in enumerate(children)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]]
    sequence = rows.select(*columns).repartition("_main").sortWithinPartitions("_main", *[f"_o{i}" for i in range(len(order))], "_key")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tree = None, {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r[1] != current:
                    current, tree = r[1], {}
                home, actions = [current] if current else ["unmapped"], []
                for wanted in r[2 : 2 + len(children)] if current else ():
                    if len(home) >= depth:
                        break
                    siblings = tree.setdefault(tuple(home), {})
                    action, name = choose(wanted, siblings)
                    actions.append(action)
                    if action == "empty" or not name:
                        break
                    siblings[name] = siblings.get(name, 0) + 1
                    home = [*home, name]
                out.append((r[0], home, actions))
            yield pd.DataFrame(out, columns=["_key", "home", "actions"])

    return sequence.mapInPandas(run, f"_key {kind}, home array<string>, actions array<string>").withColumnRenamed("_key", key)


def merge_groups(groups: list[tuple[list[str], str]], listed: list[str], leave_one: bool = True) -> list[tuple[list[str], str]]:
    """Groups of names to combine, made safe in order: only listed names that no earlier group claims, at least two,
    and, with ``leave_one``, only if some listed name stays unclaimed."""
    claimed: set[str] = set()
    out = []
    for names, into in groups:
        keep = [n for n in dict.fromkeys([*names, *([into] if into in listed else [])]) if n in listed and n not in claimed]
        if len(keep) < 2 or not into:
            continue
        if leave_one and not set(listed) - claimed - set(keep):
            continue
        claimed |= set(keep)
        out.append((keep, into))
    return out


def rehome_log(before: DataFrame, after: DataFrame, key: str, home: str = "home") -> DataFrame:
    """(key, home_from, home_to): what a combination moved."""
    old = before.select(key, F.array_join(home, "/").alias("home_from"))
    new = after.where("moved").select(key, F.array_join(home, "/").alias("home_to"))
    return old.join(new, key)


def rehome(homes: DataFrame, key: str, prefix: list[str], merged: list[str], into: str, home: str = "home", depth: int = 3) -> DataFrame:
    """Homes after siblings ``merged`` under ``prefix`` are combined ``into`` one folder.

    The old name nests below the new one where there is a level left and it differs; a fourth level becomes ``facet``.
    """
    at = len(prefix) + 1
    h = F.col(home)
    hit = (F.slice(h, 1, len(prefix)) == F.array(*map(F.lit, prefix))) if prefix else F.lit(True)
    name = F.try_element_at(h, F.lit(at))
    hit = hit & name.isin(*merged)
    nested = F.concat(F.slice(h, 1, at - 1) if at > 1 else F.array().cast("array<string>"), F.when(name == into, F.array(F.lit(into))).otherwise(F.array(F.lit(into), name)), F.slice(h, at + 1, F.size(h)))
    moved = F.when(hit, nested).otherwise(h)
    return homes.select(key, F.slice(moved, 1, depth).alias(home), F.try_element_at(moved, F.lit(depth + 1)).alias("facet"), hit.alias("moved"))
