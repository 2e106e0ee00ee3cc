"""Decision files and reports, written by tasks or as one small text."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_decisions(df: DataFrame, path: str) -> None:
    """One JSON line for each row, by the committing writer; a failed task leaves no part of a file."""
    df.write.mode("overwrite").json(path)


def write_decision_index(df: DataFrame, path: str) -> None:
    """The index of all decisions: records as JSON lines, and a manifest with their number and the time."""
    df.write.mode("overwrite").json(f"{path}/records")
    counted = df.agg(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("built_at"), F.count(F.lit(1)).alias("documents"))
    counted.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_sidecars(df: DataFrame, path: str, record: str, folder: str) -> DataFrame:
    """(path, written): each row's ``record`` in its own file below ``folder``, which all executors share.

    The tasks write the files, each whole or not at all; rows whose path leads out of the folder are not written.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["record"]):
                if name:
                    write_text(f"{folder}/{name}", text or "")
            yield pd.DataFrame({"path": pdf["path"], "written": pdf["file"].notna()})

    rows = df.select(F.col(path).alias("path"), safe_sidecar(F.col(path)).alias("file"), F.col(record).alias("record"))
    return rows.mapInPandas(run, "path string, written boolean")


def write_regions(nodes: DataFrame, folder: str) -> None:
    """A folder tree as JSON rows and as a YAML list in depth-first order (nodes: id, parent_id, label, depth, path_key)."""
    nodes.drop("path_key").write.mode("overwrite").json(f"{folder}/regions")
    rows = nodes.orderBy("path_key").select("id", "label", "depth").toLocalIterator()
    write_text(f"{folder}/regions.yml", (f"{'  ' * (r['depth'] - 1)}- {{id: {json.dumps(r['id'])}, label: {json.dumps(r['label'])}}}\n" for r in rows))


def safe_sidecar(rel_path: Column) -> Column:
    """Relative path of a row's own file; null for absolute paths and ways out of the folder."""
    bad = rel_path.startswith("/") | F.exists(F.split(rel_path, "/"), lambda p: p.isin("..", "")) | rel_path.rlike(r"^[A-Za-z]:")
    return F.when(~bad, F.concat(rel_path, F.lit(".json")))


def markdown_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; rows beyond ``most`` are counted, so nothing is silently left out."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"\n{df.count() - most} further rows are in the table this report was made from.")
    return "\n".join(lines) + "\n"


def write_text(path: str, text: str | Iterable[str]) -> None:
    """Write a driver-side file whole or not at all; a text in parts is written as they come."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.writelines([text] if isinstance(text, str) else text)
    os.replace(temp, path)


def markdown_lines(df: DataFrame, title: str) -> Iterator[str]:
    """All rows of a result as the lines of a Markdown table, one partition at a time on the driver."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    yield f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}\n"
    for r in df.toLocalIterator():
        yield f"| {' | '.join(map(cell, r))} |\n"


def write_markdown(df: DataFrame, title: str, path: str) -> None:
    """A result as a Markdown file with all of its rows."""
    write_text(path, markdown_lines(df, title))


def move_plan(df: DataFrame, path: str, target: str) -> DataFrame:
    """(source, destination): where files would be moved to; nothing is moved. Names that meet get a number."""
    from pyspark.sql.window import Window

    name = F.element_at(F.split(path, "/"), -1)
    n = F.row_number().over(Window.partitionBy("_name").orderBy(path))
    rows = df.select(F.col(path), name.alias("_name")).where(safe_sidecar(F.col(path)).isNotNull()).withColumn("_n", n)
    return rows.select(F.col(path).alias("source"), F.concat(F.lit(target.rstrip("/") + "/"), "_name", F.when(F.col("_n") > 1, F.concat(F.lit(".dup"), F.col("_n").cast("string"))).otherwise("")).alias("destination"))


def tree_text(ordered: DataFrame) -> str:
    """A folder tree (label, depth, path_key) as an indented list in depth-first order."""
    rows = ordered.orderBy("path_key").select("label", "depth").toLocalIterator()
    return "".join(f"{'  ' * (r['depth'] - 1)}- {r['label']}\n" for r in rows)


def chart_html(rings: DataFrame, title: str) -> str:
    """A page with all rings of a chart (ring, id, parent, label, value) as nested bars; all text is escaped."""
    import html

    rows = list(rings.orderBy("ring", F.desc("value"), "id").toLocalIterator())
    below: dict[str, list] = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r)

    def draw(parent: str, whole: int) -> str:
        return "".join(
            f'<li><span style="display:inline-block;height:.7em;background:#47a;width:{200 * r["value"] / max(whole, 1):.0f}px"></span> {html.escape(r["label"])} ({r["value"]})'
            + (f"<ul>{draw(r['id'], whole)}</ul>" if r["id"] in below else "") + "</li>"
            for r in below.get(parent, [])
        )

    total = next((r["value"] for r in rows if r["ring"] == 0), 0)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul>{draw('', total)}</ul>\n"


def write_reports(frames: dict[str, DataFrame], folder: str) -> None:
    """One Markdown file for each named result, each written whole."""
    for name, df in frames.items():
        write_markdown(df, name.replace("-", " ").title(), f"{folder}/{name}.md")
