"""Files behind a command-line client: listing and fetching by commands that the settings name."""

from __future__ import annotations

import shlex
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class CommandListing(DataSource):
    """Data source ``command-listing``: one row for each line that the ``command`` option's program prints."""

    @classmethod
    def name(cls) -> str:
        return "command-listing"

    def schema(self) -> str:
        return "rel_path string"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["command"])


class _ListingReader(DataSourceReader):
    def __init__(self, command: str):
        self.command = command

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        with subprocess.Popen(shlex.split(self.command), stdout=subprocess.PIPE, text=True) as run:
            for line in run.stdout:
                if line.strip():
                    yield (line.rstrip("\n"),)
        if run.returncode:
            raise RuntimeError(f"listing ended with {run.returncode}")


def remote_listing(spark: SparkSession, command: str) -> DataFrame:
    """(rel_path) of the files a client lists, side folders of saved pages left out."""
    spark.dataSource.register(CommandListing)
    rows = spark.read.format("command-listing").option("command", command).load()
    return rows.where(~F.exists(F.split("rel_path", "/"), lambda p: p.endswith("_files")))


def fetch(paths: DataFrame, commands: list[str], seconds: int = 300) -> DataFrame:
    """(rel_path, content, error) of each path: the output of the first of ``commands`` that succeeds, ``{path}`` in it standing for the path.

    Files are fetched by the tasks and never touch a disk here; one that can't be fetched is a row with an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["rel_path"]:
                content, error = None, "no command"
                for command in commands:
                    try:
                        done = subprocess.run([part.replace("{path}", path) for part in shlex.split(command)], capture_output=True, timeout=seconds, check=False)
                    except (OSError, subprocess.TimeoutExpired) as e:
                        error = f"{type(e).__name__}: {e}"[:200]
                        continue
                    if done.returncode == 0:
                        content, error = done.stdout, None
                        break
                    error = done.stderr.decode("utf-8", "replace")[:200] or f"ended with {done.returncode}"
                yield pd.DataFrame([(path, content, error)], columns=["rel_path", "content", "error"])

    return paths.select("rel_path").mapInPandas(run, "rel_path string, content binary, error string")


def trash_plan(done: DataFrame, command: str = "deletefile --drive-use-trash") -> DataFrame:
    """(rel_path, command): what would be moved to a remote trash; nothing is run here."""
    return done.select("rel_path", F.concat(F.lit(command + " "), F.col("rel_path")).alias("command"))
