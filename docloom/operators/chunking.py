"""Overlapping chunks of texts and fixed-size chunks of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap_chunks(df: DataFrame, key: str, text: str, threshold: int = 12_000, size: int = 10_000, overlap: int = 400) -> DataFrame:
    """(key, chunk_no, start, chunk): windows of ``size`` characters that start every ``size - overlap``.

    A text of at most ``threshold`` characters is one chunk; null and empty texts are one empty chunk. Every start
    below the length gives a chunk, so the last may lie within the one before.
    """
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.char_length(body)
    starts = F.when(n <= threshold, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(size - overlap)))
    rows = df.select(F.col(key), body.alias("_body"), F.when(n <= threshold, n).otherwise(F.lit(size)).alias("_size"), F.posexplode(starts).alias("chunk_no", "start"))
    return rows.select(key, "chunk_no", "start", F.substring("_body", F.col("start") + 1, F.col("_size")).alias("chunk"))


def group_chunks(df: DataFrame, group: str, order: list[str], size: int = 12) -> DataFrame:
    """Add ``chunk_id`` 'group#NN' and ``place``: members of a group in order, ``size`` to a chunk."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    numbered = df.withColumn("_at", at)
    chunk = F.floor(F.col("_at") / size) + 1
    return numbered.withColumn("chunk_id", F.concat(F.col(group), F.lit("#"), F.lpad(chunk.cast("string"), F.greatest(F.lit(2), F.length(chunk.cast("string"))), "0"))).withColumn(
        "place", F.pmod("_at", F.lit(size)).cast("int")
    ).drop("_at")
