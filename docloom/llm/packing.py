"""Problem 8: filling fixed-capacity windows with texts, by cost-balanced packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.tokens import VOCABULARY, token_sizes
from docloom.session import cut


def pack(sizes: np.ndarray, capacity: int, quadratic: float) -> np.ndarray:
    """Window number of each item (sizes descending are placed first).

    The cost of an item is its tokens plus ``quadratic`` times their square over the capacity. There are at first as
    many windows as the tokens need at the least. Each item in descending order goes to the window of lowest cost
    that has room for it; where none has, to a new one.
    """
    order = np.argsort(-sizes, kind="stable")
    bins = max(1, -(-int(sizes.sum()) // capacity))
    room = np.full(bins + 64, -1, dtype=np.int64)
    room[:bins] = capacity
    cost = np.zeros(len(room))
    out = np.empty(len(sizes), dtype=np.int64)
    for i in order:
        n = sizes[i]
        fits = room[:bins] >= n
        k = int(np.where(fits, cost[:bins], np.inf).argmin())
        if not fits[k]:
            k = bins
            bins += 1
            if bins >= len(room):
                room = np.concatenate([room, np.full(len(room), -1, dtype=np.int64)])
                cost = np.concatenate([cost, np.zeros(len(cost))])
            room[k] = capacity
        out[i] = k
        room[k] -= n
        cost[k] += n + quadratic * n * n / capacity
    return out


def fill_windows(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 2_048,
    shard_tokens: int = 1 << 21,
    quadratic: float = 1.0,
    path: str = VOCABULARY,
) -> DataFrame:
    """(shard, window, slot, doc_id, piece, token_from, n_tokens): which tokens of which text stand in which window.

    A text of up to ``capacity`` tokens stands whole in one window. A larger one is cut into full windows and a
    rest, which is packed like any other item; full pieces are windows by themselves and take no part in the
    packing. token_from is 0-based in the text's tokens. Within a window slots count from 0 in descending size.

    Items are spread over shards of about ``shard_tokens`` tokens by a hash of key and piece, each packed by one
    task, so no task holds more however large the collection is; a shard leaves less than one window's room beyond
    the best. Texts of no tokens (null, empty) are in no window. A key on several rows is packed once for each row.
    """
    sizes = cut(token_sizes(docs, key, text, path).where("n_tokens > 0").withColumnRenamed(key, "doc_id"))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, round(total / shard_tokens))
    last = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    pieces = sizes.select("doc_id", F.col("n_tokens").alias("_all"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece") * capacity
    pieces = pieces.select("doc_id", "piece", start.alias("token_from"), F.least(F.lit(capacity), F.col("_all") - start).alias("n_tokens"))
    # keys travel as text: pandas would make floats of numbers beside a null
    pieces = pieces.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    kind = sizes.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        n = pdf["n_tokens"].to_numpy()
        full = int((n == capacity).sum())
        window = np.arange(len(n), dtype=np.int64)
        if full < len(n):
            window[full:] = full + pack(n[full:], capacity, quadratic)
        pdf["window"] = window
        pdf["slot"] = pdf.groupby("window").cumcount().astype("int32")
        return pdf[["shard", "window", "slot", "doc_id", "piece", "token_from", "n_tokens"]]

    schema = "shard int, window long, slot int, doc_id string, piece int, token_from int, n_tokens int"
    return pieces.groupBy("shard").applyInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def window_fill(windows: DataFrame, capacity: int = 2_048, quadratic: float = 1.0) -> DataFrame:
    """One row for each shard: windows, tokens, share of unused room, least and most cost of a window."""
    n = F.col("n_tokens")
    each = windows.groupBy("shard", "window").agg(F.sum("n_tokens").alias("tokens"), F.sum(n + quadratic * n * n / capacity).alias("cost"), F.count(F.lit(1)).alias("items"))
    return each.groupBy("shard").agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("items").alias("items"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
        (1 - F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
        F.min("cost").alias("least_cost"),
        F.max("cost").alias("most_cost"),
    )
