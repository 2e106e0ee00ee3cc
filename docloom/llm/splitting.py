"""Problem 1: splitting oversized texts at natural boundaries, by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Boundary kinds from strong to weak: pattern whose match end is the boundary, penalty of a cut there.
BOUNDARIES = (
    (re.compile(r"\n[ \t\r]*\n\s*"), 0.0),
    (re.compile(r"\n\s*"), 0.15),
    (re.compile(r"[.!?…;][\"')\]»”]*\s+"), 0.2),
    (re.compile(r"[。！？；]"), 0.2),
    (re.compile(r"[,:|]\s+"), 0.6),
    (re.compile(r"\s+"), 1.0),
)
HARD_CUT = 4.0


def boundaries(text: str, spacing: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which ``text`` may be cut and their penalties.

    Of several boundaries within ``spacing`` characters the strongest is kept; stretches without any get hard cuts
    every ``10 * spacing`` characters.
    """
    best: dict[int, tuple[float, int]] = {}
    for pattern, penalty in BOUNDARIES:
        for m in pattern.finditer(text):
            slot = m.end() // spacing
            if slot not in best or best[slot][0] > penalty:
                best[slot] = (penalty, m.end())
    n = len(text)
    pos = sorted({p: c for c, p in best.values() if 0 < p < n}.items())
    out, last = [], 0
    for p, c in [*pos, (n, 0.0)]:
        for hard in range(last + 10 * spacing, p - 10 * spacing + 1, 10 * spacing):
            out.append((hard, HARD_CUT))
        out.append((p, c))
        last = p
    return np.array([p for p, _ in out], dtype=np.int64), np.array([c for _, c in out])


def split_text(text: str, max_len: int = 10_000, overlap: int = 400, slack: int = 150, balance: float = 1.0) -> list[tuple[int, int]]:
    """(start, end) of pieces that cover ``text``.

    Every piece has at most ``max_len`` characters; each starts about ``overlap`` characters before the end of the
    one before, at the strongest boundary within ``slack`` of that distance. The ends minimise, over all sets of
    boundaries, the sum of the cut penalties and ``balance`` times the squared relative deviations from equal sizes.
    """
    n = len(text)
    if n <= max_len:
        return [(0, n)]
    pos, pen = boundaries(text)
    step = max_len - overlap
    pieces = -(-(n - overlap) // max(1, step - max_len // 50))
    target = (n + (pieces - 1) * overlap) / pieces
    # where the piece after a cut at pos[i] starts
    start = np.empty(len(pos), dtype=np.int64)
    start_pen = np.zeros(len(pos))
    low = np.searchsorted(pos, pos - overlap - slack, "left")
    high = np.searchsorted(pos, pos - overlap + slack, "right")
    for i in range(len(pos)):
        a, b = low[i], high[i]
        if a < b:
            cost = pen[a:b] + np.abs(pos[i] - overlap - pos[a:b]) / (4 * slack)
            k = a + int(cost.argmin())
            start[i], start_pen[i] = pos[k], pen[k]
        else:
            start[i], start_pen[i] = max(0, pos[i] - overlap), HARD_CUT
    # predecessors of cut j: cuts i < j with pos[j] - start[i] <= max_len; start never decreases by much, so a window of i suffices
    start = np.maximum.accumulate(np.maximum(start, 0))
    cost = np.full(len(pos), np.inf)
    prev = np.full(len(pos), -1, dtype=np.int64)
    first = np.searchsorted(start, pos - max_len, "left")
    for j in range(len(pos)):
        if pos[j] <= max_len:
            cost[j] = pen[j] + balance * ((pos[j] - target) / max_len) ** 2
        a = first[j]
        if a < j:
            c = cost[a:j] + start_pen[a:j] + balance * ((pos[j] - start[a:j] - target) / max_len) ** 2
            k = int(c.argmin())
            if c[k] + pen[j] < cost[j]:
                cost[j], prev[j] = c[k] + pen[j], a + k
    out, j = [], len(pos) - 1
    while j >= 0:
        i = prev[j]
        out.append((int(start[i]) if i >= 0 else 0, int(pos[j])))
        j = i
    return out[::-1]


def split_oversized(df: DataFrame, key: str = "extract_id", text: str = "text", threshold: int = 12_000, max_len: int = 10_000, overlap: int = 400) -> DataFrame:
    """(key, piece_no, start, end, piece) of every text of more than ``threshold`` characters.

    Lengths and offsets are in Unicode code points; piece_no starts at 1. Shorter, null and empty texts give no rows
    (they stand as they are). A text without any boundary is cut every so many characters, never above ``max_len``.
    Null, repeated rows and repeated keys are split each for itself; other columns are not touched. The split of a text
    needs no other row, so there is no shuffle, and short texts never leave the JVM.
    """
    if not 0 <= overlap < max_len // 4:
        raise ValueError("overlap must be at least 0 and less than a quarter of max_len")
    schema = T.StructType(
        [T.StructField(key, T.StringType()), T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("piece", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["_key"], pdf["_text"]):
                for i, (a, b) in enumerate(split_text(t, max_len, overlap), 1):
                    rows.append((k, i, a, b, t[a:b]))
                if len(rows) >= 512:
                    yield pd.DataFrame(rows, columns=schema.names)
                    rows = []
            yield pd.DataFrame(rows, columns=schema.names)

    long = df.where(F.char_length(F.col(text)) > threshold).select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    # keys travel as text: pandas would make floats of numbers beside a null
    return long.mapInPandas(run, schema).withColumn(key, F.col(key).cast(df.schema[key].dataType))
