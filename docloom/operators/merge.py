"""Keyed merges of a stored state with new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_write(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in ``order`` (all columns kept)."""
    w = Window.partitionBy(*key).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: str, changed: str, invalidate: list[str], carry: list[str]) -> DataFrame:
    """Full outer merge on ``key``: the new row wins, and stored results are dropped where ``changed`` differs.

    ``invalidate`` columns survive only if ``changed`` is the same in both; ``carry`` columns survive always. Rows of
    either side alone are kept, so the merge never deletes. ``merge_action`` is insert, update, same or keep.
    """
    o = old.select(F.col(key).alias("_ok"), *[F.col(c).alias(f"_o_{c}") for c in old.columns if c != key])
    n = new.select(F.col(key).alias("_nk"), *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key])
    both = o.join(n, F.col("_ok") == F.col("_nk"), "full_outer")
    is_new, is_old = F.col("_nk").isNotNull(), F.col("_ok").isNotNull()
    same = F.col(f"_o_{changed}").eqNullSafe(F.col(f"_n_{changed}"))
    action = F.when(~is_old, "insert").when(~is_new, "keep").when(same, "same").otherwise("update")
    out = [F.coalesce("_nk", "_ok").alias(key)]
    for c in dict.fromkeys([*[c for c in new.columns if c != key], *invalidate, *carry]):
        if c in new.columns:
            out.append(F.when(is_new, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}") if c in old.columns else None).alias(c))
        elif c in invalidate:
            out.append(F.when(~is_new | same, F.col(f"_o_{c}")).alias(c))
        else:
            out.append(F.col(f"_o_{c}").alias(c))
    return both.select(*out, action.alias("merge_action"))


def not_in(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``done`` (left anti)."""
    return df.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def compare_runs(left: DataFrame, right: DataFrame, key: str, facets: list[str]) -> DataFrame:
    """One row for each key of either run: side (both, left, right) and, for each facet, both values and agreement."""
    a = left.select(F.col(key).alias("_a"), *[F.col(f).alias(f"left_{f}") for f in facets])
    b = right.select(F.col(key).alias("_b"), *[F.col(f).alias(f"right_{f}") for f in facets])
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    same = [F.when(side == "both", F.col(f"left_{f}").eqNullSafe(F.col(f"right_{f}"))).alias(f"same_{f}") for f in facets]
    return both.select(F.coalesce("_a", "_b").alias(key), side.alias("side"), *[c for f in facets for c in (f"left_{f}", f"right_{f}")], *same)
