"""Problem 2: frequency of every distinct term, by last-seen counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.terms import form_k


def explode_terms(records: DataFrame, record: str, terms: Column, field: str) -> DataFrame:
    """(field, record, term) with one row for each occurrence; terms without a form K are left out."""
    return (
        records.select(F.lit(field).alias("field"), F.col(record).alias("record"), F.explode(terms).alias("_raw"))
        .select("field", "record", form_k(F.col("_raw")).alias("term"))
        .where(F.col("term") != "")
    )


def term_frequency(tokens: DataFrame, salts: int | None = None) -> DataFrame:
    """Occurrences and records of each (field, term).

    ``tokens`` has field, record and term. Tokens are hash-partitioned by term and a salt of the record, sorted by
    record, and each term keeps its occurrences, its records and the last record seen: a token of another record
    than the last one raises the record count. No set of records is ever held. The salt spreads a term that occurs
    in a third of all rows over as many tasks as a shuffle has (``salts``); as it is a function of the record, no record is counted under two salts.

    Null or empty terms and null records count nowhere. A term twice in one record has two occurrences and one
    record. An empty table gives no rows; other columns are ignored.
    """
    salts = salts or max(1, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = tokens.where(F.col("record").isNotNull() & F.col("term").isNotNull() & (F.col("term") != "")).select(
        "field", "term", "record", F.pmod(F.xxhash64("record"), F.lit(salts)).alias("_salt")
    )
    last = F.lag("record").over(Window.partitionBy("field", "term", "_salt").orderBy("record"))
    seen = salted.withColumn("_new", F.when(last.eqNullSafe(F.col("record")), 0).otherwise(1))
    return seen.groupBy("field", "term").agg(F.count(F.lit(1)).alias("occurrences"), F.sum("_new").alias("records"))


def mark_terms(frequency: DataFrame, totals: DataFrame, rare_max: int = 2, common_share: float = 0.1) -> DataFrame:
    """Add ``share`` of the field's records and ``marks``: 'rare' up to ``rare_max`` records, 'common' above ``common_share``.

    ``totals`` has one row for each field (field, n), so it is broadcast.
    """
    joined = frequency.join(F.broadcast(totals), "field")
    share = F.col("records") / F.col("n")
    marks = F.array_compact(
        F.array(F.when(F.col("records") <= rare_max, F.lit("rare")), F.when(F.col("records") > F.col("n") * common_share, F.lit("common")))
    )
    return joined.select("field", "term", "occurrences", "records", share.alias("share"), marks.alias("marks"))


def field_totals(tokens: DataFrame) -> DataFrame:
    """(field, n): records with at least one term in the field."""
    return tokens.select("field", "record").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n"))
