"""A model step: prompts in, JSON answers out, run once for each row."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut


class ModelFn(Protocol):
    """Answers for a batch of prompts, each a JSON string."""

    def __call__(self, prompts: pd.Series) -> pd.Series: ...


def keyword_model(rules: dict[str, str], default: str = "unknown") -> ModelFn:
    """The offline default: the first tag whose pattern matches, all that match, and a confidence by their number."""
    compiled = [(tag, re.compile(p, re.I)) for tag, p in rules.items()]

    def answer(prompts: pd.Series) -> pd.Series:
        def one(p):
            hit = [t for t, rx in compiled if rx.search(p or "")]
            return json.dumps({"tags": hit or [default], "primary_tag": hit[0] if hit else default, "confidence": "high" if len(hit) > 1 else "medium" if hit else "low"})

        return prompts.map(one)

    return answer


def run_model(df: DataFrame, key: str, prompt: str, model: ModelFn, into: str = "answer") -> DataFrame:
    """(key, answer). The answers are written once and read back: a retried task or a second use calls no model again.

    A failing batch gives error objects, so that one bad prompt doesn't end the run.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                answers = model(pdf["_prompt"])
            except Exception as e:  # noqa: BLE001 - an error is an answer of its own
                answers = pd.Series([json.dumps({"error": str(e)[:200]})] * len(pdf))
            yield pd.DataFrame({"_key": pdf["_key"], into: answers.to_numpy()})

    return cut(df.select(F.col(key).alias("_key"), F.col(prompt).alias("_prompt")).mapInPandas(run, f"_key {kind}, {into} string")).withColumnRenamed("_key", key)


def merge_chunk_answers(answers: DataFrame, key: str, order: str, answer: str = "answer", allowed: list[str] | None = None) -> DataFrame:
    """One result for each document from those of its chunks: tags in first-seen order, the lowest confidence, the first primary tag."""
    parsed = F.from_json(answer, "tags array<string>, primary_tag string, confidence string")
    rows = answers.select(key, F.col(order).alias("_o"), parsed.alias("a"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_o", "a"))).alias("parts"))
    tags = F.array_distinct(F.flatten(F.transform("parts", lambda p: F.coalesce(p["a"]["tags"], F.array().cast("array<string>")))))
    if allowed is not None:
        tags = F.array_intersect(tags, F.array(*map(F.lit, allowed)))
    rank = F.create_map(F.lit("low"), F.lit(0), F.lit("medium"), F.lit(1), F.lit("high"), F.lit(2))
    lowest = F.array_min(F.transform("parts", lambda p: F.coalesce(F.try_element_at(rank, p["a"]["confidence"]), F.lit(0))))
    return grouped.select(
        key,
        F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("unknown"))).alias("tags"),
        F.element_at("parts", 1)["a"]["primary_tag"].alias("primary_tag"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), lowest + 1).alias("confidence"),
        F.size("parts").alias("chunk_count"),
    )
