"""Queries of the ten problems over the project's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.canonical import learn_aliases, map_to_canonical
from docloom.llm.cooccurrence import basket_pairs, term_baskets
from docloom.llm.mixing import mix_report, mix_sources
from docloom.llm.packing import fill_windows, window_fill
from docloom.llm.pii import find_values, learn_names, redact_samples, redact_texts
from docloom.llm.scan_noise import repair_scans
from docloom.llm.spans import shared_share, shared_span_pairs
from docloom.llm.splitting import split_oversized
from docloom.llm.subjects import assign_subjects, subject_makeup, train_subjects
from docloom.llm.term_frequency import explode_terms, field_totals, mark_terms, term_frequency
from docloom.operators.versions import current_rows
from docloom.session import spread, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "extract_record").select("extract_id", "text"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(_texts(spark, d))
    return pieces.where("piece_no = 2").select("extract_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_texts(spark, d))


def _terms(spark: SparkSession, d: str, fields: tuple[str, ...]) -> DataFrame:
    tags = current_rows(table(spark, d, "tags"), [f for f in fields if f != "main"])
    parts = [explode_terms(tags, "doc_id", F.col(f), f) for f in fields if f != "main"]
    if "main" in fields:
        layers = current_rows(table(spark, d, "layer_record"), ["main"])
        parts.append(explode_terms(layers, "doc_id", F.array("main"), "main"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def _marked(spark: SparkSession, d: str) -> DataFrame:
    tokens = _terms(spark, d, ("tags", "main"))
    return mark_terms(term_frequency(tokens), field_totals(tokens))


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).withColumn("marks", F.array_join("marks", ","))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("field", "term", F.explode("marks").alias("mark"))


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return redact_texts(texts, "extract_id", "text", learn_names(texts))


def p3_priors(spark: SparkSession, d: str) -> DataFrame:
    return redact_samples(table(spark, d, "ledger"), learn_names(_texts(spark, d))).select("doc_id", "queued_at", F.map_entries("priors").alias("priors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d)
    names = learn_names(rows)
    texts = find_values(rows, "extract_id", "text", names)
    kept = table(spark, d, "ledger").select("doc_id", F.explode(F.map_values("priors")).alias("v"))
    # a sample with a star in place of the value, or a placeholder or keyword alone, is searched like any other
    samples = kept.select("doc_id", F.explode("v.redacted_samples").alias("sample")).distinct()
    priors = find_values(samples, "doc_id", "sample", names).distinct()
    columns = ["field", "row_key", "kind", "found_value"]
    return texts.select(F.lit("text").alias("field"), *columns[1:]).unionAll(priors.select(F.lit("priors").alias("field"), *columns[1:]))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    tags = current_rows(table(spark, d, "tags"), ["tags", "entities"])
    return basket_pairs(term_baskets(tags, "doc_id", {f: F.col(f) for f in ("tags", "entities")}))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pairs(spark, d).where("ab * n >= 4 * a * b").select("field", "item_a", "item_b")


def _typed(spark: SparkSession, d: str) -> DataFrame:
    walks = table(spark, d, "walk_home").select("walk_id", "home", "main")
    home = F.transform("home", lambda v, i: F.struct(F.lit("home").alias("field"), i.alias("pos"), v.alias("value")))
    main = F.array(F.struct(F.lit("main").alias("field"), F.lit(0).alias("pos"), F.col("main").alias("value")))
    values = spread(walks).select("walk_id", F.explode(F.concat(F.coalesce(home, F.array().cast(home_type())), main)).alias("v")).select("walk_id", "v.*")
    return values.where(F.col("value").rlike(r"[^\s\u00a0]"))


def home_type() -> str:
    return "array<struct<field:string,pos:int,value:string>>"


def _mapped(spark: SparkSession, d: str, typed: DataFrame) -> DataFrame:
    plan = table(spark, d, "file_plan")
    return map_to_canonical(typed, "value", plan, learn_aliases(table(spark, d, "walk_home").select("home", "main"), plan))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, _typed(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    names = [r[0] for r in table(spark, d, "file_plan").select("plan_name").collect()]  # the fixed list
    typed = _typed(spark, d).where(~F.col("value").isin(names))
    return _mapped(spark, d, typed).select("walk_id", "field", "pos", "plan_id")


def p6_subjects(spark: SparkSession, d: str) -> DataFrame:
    texts = spread(table(spark, d, "extract_record").select("extract_id", "doc_id", "text"))
    model = train_subjects(texts, table(spark, d, "subject_labels"), table(spark, d, "layer_record"), table(spark, d, "subject_areas"))
    return assign_subjects(texts, model)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_subjects(spark, d).select("extract_id", "subject")


def p6_makeup(spark: SparkSession, d: str) -> DataFrame:
    return subject_makeup(p6_subjects(spark, d), table(spark, d, "extract_record"))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    return repair_scans(_texts(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_texts(spark, d).select("extract_id", F.explode("noise").alias("n")).select("extract_id", "n.line_no", "n.noise")


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    return fill_windows(_documents(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return window_fill(p8_windows(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(spread(table(spark, d, "documents").select("doc_id", "text", "source")), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_span_pairs(_documents(spark, d))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return shared_share(_documents(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit() and callable(f)}
