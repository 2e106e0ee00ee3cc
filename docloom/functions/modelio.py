"""Total functions from untrusted model output to closed domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.terms import UNMAPPED
from docloom.functions.textops import strip_all


def parse_model_json(text: Column) -> Column:
    """The JSON object in a model's answer as a VARIANT, or null.

    Tried in order: the fenced block, the whole answer, from the first to the last brace; each as it is and then
    without line comments and trailing commas. Anything but an object is null.
    """
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    mend = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?m)//[^\n]*$", ""), r",\s*([}\]])", "$1")
    tried = [F.try_parse_json(v) for c in (fenced, text, braced) for v in (c, mend(c))]
    return F.coalesce(*[F.when(F.schema_of_variant(v).startswith("OBJECT"), v) for v in tried])


def closed_terms(values: Column, allowed: Column, most: int = 2) -> Column:
    """At most ``most`` allowed terms in the order given, without repeats; the unmapped mark where none is."""
    kept = F.slice(F.array_intersect(values, allowed), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(UNMAPPED)))


def capped_terms(values: Column, most: int) -> Column:
    """Distinct without regard to case, first spelling and order kept, blank and null out, at most ``most``."""
    clean = F.filter(F.transform(values, strip_all), lambda v: v.isNotNull() & (v != ""))
    first = F.filter(clean, lambda v, i: F.array_position(F.transform(clean, F.lower), F.lower(v)) == i + 1)
    return F.slice(F.coalesce(first, F.array().cast("array<string>")), 1, most)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x, F.lit(low))))
