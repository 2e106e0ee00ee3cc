"""Normal forms of tags, entities and folder names."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def form_k(term: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one hyphen, no outer hyphens; '' where nothing remains."""
    return F.regexp_replace(F.regexp_replace(F.lower(term), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# Words that don't tell concepts apart, words that mean the same, heads that no folder may have.
#: Words of one's own institution that tell nothing apart either: a setting.
OWN_WORDS = tuple(os.environ.get("DOCLOOM_OWN_WORDS", "").lower().split())
GENERIC_TOKENS = ("and", "doc", "document", "form", "or", "pdf", "school", "the", "year", *OWN_WORDS)
SAME_TOKENS = {
    "administration": "admin",
    "administrations": "admin",
    "admins": "admin",
    "certifications": "certification",
    "records": "record",
    "trainings": "training",
    "quotes": "quote",
    "vendors": "vendor",
    "forms": "form",
}
CHANNELS = r"(?i)\b(usenet|e-?mail|newsgroup|nntp|internet[- ]culture)\b"
YEAR_ONLY = r"^(19\d\d|20\d\d|1980s|1990s|2000s)$"
VAGUE = r"(?i)^(discussion|misc|miscellaneous|other|general|files?|documents?|topics?|items?|archive|stuff|content|records?)$"
UNMAPPED = "unmapped"


def kebab(raw: Column) -> Column:
    """Folder id: form K of the text, cut at 48 characters; '' for null."""
    return F.left(form_k(F.coalesce(raw, F.lit(""))), F.lit(48))


def kebab_label(tag: Column) -> Column:
    """Preferred form of a tag: like form K, without a cut."""
    return form_k(F.coalesce(tag, F.lit("")))


def human_label(slug: Column) -> Column:
    return F.when((slug == "") | (slug == UNMAPPED) | slug.isNull(), F.lit("Unmapped")).otherwise(F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))))


def node_id(segments: Column) -> Column:
    """Path-unique id of a folder: kebab segments joined by two hyphens."""
    kept = F.filter(F.transform(segments, kebab), lambda s: s != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "--")).otherwise(F.lit(UNMAPPED))


def content_tokens(tag: Column) -> Column:
    """Sorted distinct content words of a tag after equivalence; the whole kebab form where none remains."""
    same = F.create_map(*[F.lit(x) for pair in SAME_TOKENS.items() for x in pair])
    label = kebab_label(tag)
    words = F.filter(F.split(label, "-"), lambda w: (F.length(w) > 2) & ~w.isin(*GENERIC_TOKENS) & ~w.rlike(r"^\d+$"))
    mapped = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(same, w), w))))
    return F.when(F.size(mapped) > 0, mapped).otherwise(F.array(F.when(label != "", label).otherwise(tag)))


def match_tokens(tag: Column) -> Column:
    """Distinct words of a tag that are worth matching on; may be empty."""
    words = F.split(F.lower(F.coalesce(tag, F.lit(""))), r"[-_/\s]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*GENERIC_TOKENS) & ~w.rlike(r"^\d+$"))))


def is_banned_head(slug: Column, label: Column | None = None) -> Column:
    """A channel or nothing but years: no subject to file under."""
    blob = F.trim(F.translate(F.concat_ws(" ", slug, slug if label is None else label), "_-", "  "))
    words = F.filter(F.split(F.lower(blob), r"\s+"), lambda w: w != "")
    return blob.rlike(CHANNELS) | F.forall(words, lambda w: w.rlike(YEAR_ONLY))


def is_vague(slug: Column) -> Column:
    return slug.rlike(VAGUE)
