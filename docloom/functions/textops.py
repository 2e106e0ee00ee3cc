"""Scalar operations on texts and paths."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.priors import EMAIL, SSN


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags out, white space collapsed; entities stay as written."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    bare = F.regexp_replace(bare, r"(?is)<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))


def strip_rtf(rtf: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(rtf, r"\\[a-z]+-?\d* ?", ""), r"[{}]", "")


def readable_utf8(content: Column) -> Column:
    """Bytes as text; malformed sequences become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def strip_all(text: Column) -> Column:
    """Without white space at either end, line ends and no-break spaces included."""
    return F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def enough_text(text: Column, least: int = 30) -> Column:
    return F.coalesce(F.char_length(strip_all(text)) >= least, F.lit(False))


def bare_stem(path: Column) -> Column:
    """File name without extensions, copy numbers and a secured mark."""
    name = F.element_at(F.split(path, "/"), -1)
    name = F.regexp_replace(name, r"(?i)\(secured\)", "")
    name = F.regexp_replace(name, r"(?i)(\.(pdf|docx?|pptx?|xlsx?|txt|html?|rtf|md|csv|jpe?g|png))+$", "")
    return F.trim(F.regexp_replace(name, r"\(\d+\)", ""))


def redact_snippet(text: Column) -> Column:
    """A snippet fit for a report: numbers and addresses masked, white space collapsed."""
    out = F.regexp_replace(text, SSN.replace(r"\d{4}\b", r"(\d{4})\b"), "***-**-$1")
    out = F.regexp_replace(out, EMAIL.replace("(?i)\\b[A-Z0-9._%+\\-]+@", "(?i)\\b([A-Z0-9])[A-Z0-9._%+\\-]*@").replace("[A-Z0-9.\\-]+\\.[A-Z]{2,}", "([A-Z0-9.\\-]+\\.[A-Z]{2,})"), "$1***@$2")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def collapse_spaced_title(text: Column) -> Column:
    """'T I T L E' as one word."""
    return F.regexp_replace(text, r"(?<=\b[A-Za-z]) (?=[A-Za-z]\b)", "")


def years_in(text: Column, years: str = r"(?U)\b(19\d\d|20\d\d)\b") -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(years), F.lit(1))))


def path_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def keyword_snippets(text: Column, pattern: str, radius: int = 90, most: int = 3) -> Column:
    """The first ``most`` stretches of ``radius`` characters around matches of ``pattern``.

    Offsets are needed, so this runs in Arrow batches; texts without a match don't leave the JVM.
    """
    rx = re.compile(pattern)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            out = []
            for m in rx.finditer(t or ""):
                out.append(t[max(0, m.start() - radius) : m.end() + radius])
                if len(out) == most:
                    break
            return out

        return s.map(one)

    return F.coalesce(run(F.when(text.rlike(pattern), text)), F.array().cast("array<string>"))


#: Words of a file name that are no part of a person's name (a parameter).
NAME_NOISE = ("travel", "form", "forms", "signed", "grant", "docs", "conference", "hotel", "meeting", "receipt", "schedule", "final", "copy", "draft", "scan", "the", "and", "for", "resume", "letter")


_WORD = r"\p{Lu}[\p{L}.'’-]*\p{L}"
_TRIP = "(?i:travel|trip|mileage|lodging|hotel|conference|workshop)"
#: Forms in which people stand in file names, in the order they count. A parameter.
NAME_FORMS = (
    rf"^(\p{{Lu}}(?:\.\p{{Lu}})?\.?\s+{_WORD}(?:\s+{_WORD})?)[\s_-]+{_TRIP}",
    rf"^(\p{{Lu}}\.{_WORD})\s*[-–]",
    r"^(\p{L}[\p{L}.'’-]+(?:\s+\p{L}[\p{L}.'’-]+)?)_\p{L}",
    r"[-–]\s*(\p{Lu}{2,3})\s*$",
    rf"(?i:badge|statement|itinerary|form)[-_ ]({_WORD})",
    rf"^({_WORD})\s+{_TRIP}",
    rf"^({_WORD})-(?i:taxi|rail|flight|cab)\b",
)


def distinct_words(values: Column) -> Column:
    """Values without repeats, whatever their case: the first spelling stays, in its place."""
    low = F.transform(values, F.lower)
    return F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def names_in_filename(path: Column, noise: tuple[str, ...] = NAME_NOISE, forms: tuple[str, ...] = NAME_FORMS) -> Column:
    """Candidate person names of a file name: those in a known form, then two or three capitalised words in a row; form words are no names."""
    stem = bare_stem(path)
    known = F.array(*[F.regexp_extract(stem, p, 1) for p in forms])
    runs = F.regexp_extract_all(F.regexp_replace(stem, r"[_]+", " "), F.lit(r"((?:\p{Lu}\.|\p{Lu}[\p{L}'-]+)(?:\s+\p{Lu}[\p{L}'-]+){1,2})"), F.lit(1))
    clean = lambda r: F.array_join(F.filter(F.split(r, r"\s+"), lambda w: ~F.lower(w).isin(*noise)), " ")
    whole = F.filter(F.transform(runs, clean), lambda r: r.rlike(r"\S\s+\S"))
    return distinct_words(F.filter(F.concat(F.transform(known, clean), whole), lambda r: r != ""))
