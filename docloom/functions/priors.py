"""Pattern scan of texts and file names: identifier counts with redacted samples."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, sample forms and severities that define the scan's results.
SSN = r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b"
SSN_WORD = r"(?i)\b(ssn|ss#|social\s*security|itin|taxpayer\s*id|tin)\b"
EMAIL = r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
PHONE = r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"
DOB = r"(?i)\b(?:dob|date of birth|born)\b[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
CARD = r"\b(?:\d[ -]*?){13,19}\b"
STREET = r"(?i)\b\d{1,6}\s+[A-Za-z0-9][A-Za-z0-9.'\- ]{1,40}\s+(?:St|Street|Ave|Avenue|Rd|Road|Ln|Lane|Blvd|Dr|Drive|Ct|Court|Way|Pkwy|Hwy|Highway)\.?\b"
PO_BOX = r"(?i)\bP\.?\s*O\.?\s*Box\s+\d+\b"
STATE_ZIP = r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"
SENSITIVE = r"(?i)\b(social security|date of birth|driver'?s license|passport number|routing number|account number|student id|medical record|password|api key|private key|confidential)\b"
FILENAME_HINTS = {
    "identity_document": r"(?i)\b(ssn|social|passport|driver.?licen|dlscan|itin)\b",
    "tax_financial": r"(?i)\b(w-?2|w-?4|1099|1040|tax|turbotax|bank.?stmt|routing|direct.?deposit|mortgage|deed)\b",
    "student_record": r"(?i)\b(ferpa|transcript|iep|504|student.?id|gradebook|immunization)\b",
    "medical": r"(?i)\b(hipaa|immunization|health.?record|rx|prescription|\btb\b)\b",
    "credentials_secrets": r"(?i)\b(password|passwd|secret|api.?key|private.?key|\.pem|id_rsa)\b",
    "personal_correspondence": r"(?i)\b(resume|cv_|personal|family|kids?|divorce|will)\b",
    "work_travel": r"(?i)\b(travel)\b",
}
SAMPLES = 5
KINDS = ("ssn", "email", "phone", "dob", "address", "credit_card", "sensitive_keyword")
HIGH = ("ssn", "credit_card")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern whose word borders, digits and spaces are those of Unicode, whatever the Java version."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def scan(text: Column) -> dict[str, Column]:
    """Kind -> array of redacted samples, one for each match in text order (null text: empty arrays)."""
    return _scan(F.coalesce(text, F.lit("")))


def scan_map(text: Column) -> Column:
    """The scan as a map kind -> (count, samples)."""
    return as_map(scan(text))


def _scan(text: Column) -> dict[str, Column]:
    cards = F.filter(F.transform(matches(text, CARD), _digits), lambda d: (F.length(d) >= 13) & (F.length(d) <= 19) & F.call_function("luhn_check", d))
    constant = lambda pattern, sample: F.transform(matches(text, pattern), lambda _: F.lit(sample))
    words = F.array_join(F.slice(F.array_sort(F.array_distinct(F.transform(matches(text, SENSITIVE, 1), F.lower))), 1, 8), ", ")
    return {
        "ssn": F.transform(matches(text, SSN), lambda m: F.concat(F.lit("***-**-"), F.right(m, F.lit(4)))),
        "email": F.transform(matches(text, EMAIL), lambda m: F.concat(F.left(m, F.lit(1)), F.lit("***@"), F.split_part(m, F.lit("@"), F.lit(2)))),
        "phone": F.transform(matches(text, PHONE), lambda m: F.concat(F.lit("***-***-"), F.right(_digits(m), F.lit(4)))),
        "dob": constant(DOB, "**/**/****"),
        "address": F.concat(constant(STREET, "[street]"), constant(PO_BOX, "[po-box]"), constant(STATE_ZIP, "[st-zip]")),
        "credit_card": F.transform(cards, lambda d: F.concat(F.lit("****-****-****-"), F.right(d, F.lit(4)))),
        "sensitive_keyword": F.when(words == "", F.array().cast("array<string>")).otherwise(F.array(words)),
    }


def as_map(found: dict[str, Column]) -> Column:
    """Map kind -> (count, first five distinct samples) of the kinds that occur, in scan order."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), found[k].alias("samples")) for k in KINDS])
    # each array is computed once and then taken apart
    entry = lambda e: F.struct(e["kind"].alias("key"), F.struct(F.size(e["samples"]).alias("count"), F.slice(F.array_distinct(e["samples"]), 1, SAMPLES).alias("redacted_samples")).alias("value"))
    return F.map_from_entries(F.filter(F.transform(pairs, entry), lambda e: e["value"]["count"] > 0))


def severity(kinds: Column) -> Column:
    """high for identity and financial numbers, medium for contact data and sensitive words, else low."""
    any_of = lambda names: F.arrays_overlap(kinds, F.array(*map(F.lit, names)))
    return F.when(any_of(HIGH), "high").when(any_of([k for k in KINDS if k not in HIGH]), "medium").otherwise("low")


def has_identifier(kinds: Column) -> Column:
    return F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in KINDS if k != "sensitive_keyword"]))


def filename_tags(rel_path: Column, hints: dict[str, str] = FILENAME_HINTS) -> Column:
    """Hints that a file's name or whole path gives, in the order of ``hints`` (a parameter: add the names of one's own institution)."""
    name = F.element_at(F.split(rel_path, "/"), -1)
    return F.array_compact(F.array(*[F.when(name.rlike(p) | rel_path.rlike(p), F.lit(k)) for k, p in hints.items()]))


def windowed_nine_digits(text: Column) -> Column:
    """Samples of nine-digit numbers with a social-security word within 40 characters on either side.

    The window is cut before the word is looked for, so a cut can make a word border, as the scan is defined. Only
    texts with such a word and such a number reach the Python worker.
    """
    word, nine = re.compile(SSN_WORD), re.compile(r"\b(\d{9})\b")

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return []
            return [f"*****-{m[1][-4:]}" for m in nine.finditer(t) if word.search(t[max(0, m.start() - 40) : m.end() + 40])]

        return s.map(one)

    near = F.when(text.rlike(SSN_WORD) & text.rlike(r"\d{9}"), text)
    return F.coalesce(run(near), F.array().cast("array<string>"))
