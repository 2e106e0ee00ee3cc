"""Ranked keyword search by a table of weighted patterns, and the people it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.textops import collapse_spaced_title, distinct_words, years_in

#: (where: name or text, pattern, weight). A parameter: another search is another table.
SEARCH_RULES = (
    ("name", r"(?i)\b(?:travel|itinerary|mileage|lodging|trip)\b", 8),
    ("name", r"(?i)\b(?:workshop|conference|training|course)\b", 4),
    ("name", r"(?i)\b(?:summer|june|july|august)\b", 2),
    ("text", r"(?i)\b(?:hotel|hostel|itinerary|airfare|luggage|railcard)\b", 5),
    ("text", r"(?i)\b(?:workshop|conference|training)\b", 4),
    ("text", r"(?i)\b(?:Jun|Jul|Aug)\b", 2),
    ("name", r"(?i)\b(?:w-?2|1099|tax|mortgage)\b", -20),
)
LEAST = 6


def rule_hits(name: Column, text: Column, rules=SEARCH_RULES) -> Column:
    source = {"name": name, "text": text}
    total = F.lit(0)
    for where, pattern, weight in rules:
        total = total + F.when(source[where].rlike(pattern), weight).otherwise(0)
    return total


def search(df: DataFrame, key: str, path: str, text: str, rules=SEARCH_RULES, least: int = LEAST) -> DataFrame:
    """(key, path, score, kind) of the rows that score at least ``least``, highest first.

    kind says which side matched: name_and_text, name, text or none. Every pattern is tested in the JVM; the order
    is a sort, not a driver-side list. Null names and texts match nothing.
    """
    name, body = F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    score = rule_hits(name, body, rules)
    side = lambda w: rule_hits(name, body, [r for r in rules if r[0] == w and r[2] > 0]) > 0
    kind = F.when(side("name") & side("text"), "name_and_text").when(side("name"), "name").when(side("text"), "text").otherwise("none")
    return df.select(key, path, score.cast("long").alias("score"), kind.alias("kind")).where(F.col("score") >= least).orderBy(F.desc("score"), F.lower(path))


def search_hits(df: DataFrame, key: str, path: str, text: str, rules=SEARCH_RULES, least: int = LEAST) -> DataFrame:
    """(key, score, kind) of what a search keeps: all but what scores below ``least`` and is of no class; highest first."""
    name, body = F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = df.select(key, path, rule_hits(name, body, rules).cast("long").alias("score"), hit_class(name, body).alias("kind"))
    return rows.where((F.col("score") >= least) | (F.col("kind") != "weak")).orderBy(F.desc("score"), F.lower(path)).drop(path)


def hits_sql(rules=None, least: int = LEAST) -> str:
    source = {"name": "name", "text": "t"}
    score = " + ".join(f"CASE WHEN regexp_matches({source[w]}, '{p}') THEN {n} ELSE 0 END" for w, p, n in rules or SEARCH_RULES)
    cases = " ".join(f"WHEN {' AND '.join([*([f"regexp_matches(name, '{a}')"] if a else []), *([f"regexp_matches(t, '{b}')"] if b else [])])} THEN '{k}'" for k, a, b in SEARCH_CLASSES)
    return f"""WITH s AS (SELECT doc_id, coalesce(list_extract(string_split(rel_path, '/'), -1), '') AS name, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, CAST({score} AS BIGINT) AS score, CASE {cases} ELSE 'weak' END AS kind FROM s) SELECT * FROM h WHERE score >= {least} OR kind <> 'weak'"""


def search_sql(rules, least: int = LEAST) -> str:
    source = {"name": "coalesce(list_extract(string_split(rel_path, '/'), -1), '')", "text": "coalesce(text, '')"}
    term = lambda r: f"CASE WHEN regexp_matches({source[r[0]]}, '{r[1]}') THEN {r[2]} ELSE 0 END"
    side = {w: " OR ".join(f"regexp_matches({source[w]}, '{p}')" for x, p, n in rules if x == w and n > 0) for w in ("name", "text")}
    return f"""WITH s AS (SELECT doc_id, {' + '.join(map(term, rules))} AS score, ({side['name']}) AS a, ({side['text']}) AS b FROM documents)
SELECT doc_id, CAST(score AS BIGINT) AS score, CASE WHEN a AND b THEN 'name_and_text' WHEN a THEN 'name' WHEN b THEN 'text' ELSE 'none' END AS kind FROM s WHERE score >= {least}"""


#: (class, what the name must match, what the text must match), the first that holds. A parameter.
SEARCH_CLASSES = (
    ("event_here", r"(?i)\b(?:agenda|programme|sign-?in)\b", r"(?i)\b(?:workshop|training|course)\b"),
    ("event_travel", r"(?i)\b(?:travel|trip|itinerary|mileage|lodging)\b", r"(?i)\b(?:workshop|conference|training)\b"),
    ("travel", r"(?i)\b(?:travel|trip|itinerary|mileage|lodging)\b", ""),
    ("travel", "", r"(?i)\b(?:hotel|hostel|itinerary|airfare|luggage|railcard)\b"),
    ("event", "", r"(?i)\b(?:workshop|conference|training)\b"),
)
#: Names that are opened, names that never are, types without text, and the size beyond which only travel papers are opened.
OPENED = r"(?i)\b(?:travel|trip|itinerary|mileage|lodging|workshop|conference|training|course|meeting|campus|form)\b"
TRAVEL_NAME = r"(?i)\b(?:travel|trip|itinerary|mileage|lodging)\b"
NEVER = r"(?i)\b(?:w-?2|1099|tax|mortgage|immunization)\b"
NO_TEXT = ("key", "numbers", "pages", "mov", "mp4", "mp3", "exe", "dll", "bin")
LARGEST = 8_000_000


def _holds(name: Column, text: Column, a: str, b: str) -> Column:
    return (name.rlike(a) if a else F.lit(True)) & (text.rlike(b) if b else F.lit(True))


def hit_class(name: Column, text: Column, classes=SEARCH_CLASSES) -> Column:
    """The first class whose patterns name and text match, else 'weak'."""
    out = F.when(_holds(name, text, *classes[0][1:]), classes[0][0])
    for kind, a, b in classes[1:]:
        out = out.when(_holds(name, text, a, b), kind)
    return out.otherwise("weak")


def dated_years(text: Column) -> Column:
    """Years named in full, then those of dates such as 6/14/25, then those of short forms such as '25; each once."""
    full = F.regexp_extract_all(text, F.lit(r"(?U)\b((?:19|20)\d\d)\b"), F.lit(1))
    short = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda y: F.concat(F.lit("20"), y))
    return F.array_distinct(F.concat(F.array_sort(F.array_distinct(full)), F.array_sort(short(r"(?:^|[^0-9/])\d{1,2}/\d{1,2}/(\d\d)(?:$|[^0-9/])")), F.array_sort(short(r"(?:^|[^0-9A-Za-z])['’](\d\d)(?:$|[^0-9A-Za-z])"))))


def worth_opening(path: Column, size: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    plain = F.regexp_replace(name, "[_-]+", " ")
    return F.coalesce(plain.rlike(OPENED) & ~plain.rlike(NEVER) & ~ext.isin(*NO_TEXT) & ((F.coalesce(size, F.lit(0)) <= LARGEST) | plain.rlike(TRAVEL_NAME)), F.lit(False))


def class_sql() -> str:
    cases = " ".join(f"WHEN {' AND '.join([*([f"regexp_matches(name, '{a}')"] if a else []), *([f"regexp_matches(t, '{b}')"] if b else [])])} THEN '{k}'" for k, a, b in SEARCH_CLASSES)
    short = lambda p: f"list_sort(list_transform(regexp_extract_all(t, '{p}', 1), lambda y: '20' || y))"
    date = short(r"(?:^|[^0-9/])\d{1,2}/\d{1,2}/(\d\d)(?:$|[^0-9/])")
    mark = short(r"(?:^|[^0-9A-Za-z])[''’](\d\d)(?:$|[^0-9A-Za-z])")
    return rf"""WITH s AS (SELECT doc_id, coalesce(list_extract(string_split(rel_path, '/'), -1), '') AS name, coalesce(text, '') AS t FROM documents),
y AS (SELECT *, list_concat(list_sort(list_distinct(regexp_extract_all(t, '\b((?:19|20)\d\d)\b', 1))), {date}, {mark}) AS ys FROM s)
SELECT doc_id, CASE {cases} ELSE 'weak' END AS kind, array_to_string(list_filter(ys, lambda v, i: list_position(ys, v) = i), ',') AS years FROM y"""


def candidate_sql() -> str:
    return rf"""WITH s AS (SELECT extract_id, rel_path, size_bytes, regexp_replace(list_extract(string_split(rel_path, '/'), -1), '[_-]+', ' ', 'g') AS name, lower(regexp_extract(rel_path, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM extract_record)
SELECT extract_id, rel_path FROM s WHERE regexp_matches(name, '{OPENED}') AND NOT regexp_matches(name, '{NEVER}') AND ext NOT IN ({", ".join(f"'{x}'" for x in NO_TEXT)}) AND (coalesce(size_bytes, 0) <= {LARGEST} OR regexp_matches(name, '{TRAVEL_NAME}'))"""


#: A person on a labelled line.
LABELLED_PERSON = r"(?:Recipient|Attendee|Traveler|Employee name|Guest name): ([A-Z][\p{L}.'-]+(?: [A-Z][\p{L}.'-]+){1,3})"


#: Surname and initial as a hotel's folio has them, before the word NAME.
FOLIO_PERSON = r"(?sU)\b(\p{Lu}{3,}/\p{Lu})\b(?=.{0,40}NAME)"


def people_in(text: Column) -> Column:
    """People on labelled lines, then those of folios (as initial and surname), each once whatever the case."""
    flat = collapse_spaced_title(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    folio = F.transform(F.regexp_extract_all(text, F.lit(FOLIO_PERSON), F.lit(1)), lambda m: F.concat(F.right(m, F.lit(1)), F.lit(". "), F.initcap(F.split_part(m, F.lit("/"), F.lit(1)))))
    return distinct_words(F.concat(F.regexp_extract_all(flat, F.lit(LABELLED_PERSON), F.lit(1)), folio))


def people(df: DataFrame, key: str, text: str) -> DataFrame:
    """(person, files, first_key, years): people on labelled lines and folios, without regard to case, over all rows."""
    each = df.where(F.col(text).isNotNull()).select(key, F.explode(people_in(F.col(text))).alias("person"), years_in(F.col(text)).alias("ys"))
    named = each.groupBy(F.lower("person").alias("who")).agg(F.min_by("person", F.struct(key, "person")).alias("person"), F.countDistinct(key).alias("files"), F.min(key).alias("first_key"))
    years = each.select(F.lower("person").alias("who"), F.explode("ys").alias("y")).groupBy("who").agg(F.array_join(F.array_sort(F.collect_set("y")), ",").alias("years"))
    return named.join(years, "who", "left").select("person", "files", "first_key", F.coalesce("years", F.lit("")).alias("years"))
