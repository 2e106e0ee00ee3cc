"""Queries over extracted texts and file names, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import priors as P
from docloom.functions import textops as X
from docloom.functions.modelio import parse_model_json
from docloom.operators.chunking import group_chunks, overlap_chunks
from docloom.operators.search import SEARCH_RULES, people, search
from docloom.session import spread, table

#: The other engine's word borders are those of ASCII: a mark and a low line after each other letter or digit set them right.
#: What begins at such a mark is the rest of a word and no match of its own.
_MARKED = r"""regexp_replace(regexp_replace(coalesce(text, ''), '[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', ' ', 'g'), '[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]', '_' || chr(57344), 'g')"""


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _found(pattern: str) -> str:
    """SQL list of the matches in the marked text t."""
    return rf"list_filter(regexp_extract_all(t, '\x{{E000}}[A-Za-z0-9_]*|{_q(pattern)}'), lambda m: NOT starts_with(m, chr(57344)))"


def _kind(kind: str, part: int, pattern: str, sample: str) -> str:
    found = _found(pattern)
    return f"SELECT extract_id, '{kind}' AS kind, {part} AS part, unnest(list_transform({found}, lambda m: {sample})) AS sample, generate_subscripts({found}, 1) AS i FROM src"


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = """list_sum(list_transform(range(length(c)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(c, length(c) - i, 1) AS INT)
 ELSE (CAST(substr(c, length(c) - i, 1) AS INT) * 2) - CASE WHEN CAST(substr(c, length(c) - i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_CARD_SQL = r"\b(?:\d[ -]*?){13,19}\b"
_WORDS_SQL = _found(r"(?i:\b(?:social security|date of birth|driver'?s license|passport number|routing number|account number|student id|medical record|password|api key|private key|confidential)\b)")
_SCAN_SQL = f"""
WITH src AS (SELECT extract_id, {_MARKED} AS t FROM extract_record),
cards AS (SELECT extract_id, unnest(list_transform({_found(_CARD_SQL)}, lambda m: {_DIGITS})) AS c, generate_subscripts({_found(_CARD_SQL)}, 1) AS i FROM src),
words AS (SELECT extract_id, list_sort(list_distinct(list_transform({_WORDS_SQL}, lambda m: lower(m)))) AS w FROM src),
hits AS (
  {_kind('ssn', 1, r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b", "'***-**-' || right(m, 4)")}
  UNION ALL {_kind('email', 1, r"(?i:\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b)", "left(m, 1) || '***@' || split_part(m, '@', 2)")}
  UNION ALL {_kind('phone', 1, r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b", "'***-***-' || right(" + _DIGITS + ", 4)")}
  UNION ALL {_kind('dob', 1, r"(?i:\b(?:dob|date of birth|born)\b[:\s]*\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", "'**/**/****'")}
  UNION ALL {_kind('address', 1, r"(?i:\b\d{1,6}\s+[A-Za-z0-9][A-Za-z0-9.'\- ]{1,40}\s+(?:St|Street|Ave|Avenue|Rd|Road|Ln|Lane|Blvd|Dr|Drive|Ct|Court|Way|Pkwy|Hwy|Highway)\.?\b)", "'[street]'")}
  UNION ALL {_kind('address', 2, r"(?i:\bP\.?\s*O\.?\s*Box\s+\d+\b)", "'[po-box]'")}
  UNION ALL {_kind('address', 3, r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b", "'[st-zip]'")}
  UNION ALL SELECT extract_id, 'credit_card', 1, '****-****-****-' || right(c, 4), i FROM cards WHERE length(c) BETWEEN 13 AND 19 AND {_LUHN}
  UNION ALL SELECT extract_id, 'sensitive_keyword', 1, array_to_string(w[1:8], ', '), 1 FROM words WHERE len(w) > 0),
firsts AS (SELECT extract_id, kind, sample, min(part * 1000000 + i) AS pos FROM hits GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY extract_id, kind ORDER BY pos) AS rn FROM firsts),
samples AS (SELECT extract_id, kind, string_agg(sample, ' | ' ORDER BY pos) AS samples FROM ranked WHERE rn <= 5 GROUP BY ALL),
counts AS (SELECT extract_id, kind, count(*) AS n FROM hits GROUP BY ALL)
"""


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    texts = spread(table(spark, d, "extract_record").select("extract_id", "doc_id", "rel_path", "owner_id", "text"))
    # an exploded array of one is computed once: filters on it are not pushed below and evaluated again
    return texts.select("extract_id", "doc_id", "rel_path", "owner_id", F.explode(F.array(P.scan_map(F.col("text")))).alias("priors"))


def prior_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = _scanned(spark, d).select("extract_id", F.explode_outer("priors").alias("kind", "v")).where("kind IS NOT NULL")
    return rows.select("extract_id", "kind", F.col("v.count").cast("long").alias("n"), F.array_join("v.redacted_samples", " | ").alias("samples"))


def prior_severity(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.map_keys("priors")
    return _scanned(spark, d).select("extract_id", P.severity(kinds).alias("severity"), P.has_identifier(kinds).alias("has_identifier"))


def prior_severity_by_owner(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d).groupBy("owner_id", P.severity(F.map_keys("priors")).alias("severity")).agg(F.count(F.lit(1)).alias("texts"))


def prior_cards(spark: SparkSession, d: str) -> DataFrame:
    texts = spread(table(spark, d, "extract_record").select("extract_id", "text")).select("extract_id", P.scan(F.col("text"))["credit_card"].alias("c"))
    return texts.where(F.size("c") > 0).select("extract_id", F.size("c").cast("long").alias("cards"), F.array_join("c", " | ").alias("samples"))


def prior_nine_digits(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "extract_record").select("extract_id", P.windowed_nine_digits(F.col("text")).alias("s"))
    return found.where(F.size("s") > 0).select("extract_id", F.size("s").alias("n"), F.array_join(F.array_distinct("s"), " | ").alias("samples"))


def pii_map(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the scan with any identifier and the kinds found."""
    kinds = F.map_keys("priors")
    return _scanned(spark, d).where(P.has_identifier(kinds)).select("extract_id", "rel_path", F.array_join(kinds, ", ").alias("kinds"))


def filename_hints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extract_record").select("extract_id", F.array_join(P.filename_tags(F.col("rel_path")), ",").alias("hints"))


def filename_hint_histogram(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "extract_record").select(F.explode(P.filename_tags(F.col("rel_path"))).alias("hint"))
    return each.groupBy("hint").agg(F.count(F.lit(1)).alias("files"))


def extraction_record(spark: SparkSession, d: str) -> DataFrame:
    """Total record of an extraction: blank text is an error of its own, the method stays."""
    e = table(spark, d, "extract_record")
    blank = F.coalesce(X.strip_all(F.col("text")) == "", F.lit(True))
    error = F.when(F.col("extraction_error").isNotNull(), F.col("extraction_error")).when(blank, "no text extracted")
    return e.select("extract_id", (~blank & F.coalesce("extraction_ok", F.lit(False))).alias("ok"), "extraction_method", error.alias("error"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"))


def extraction_methods(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extract_record")
    return e.groupBy("ext", "extraction_method").agg(F.count(F.lit(1)).alias("files"), F.count_if(X.enough_text(F.col("text"))).alias("readable"), F.sum("size_bytes").alias("bytes"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    digest = F.sha2(F.encode("text", "UTF-8"), 256)
    return table(spark, d, "documents").select("doc_id", digest.alias("content_hash"), F.left(digest, F.lit(16)).alias("short_id"))


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Groups of identical texts; the last path in component order stands for the group."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("rel_path", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))
    groups = docs.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.max("rel_path").alias("kept_path"))
    return groups.where("copies > 1")


def filename_people(spark: SparkSession, d: str) -> DataFrame:
    """Candidate names in titled file names, built from the plan's titles and the file names' own words."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("x/"), F.initcap(F.translate(X.bare_stem(F.col("rel_path")), "-_", "  ")), F.lit(".pdf")).alias("path"))
    return docs.select("doc_id", F.array_join(X.names_in_filename(F.col("path")), "|").alias("names"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<html><style>p {x}</style><p class='a'>"), F.col("text"), F.lit("</p><script>var a = 1;</script></html>"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.strip_html(page)).alias("text_md5"), F.length(X.strip_html(page)).cast("long").alias("chars"))


def rtf_text(spark: SparkSession, d: str) -> DataFrame:
    rtf = F.concat(F.lit(r"{\rtf1\ansi\deff0 \pard\b0 "), F.col("summary"), F.lit(r"\par }"))
    return table(spark, d, "tags").where("summary IS NOT NULL").select("doc_id", X.strip_rtf(rtf).alias("text")).distinct()


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = overlap_chunks(table(spark, d, "extract_record"), "extract_id", "text")
    return chunks.select("extract_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("start"), F.char_length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("chunk_md5"))


def bare_stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.bare_stem(F.col("rel_path")).alias("stem"), X.path_extension(F.col("rel_path")).alias("ext"))


def redacted_summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "layer_record").where("summary IS NOT NULL").select("doc_id", X.redact_snippet(F.col("summary")).alias("summary")).distinct()


def years_named(spark: SparkSession, d: str) -> DataFrame:
    years = X.years_in(F.col("text"))
    return table(spark, d, "documents").where(F.size(years) > 0).select("doc_id", F.array_join(years, ",").alias("years"))


def spaced_titles(spark: SparkSession, d: str) -> DataFrame:
    spaced = F.regexp_replace("title", "(?<=[A-Za-z])(?=[A-Za-z])", " ")
    return table(spark, d, "file_plan").select("plan_id", X.collapse_spaced_title(spaced).alias("title"))


def keyword_in_context(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", X.keyword_snippets(F.col("text"), r"(?i)\b(?:invoice|contract|insurance)\b").alias("s"))
    return found.where(F.size("s") > 0).select("doc_id", F.posexplode("s").alias("place", "snippet")).select("doc_id", "place", X.redact_snippet(F.col("snippet")).alias("snippet"))


def group_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_kind", "rel_path")
    return group_chunks(docs.where("doc_kind IS NOT NULL"), "doc_kind", ["rel_path"]).select("doc_kind", "rel_path", "chunk_id", "place")


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return search(spread(table(spark, d, "documents").select("doc_id", "rel_path", "text")), "doc_id", "rel_path", "text").select("doc_id", "score", "kind")


def search_people(spark: SparkSession, d: str) -> DataFrame:
    return people(spread(table(spark, d, "extract_record").select("extract_id", "text")), "extract_id", "text")


def model_json(spark: SparkSession, d: str) -> DataFrame:
    """Answers in the forms models give, built from the summaries, and what is read from them."""
    t = table(spark, d, "layer_record").where("main IS NOT NULL").select("doc_id", "stamped_at", F.to_json(F.struct("main", "sub")).alias("j"))
    form = F.ascii(F.md5("doc_id")) % 4
    text = F.when(form == 0, F.col("j")).when(form == 1, F.concat(F.lit("Here:\n```json\n"), F.col("j"), F.lit("\n```"))).when(form == 2, F.regexp_replace("j", r"\}$", ",}")).otherwise(F.concat(F.lit("Sure. "), F.col("j"), F.lit(" Done")))
    v = parse_model_json(text)
    return t.select("doc_id", F.variant_get(v, "$.main", "string").alias("main"), F.try_variant_get(v, "$.sub", "string").alias("sub")).distinct()


def _hint_case(col: str) -> str:
    name = f"list_extract(string_split({col}, '/'), -1)"
    return ", ".join(f"CASE WHEN regexp_matches({name}, '{_q(p)}') OR regexp_matches({col}, '{_q(p)}') THEN '{k}' END" for k, p in P.FILENAME_HINTS.items())


_BLANK = r"coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g') = '', true)"

_HEARD = r"(?i)\b(?:invoice|contract|insurance)\b"
_MASKED = r"""trim(regexp_replace(regexp_replace(regexp_replace({0}, '\b\d{{3}}[-\s]\d{{2}}[-\s](\d{{4}})\b', '***-**-\1', 'g'), '(?i)\b([A-Z0-9])[A-Z0-9._%+\-]*@([A-Z0-9.\-]+\.[A-Z]{{2,}})\b', '\1***@\2', 'g'), '\s+', ' ', 'g'))"""


def _people_sql() -> str:
    """Names in file names: the forms in their order, then runs of capitalised words; the first spelling of each stays."""
    stem = r"""trim(regexp_replace(regexp_replace(regexp_replace(list_extract(string_split(rel_path, '/'), -1), '(?i)\(secured\)', '', 'g'), '(?i)(\.(pdf|docx?|pptx?|xlsx?|txt|html?|rtf|md|csv|jpe?g|png))+$', '', 'g'), '\(\d+\)', '', 'g'))"""
    words = f"array_to_string(list_transform(string_split(translate({stem}, '-_', '  '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
    noise = ", ".join(f"'{w}'" for w in X.NAME_NOISE)
    clean = lambda r: f"array_to_string(list_filter(string_split_regex({r}, '\\s+'), lambda w: lower(w) NOT IN ({noise})), ' ')".replace("\\\\", "\\")
    forms = ", ".join(f"regexp_extract(s, '{_q(p)}', 1)" for p in X.NAME_FORMS)
    runs = r"regexp_extract_all(regexp_replace(s, '[_]+', ' ', 'g'), '((?:\p{Lu}\.|\p{Lu}[\p{L}''-]+)(?:\s+\p{Lu}[\p{L}''-]+){1,2})', 1)"
    return rf"""WITH d AS (SELECT doc_id, trim({words}) AS s FROM documents),
 n AS (SELECT doc_id, list_filter(list_concat(list_transform([{forms}], lambda r: {clean('r')}), list_filter(list_transform({runs}, lambda r: {clean('r')}), lambda r: regexp_matches(r, '\S\s+\S'))), lambda r: r <> '') AS v FROM d)
 SELECT doc_id, array_to_string(list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i), '|') AS names FROM n"""


def queries() -> dict:
    names = "prior_samples prior_severity prior_severity_by_owner prior_cards prior_nine_digits pii_map filename_hints filename_hint_histogram extraction_record extraction_methods content_hashes duplicate_texts filename_people html_text rtf_text text_chunks bare_stems redacted_summaries years_named spaced_titles keyword_in_context group_chunk_ids keyword_search search_people model_json"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    from docloom.operators.search import search_sql

    return {
        "prior_samples": _SCAN_SQL + "SELECT s.extract_id, s.kind, n, samples FROM samples s JOIN counts c ON s.extract_id = c.extract_id AND s.kind = c.kind",
        "prior_severity": _SCAN_SQL + """SELECT src.extract_id, CASE WHEN bool_or(kind IN ('ssn', 'credit_card')) THEN 'high' WHEN bool_or(kind IS NOT NULL) THEN 'medium' ELSE 'low' END AS severity,
 coalesce(bool_or(kind <> 'sensitive_keyword'), false) AS has_identifier FROM src LEFT JOIN counts ON src.extract_id = counts.extract_id GROUP BY 1""",
        "prior_severity_by_owner": _SCAN_SQL + """, sev AS (SELECT src.extract_id, CASE WHEN bool_or(kind IN ('ssn', 'credit_card')) THEN 'high' WHEN bool_or(kind IS NOT NULL) THEN 'medium' ELSE 'low' END AS severity
 FROM src LEFT JOIN counts ON src.extract_id = counts.extract_id GROUP BY 1) SELECT owner_id, severity, count(*) AS texts FROM sev JOIN extract_record e ON e.extract_id = sev.extract_id GROUP BY 1, 2""",
        "prior_cards": _SCAN_SQL + "SELECT extract_id, count(*) AS cards, string_agg(sample, ' | ' ORDER BY i) AS samples FROM hits WHERE kind = 'credit_card' GROUP BY extract_id",
        "pii_map": _SCAN_SQL + """, o AS (SELECT extract_id, kind, CASE kind WHEN 'ssn' THEN 1 WHEN 'email' THEN 2 WHEN 'phone' THEN 3 WHEN 'dob' THEN 4 WHEN 'address' THEN 5 WHEN 'credit_card' THEN 6 ELSE 7 END AS p FROM counts)
 SELECT o.extract_id, any_value(rel_path) AS rel_path, string_agg(kind, ', ' ORDER BY p) AS kinds FROM o JOIN extract_record e ON e.extract_id = o.extract_id GROUP BY 1 HAVING bool_or(kind <> 'sensitive_keyword')""",
        "filename_hints": f"SELECT extract_id, concat_ws(',', {_hint_case('rel_path')}) AS hints FROM extract_record",
        "filename_hint_histogram": f"SELECT hint, count(*) AS files FROM (SELECT unnest([{_hint_case('rel_path')}]) AS hint FROM extract_record) WHERE hint IS NOT NULL GROUP BY 1",
        "extraction_record": f"SELECT extract_id, NOT {_BLANK} AND coalesce(extraction_ok, false) AS ok, extraction_method, CASE WHEN extraction_error IS NOT NULL THEN extraction_error WHEN {_BLANK} THEN 'no text extracted' END AS error, coalesce(length(text), 0) AS chars FROM extract_record",
        "extraction_methods": r"SELECT ext, extraction_method, count(*) AS files, CAST(count_if(coalesce(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 30, false)) AS BIGINT) AS readable, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM extract_record GROUP BY 1, 2",
        "content_hashes": "SELECT doc_id, sha256(text) AS content_hash, left(sha256(text), 16) AS short_id FROM documents",
        "duplicate_texts": "SELECT sha256(text) AS content_hash, count(*) AS copies, max(rel_path) AS kept_path FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "html_text": r"""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('<html><style>p {x}</style><p class=''a''>' || text || '</p><script>var a = 1;</script></html>',
 '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
 SELECT doc_id, md5(t) AS text_md5, length(t) AS chars FROM p""",
        "rtf_text": r"""SELECT DISTINCT doc_id, regexp_replace(regexp_replace('{\rtf1\ansi\deff0 \pard\b0 ' || summary || '\par }', '\\[a-z]+-?\d* ?', '', 'g'), '[{}]', '', 'g') AS text FROM tags WHERE summary IS NOT NULL""",
        "text_chunks": """WITH b AS (SELECT extract_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM extract_record),
 s AS (SELECT extract_id, t, n, unnest(CASE WHEN n <= 12000 THEN [0] ELSE range(0, n, 9600) END) AS start FROM b)
 SELECT extract_id, start // 9600 AS chunk_no, start, length(substr(t, start + 1, CASE WHEN n <= 12000 THEN n ELSE 10000 END)) AS chars, md5(substr(t, start + 1, CASE WHEN n <= 12000 THEN n ELSE 10000 END)) AS chunk_md5 FROM s""",
        "bare_stems": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(list_extract(string_split(rel_path, '/'), -1), '(?i)\(secured\)', '', 'g'),
 '(?i)(\.(pdf|docx?|pptx?|xlsx?|txt|html?|rtf|md|csv|jpe?g|png))+$', '', 'g'), '\(\d+\)', '', 'g')) AS stem, lower(regexp_extract(rel_path, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM documents""",
        "redacted_summaries": r"""SELECT DISTINCT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(summary, '\b\d{3}[-\s]\d{2}[-\s](\d{4})\b', '***-**-\1', 'g'),
 '(?i)\b([A-Z0-9])[A-Z0-9._%+\-]*@([A-Z0-9.\-]+\.[A-Z]{2,})\b', '\1***@\2', 'g'), '\s+', ' ', 'g')) AS summary FROM layer_record WHERE summary IS NOT NULL""",
        "years_named": rf"""WITH m AS (SELECT doc_id, {_MARKED} AS t FROM documents),
 y AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(t, '\x{{E000}}[A-Za-z0-9_]*|\b(19\d\d|20\d\d)\b', 1), lambda v: v <> ''))) AS ys FROM m) SELECT doc_id, array_to_string(ys, ',') AS years FROM y WHERE len(ys) > 0""",
        "group_chunk_ids": """WITH n AS (SELECT doc_kind, rel_path, row_number() OVER (PARTITION BY doc_kind ORDER BY rel_path) - 1 AS k FROM documents WHERE doc_kind IS NOT NULL)
 SELECT doc_kind, rel_path, doc_kind || '#' || CASE WHEN k // 12 + 1 < 100 THEN lpad(CAST(k // 12 + 1 AS VARCHAR), 2, '0') ELSE CAST(k // 12 + 1 AS VARCHAR) END AS chunk_id, CAST(k % 12 AS INT) AS place FROM n""",
        "keyword_search": search_sql(SEARCH_RULES),
        "filename_people": _people_sql(),
        "keyword_in_context": f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '{_HEARD}') AS m, regexp_split_to_array(text, '{_HEARD}') AS p FROM documents WHERE regexp_matches(text, '{_HEARD}')),
 k AS (SELECT *, unnest(range(1, least(len(m), 3) + 1)) AS k FROM t),
 s AS (SELECT doc_id, k - 1 AS place, text, length(m[k]) AS n, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM k),
 c AS (SELECT doc_id, CAST(place AS INT) AS place, substr(text, greatest(a - 90, 0) + 1, a + n + 90 - greatest(a - 90, 0)) AS cut FROM s)
 SELECT doc_id, place, {_MASKED.format('cut')} AS snippet FROM c""",
        "model_json": "SELECT DISTINCT doc_id, main, sub FROM layer_record WHERE main IS NOT NULL",
        "prior_nine_digits": r"""WITH s AS (SELECT extract_id, text AS t FROM extract_record WHERE regexp_matches(text, '\d{9}') AND regexp_matches(text, '(?i)\b(ssn|ss#|social\s*security|itin|taxpayer\s*id|tin)\b')),
 p AS (SELECT extract_id, t, unnest(range(1, length(t) - 7)) AS i FROM s),
 h AS (SELECT extract_id, i, '*****-' || substr(t, i + 5, 4) AS sample FROM p WHERE regexp_matches(substr(t, i, 9), '^\d{9}$') AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[\pL\pN_]')) AND NOT regexp_matches(substr(t, i + 9, 1), '[\pL\pN_]')
  AND regexp_matches(substr(t, greatest(1, i - 40), least(40, i - 1) + 49), '(?i)\b(ssn|ss#|social\s*security|itin|taxpayer\s*id|tin)\b')),
 f AS (SELECT extract_id, sample, min(i) AS i FROM h GROUP BY ALL)
 SELECT h.extract_id, CAST(count(*) AS INT) AS n, any_value(x.samples) AS samples FROM h JOIN (SELECT extract_id, string_agg(sample, ' | ' ORDER BY i) AS samples FROM f GROUP BY 1) x ON x.extract_id = h.extract_id GROUP BY 1""",
        "spaced_titles": "SELECT plan_id, replace(title, ' ', '') AS title FROM file_plan",
    }
