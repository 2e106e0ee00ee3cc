"""SQL of those queries that SQL can express on whole tables."""

_K = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"

_TERMS = f"""
WITH t AS (SELECT doc_id, tags, entities, row_number() OVER (PARTITION BY doc_id ORDER BY stamped_at DESC NULLS LAST) AS rn FROM tags WHERE doc_id IS NOT NULL),
l AS (SELECT doc_id, main, row_number() OVER (PARTITION BY doc_id ORDER BY stamped_at DESC NULLS LAST) AS rn FROM layer_record WHERE doc_id IS NOT NULL),
raw AS (
  SELECT 'tags' AS field, doc_id, unnest(tags) AS v FROM t WHERE rn = 1
  UNION ALL SELECT 'entities', doc_id, unnest(entities) FROM t WHERE rn = 1
  UNION ALL SELECT 'main', doc_id, main FROM l WHERE rn = 1),
terms AS (SELECT field, doc_id, {_K.format('v')} AS term FROM raw WHERE v IS NOT NULL),
kept AS (SELECT * FROM terms WHERE term <> ''),
totals AS (SELECT field, count(DISTINCT doc_id) AS n FROM kept GROUP BY field),
freq AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM kept GROUP BY field, term)
"""

_PAIRS = (
    _TERMS
    + """, one AS (SELECT DISTINCT field, doc_id, term FROM kept WHERE field <> 'main'),
pairs AS (SELECT x.field, x.term AS item_a, y.term AS item_b, count(*) AS ab FROM one x JOIN one y ON x.field = y.field AND x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL),
cases AS (SELECT p.field, item_a, item_b, n, fa.records AS a, fb.records AS b, ab FROM pairs p JOIN totals t ON p.field = t.field
  JOIN freq fa ON fa.field = p.field AND fa.term = item_a JOIN freq fb ON fb.field = p.field AND fb.term = item_b
  WHERE ab >= 5 AND ab >= 0.001 * n)
"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT extract_id FROM extract_record WHERE length(text) > 12000",
        "p2_terms": _TERMS
        + """SELECT f.field, term, occurrences, records, records / n AS share,
concat_ws(',', CASE WHEN records <= 2 THEN 'rare' END, CASE WHEN records > n * 0.1 THEN 'common' END) AS marks
FROM freq f JOIN totals t ON f.field = t.field WHERE f.field <> 'entities'""",
        "p2_found": _TERMS
        + """SELECT f.field, term, 'rare' AS mark FROM freq f WHERE records <= 2 AND f.field <> 'entities'
UNION ALL SELECT f.field, term, 'common' FROM freq f JOIN totals t ON f.field = t.field WHERE records > n * 0.1 AND f.field <> 'entities'""",
        "p4_pairs": _PAIRS
        + """SELECT field, item_a, item_b, n, a, b, ab, (ab * n) / (a * b) AS lift,
CASE WHEN a > ab THEN (a * (n - b)) / (n * (a - ab)) END AS conviction FROM cases""",
        "p4_found": _PAIRS + "SELECT field, item_a, item_b FROM cases WHERE ab * n >= 4 * a * b",
    }
