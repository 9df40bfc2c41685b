"""SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from lurus.llm.text import CATEGORIES


def _letters(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g'))"


def _canonical(x: str) -> str:
    """As lurus.llm.text.canonical."""
    breaks = "[;|\\n\\r\\x0B\\x0C\\x{85}\\x{2028}\\x{2029}]+"
    fields = f"list_filter(regexp_split_to_array({x}, '{breaks}'), lambda f: regexp_matches(f, '[\\p{{L}}\\p{{Nd}}]'))"
    labelled = f"len({fields}) >= 2 AND len(list_filter({fields}, lambda f: NOT regexp_matches(f, '(?s)^[^:]*[\\p{{L}}\\p{{Nd}}][^:]*:.*[\\p{{L}}\\p{{Nd}}]'))) = 0"
    ordered = f"array_to_string(list_sort(list_transform({fields}, lambda f: {_letters('f')})), '')"
    return f"coalesce(CASE WHEN {labelled} THEN {ordered} ELSE {_letters(x)} END, '')"


_BARE = "lower(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
_SPLIT = f"CASE WHEN {_BARE.format('split')} IN ('valid', 'validation') THEN 'val' WHEN {_BARE.format('split')} IN ('train', 'val', 'test') THEN {_BARE.format('split')} END"
_CATEGORY = "CASE " + " ".join(f"WHEN {_BARE.format('category')} IN ('{c}', '{n}') THEN '{n}'" for c, n in CATEGORIES.items()) + " END"

_P2 = f"""WITH k AS (SELECT {_SPLIT} AS split, {_CATEGORY} AS category FROM syn_metadata), h AS (SELECT split, category, count(*) AS available FROM k WHERE split IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2),
n AS (SELECT split, sum(available)::BIGINT AS n FROM h GROUP BY 1),
r AS (SELECT t.split, t.category, coalesce(n, 0) AS n, coalesce(available, 0) AS available, greatest(min_rows::DOUBLE, target_share * sample_fraction * coalesce(n, 0)) AS wanted
FROM (SELECT DISTINCT split, category, target_share, sample_fraction, min_rows FROM sample_targets) t LEFT JOIN h USING (split, category) LEFT JOIN n ON n.split = t.split)"""

_P4 = """WITH raw AS (SELECT 'kalimat_koreksi' AS field_name, id::BIGINT AS record, kalimat_koreksi AS text FROM (SELECT DISTINCT id, kalimat_koreksi FROM predictions)
UNION ALL SELECT 'token_benar', ann_id, e.token_benar FROM (SELECT ann_id, unnest(s.errors) AS e FROM (SELECT ann_id, unnest(sentences) AS s FROM (SELECT DISTINCT ann_id, sentences FROM annotations))) WHERE e IS NOT NULL
UNION ALL SELECT DISTINCT 'formal', rule_id, formal FROM algospeak_dict),
r AS (SELECT * FROM raw WHERE record IS NOT NULL AND text IS NOT NULL), t AS (SELECT field_name, record, lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{Nd}]+'))) AS term FROM r),
n AS (SELECT field_name, count(DISTINCT record) AS records FROM t GROUP BY 1), c AS (SELECT field_name, term, count(DISTINCT record) AS n_records, count(*) AS n_occurrences FROM t GROUP BY 1, 2),
m AS (SELECT field_name, term, n_records, n_occurrences, CASE WHEN n_records <= 1 THEN 'rare' WHEN n_records > 0.1 * records THEN 'common' END AS mark FROM c JOIN n USING (field_name))"""

_P6 = f"""WITH k AS (SELECT image_id, {_canonical('src_text')} AS a, {_canonical('trg_text')} AS b FROM syn_metadata),
g AS (SELECT image_id, min(image_id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS kept, count(*) OVER (PARTITION BY least(a, b), greatest(a, b)) AS copies FROM k WHERE a <> '' AND b <> '')"""

SQL: dict[str, str] = {
    "p2_found": f"{_P2} SELECT split, category FROM r WHERE available < wanted",
    "p2_report": f"{_P2} SELECT split, category, n, available, round(wanted, 6) AS wanted, least(ceil(wanted)::BIGINT, available) AS quota, available < wanted AS exhausted FROM r",
    "p2_sample": f"""{_P2}, q AS (SELECT split, category, max(least(ceil(wanted)::BIGINT, available)) AS quota FROM r GROUP BY 1, 2), m AS (SELECT image_id, {_SPLIT} AS split, {_CATEGORY} AS category FROM syn_metadata)
SELECT split, category, image_id FROM m JOIN q USING (split, category) QUALIFY row_number() OVER (PARTITION BY split, category ORDER BY ('0x' || substr(md5(concat_ws('|', '42', image_id)), 1, 15))::BIGINT, image_id) <= quota""",
    "p3_found": f"""WITH RECURSIVE k AS (SELECT image_id AS id, parent_image_id AS parent, {_canonical('trg_text')} AS t FROM syn_metadata),
e AS (SELECT id AS a, min(id) OVER (PARTITION BY t) AS b FROM k WHERE t <> '' UNION SELECT id, parent FROM k WHERE parent IN (SELECT id FROM k)),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a)
SELECT least(min(b), a) AS family_id, a AS image_id FROM reach GROUP BY a HAVING min(b) < a""",
    "p4_found": f"{_P4} SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p4_terms": f"{_P4} SELECT * FROM m",
    "p6_found": f"{_P6} SELECT kept AS kept_image_id, image_id AS copy_image_id FROM g WHERE image_id <> kept",
    "p6_collapsed": f"{_P6} SELECT image_id, copies FROM g WHERE image_id = kept UNION ALL SELECT image_id, 1 FROM k WHERE a = '' OR b = ''",
    "p7_round_trip": "SELECT source, count(*) AS documents, count(*) AS same FROM documents GROUP BY 1",
}
