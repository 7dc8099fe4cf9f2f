"""The SQL that queries of this subpackage are compared with (DuckDB)."""

from __future__ import annotations

from terralace.llm.canonical import ALLOWED, plain_sql

_P3 = """
WITH pr AS (SELECT id, any_value(session_id) AS s, any_value(current_capture_time) AS c, any_value(past_capture_time) AS p FROM pairing_records GROUP BY id),
im AS (SELECT id, any_value(session_id) AS s, any_value(capture_time) AS t FROM image_records GROUP BY id),
x AS (SELECT id, 'current' AS side, s, c AS t FROM pr WHERE c IS NOT NULL UNION ALL SELECT id, 'past', s, p FROM pr WHERE p IS NOT NULL),
j AS (SELECT x.id AS pairing_id, x.side, im.id AS image_id, im.t AS it, abs(epoch_us(x.t) - epoch_us(im.t)) AS gap_us FROM x JOIN im ON im.s = x.s
  AND abs(epoch_us(x.t) - epoch_us(im.t)) <= 120000000),
r AS (SELECT *, row_number() OVER (PARTITION BY pairing_id, side ORDER BY gap_us, it, image_id) AS k FROM j)
"""
_P4 = """
WITH s AS (SELECT DISTINCT session_id FROM pairing_records WHERE session_id IS NOT NULL), n AS (SELECT count(*) AS n FROM s),
o AS (SELECT DISTINCT session_id, object_class AS c FROM detection_records WHERE object_class IN (SELECT label FROM class_labels)
  AND session_id IN (SELECT session_id FROM s)),
f AS (SELECT c, count(*) AS k FROM o GROUP BY c),
p AS (SELECT a.c AS class_a, b.c AS class_b, count(*) AS n_ab FROM o a JOIN o b ON a.session_id = b.session_id AND a.c < b.c GROUP BY ALL)
SELECT class_a, class_b FROM p JOIN f fa ON fa.c = class_a JOIN f fb ON fb.c = class_b, n
WHERE n_ab >= 3 AND 200 * n_ab >= n AND n_ab * n >= 3 * fa.k * fb.k
"""
_P7 = f"""
WITH rows AS (SELECT 'detection_records' AS rec_table, id AS rec_id, any_value(object_class) AS value FROM detection_records GROUP BY id
  UNION ALL SELECT 'detection_in', CAST(edit_id AS VARCHAR), any_value(object_class) FROM detection_in GROUP BY edit_id),
v AS (SELECT DISTINCT value FROM rows WHERE value IS NOT NULL AND value NOT IN (SELECT label FROM class_labels)),
p AS (SELECT value, {plain_sql("value", "duckdb")} AS plain FROM v),
f AS (SELECT value, trim(CASE WHEN instr(plain, ',') > 0 THEN substr(plain, 1, instr(plain, ',') - 1) ELSE plain END) AS form FROM p
  UNION ALL SELECT value, trim(trim(substr(plain, instr(plain, ',') + 1)) || ' ' || substr(plain, 1, instr(plain, ',') - 1)) FROM p WHERE instr(plain, ',') > 0),
l AS (SELECT label_id, lower(trim(label)) AS name FROM class_labels),
c AS (SELECT value, label_id, levenshtein(form, name) AS errors FROM f, l WHERE form <> '' AND levenshtein(form, name) <= {ALLOWED.format("length(name)")}
  UNION ALL SELECT value, label_id, 100 + length(name) - length(form) FROM f, l
  WHERE len(string_split(form, ' ')) = len(string_split(name, ' '))
  AND list_bool_and([length(w) >= 3 AND starts_with(string_split(name, ' ')[i], w) FOR w, i IN string_split(form, ' ')])),
m AS (SELECT value, arg_min(label_id, errors * 100000 + label_id) AS label_id FROM c GROUP BY value)
"""
_WORDS = r"""regexp_extract_all(lower(replace(replace(regexp_replace(text, '<[^<>]*>', '', 'g'), chr(173), ''), chr(8203), '')), '[\p{L}\p{N}]+')"""
_P9 = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
iw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 14], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS s FROM i WHERE len(w) >= 15)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[s:s + 14], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS s FROM d WHERE len(w) >= 15))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)
"""

ORACLE = {
    "p9_found": _P9,
    "p3_found": _P3 + "SELECT pairing_id, side, image_id FROM r WHERE k = 1",
    "p3_nearest": _P3 + "SELECT pairing_id, side, image_id, gap_us FROM r WHERE k = 1",
    "p4_found": _P4,
    "p7_found": _P7 + "SELECT rec_table, rec_id, coalesce(label_id, -1) AS label_id FROM rows JOIN v USING (value) LEFT JOIN m USING (value)",
    "p7_unmatched": _P7
    + """, n AS (SELECT object_class AS value, count(*) AS n_rows FROM (SELECT object_class FROM detection_records UNION ALL SELECT object_class FROM detection_in) GROUP BY 1)
    SELECT value, n_rows FROM v JOIN n USING (value) LEFT JOIN m USING (value) WHERE label_id IS NULL""",
}
