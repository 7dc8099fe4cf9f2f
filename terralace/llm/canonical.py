"""Mapping free-entered values to a canonical list, in SQL only.

A label of length L may be written with k(L) errors. It is cut into k + 1 segments; however the errors fall, one segment
stays whole, and its place moves by at most k. So segments with their possible places are joined by equality with the
substrings of the values, candidates are verified by levenshtein, and an anti-join reports what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Cyrillic letters and the Latin letters they are mistaken for; other blanks and soft hyphens.
LOOKALIKES = ("асеорхіукмтвн   \t\r\n_.", "aceopxiykmtbh        ")
# Words before or after a name that don't belong to it.
BEFORE = "a|an|the|old|new|small|large|big|possible|possibly|probable|probably|prob|maybe|likely"
# A count before or after a name.
COUNT_BEFORE, COUNT_AFTER = "[0-9]+ ?x?", "x ?[0-9]+|#? ?[0-9]+"


def _every(dialect: str, text: str, pattern: str, by: str) -> str:
    """regexp_replace of every match in Spark's SQL or DuckDB's."""
    escaped = pattern.replace("\\", "\\\\") if dialect == "spark" else pattern
    return f"regexp_replace({text}, '{escaped}', '{by}'" + (", 'g')" if dialect == "duckdb" else ")")


def plain_sql(value: str, dialect: str = "spark") -> str:
    """SQL for the plain form of a typed value: lower case Latin words without remarks, counts and qualifiers.

    The part after a comma is kept behind the comma for the caller to judge.
    """
    every = lambda text, pattern, by: _every(dialect, text, pattern, by)
    t = f"translate(lower({value}), '{LOOKALIKES[0]}', '{LOOKALIKES[1]}')"
    t = every(t, r"\[[^\]]*\]", " ")
    t = every(t, r"^ *\(([^()]*)\) *$", "$1" if dialect == "spark" else r"\1")
    t = every(t, r"\([^()]*\)", " ")
    t = every(t, r" +[-/–] +.*$", " ")
    t = every(t, r"[^a-z0-9, #]", " ")
    t = every(t, r"  +", " ")
    t = every(f"trim({t})", rf"^({COUNT_BEFORE}) ", "")
    t = every(t, rf" ({COUNT_AFTER})$", "")
    t = every(t, rf"^({BEFORE}) ", "")
    return f"trim({t})"


#: Errors that a name of a length may have.
ALLOWED = "CASE WHEN {0} <= 4 THEN 1 WHEN {0} <= 7 THEN 2 WHEN {0} <= 9 THEN 3 ELSE 4 END"

_FORMS = """
SELECT value, trim(form) AS form FROM (
  SELECT value, explode(array(
    CASE WHEN instr(plain, ',') > 0 THEN substring(plain, 1, instr(plain, ',') - 1) ELSE plain END,
    CASE WHEN instr(plain, ',') > 0 THEN concat(trim(substring(plain, instr(plain, ',') + 1)), ' ', substring(plain, 1, instr(plain, ',') - 1)) END
  )) AS form FROM {plain})
WHERE trim(form) <> ''
"""

_SEGMENTS = f"""
WITH l AS (SELECT label_id, lower(trim(label)) AS name, length(lower(trim(label))) AS len FROM {{labels}} WHERE trim(label) <> ''),
k AS (SELECT *, {ALLOWED.format("len")} AS k FROM l),
s AS (SELECT *, explode(sequence(0, k)) AS no FROM k),
c AS (SELECT label_id, name, len, k, CAST(floor(no * len / (k + 1)) AS INT) AS at, CAST(floor((no + 1) * len / (k + 1)) AS INT) AS upto FROM s)
SELECT label_id, name, len, k, substring(name, at + 1, upto - at) AS seg, explode(sequence(at + 1 - k, at + 1 + k)) AS place FROM c WHERE upto > at
"""

_SUBSTRINGS = """
SELECT form, substring(form, place, size) AS seg, place FROM (
  SELECT form, place, explode(sequence(1, least({longest}, length(form) - place + 1))) AS size FROM (
    SELECT form, explode(sequence(1, length(form))) AS place FROM (SELECT DISTINCT form FROM {forms} WHERE length(form) <= {long})))
"""

_VERIFIED = """
SELECT DISTINCT form, label_id, name, levenshtein(form, name) AS errors FROM (
  SELECT v.form, s.label_id, s.name, s.k FROM {substrings} v JOIN {segments} s
  ON v.seg = s.seg AND v.place = s.place AND abs(length(v.form) - s.len) <= s.k)
WHERE levenshtein(form, name) <= k
"""

# words cut short: as many words as the name, each the beginning of the name's word, found by the first three letters
_SHORTENED = """
SELECT f.form, l.label_id, l.name, 100 + length(l.name) - length(f.form) AS errors
FROM (SELECT DISTINCT form, split(form, ' ') AS words FROM {forms} WHERE length(form) <= {long}) f
JOIN (SELECT label_id, lower(trim(label)) AS name, split(lower(trim(label)), ' ') AS words FROM {labels} WHERE trim(label) <> '') l
ON left(f.form, 3) = left(l.name, 3) AND size(f.words) = size(l.words)
WHERE forall(zip_with(f.words, l.words, (a, b) -> length(a) >= 3 AND startswith(b, a)), x -> x)
"""

_BEST = """
SELECT value, min_by(label_id, struct(errors, label_id)) AS label_id FROM (
  SELECT f.value, v.label_id, v.errors FROM {forms} f JOIN {candidates} v ON f.form = v.form)
GROUP BY value
"""

_ALL = """
SELECT value, label_id FROM {best}
UNION ALL SELECT value, -1 FROM {plain} p LEFT ANTI JOIN {best} b USING (value)
"""


def map_values(values: DataFrame, labels: DataFrame) -> DataFrame:
    """Map each distinct value to the label it writes differently: value, label_id (-1 if it names none of them).

    ``values``: value; ``labels``: label_id, label. Null values take no part; an empty or very long value names none.
    Of several labels within the allowed errors, the one with the fewest errors wins, then the smaller id; words cut
    short come last. A label may be repeated. With no labels every value gets -1.
    """
    spark = values.sparkSession
    run = spark.sql
    plain = run(f"SELECT value, {plain_sql('value')} AS plain FROM (SELECT DISTINCT value FROM {{values}} WHERE value IS NOT NULL)", values=values)
    segments = run(_SEGMENTS, labels=labels)
    # the list of labels is the small side; its longest name and segment bound the substrings worth making
    bounds = segments.selectExpr("coalesce(max(length(seg)), 1) AS longest", "coalesce(max(len + k), 0) AS long").first()
    forms = run(_FORMS, plain=plain)
    substrings = run(_SUBSTRINGS.replace("{longest}", str(bounds["longest"])).replace("{long}", str(bounds["long"])), forms=forms)
    verified = run(_VERIFIED, substrings=substrings, segments=segments)
    shortened = run(_SHORTENED.replace("{long}", str(bounds["long"])), forms=forms, labels=labels)
    best = run(_BEST, forms=forms, candidates=verified.unionByName(shortened))
    return run(_ALL, best=best, plain=plain)
