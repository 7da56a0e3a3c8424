"""The functions by name in SQL text: ``register(spark)``, then ``spark.sql("SELECT vg_redact(text) FROM ...")``.

Scalar and table functions have SQL bodies, which the optimiser unfolds into the query. The one Python table function is
the alignment of lines, which has no SQL form.

A table function with an SQL body becomes a join on its argument where that is a column, and its rows carry the argument
to there. Over large tables, ``FROM (SELECT vg_distinct_tokens(text) AS t FROM ...), LATERAL explode(t)`` gives the words
within the row's own task.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from verigate.functions.text import NOT_STATEMENTS, REDACTIONS


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(c: str, *patterns: tuple[str, str]) -> str:
    for pattern, by in patterns:
        c = f"regexp_replace({c}, {_quoted(pattern)}, {_quoted(by)})"
    return c


_BLANKS = (r"(?U)\s+", " ")
_COMMENTS = [(r"(?s)/\*.*?\*/", " "), (r"//[^\n]*", " ")]
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_LINES = f"transform(split(coalesce(code, ''), {_quoted(_LINE_ENDS)}), x -> {_replaced('x', (r'(?U)^\s+|\s+$', ''))})"
_COUNTED = "x NOT IN ('', '{', '}') AND " + " AND ".join(f"NOT startswith(x, {_quoted(m)})" for m in NOT_STATEMENTS)
_HTML = _replaced("coalesce(html, '')", (r"(?s)<!--.*?-->", ""), (r"(?is)(<(script|style)\b[^>]*>).*?</\2\s*>", "$1"))
_CWE = "upper(trim(coalesce(cwe, '')))"
_P, _Z = "(k / n)", "(z * z)"
_CENTRE = f"(({_P} + {_Z} / (2.0D * n)) / (1.0D + {_Z} / n))"
_HALF = f"((z * sqrt(({_P} * (1.0D - {_P}) + {_Z} / (4.0D * n)) / n)) / (1.0D + {_Z} / n))"

#: name(parameters), what it returns, its body.
FUNCTIONS = [
    ("vg_collapse_whitespace(t STRING)", "STRING", f"trim({_replaced("coalesce(t, '')", _BLANKS)})"),
    ("vg_strip_comments(code STRING)", "STRING", _replaced("coalesce(code, '')", *_COMMENTS)),
    ("vg_normalize_code(code STRING)", "STRING", f"trim({_replaced("lower(vg_strip_comments(code))", _BLANKS)})"),
    ("vg_tokens(code STRING)", "ARRAY<STRING>", "regexp_extract_all(vg_normalize_code(code), '[a-z0-9_]+', 0)"),
    ("vg_distinct_tokens(code STRING)", "ARRAY<STRING>", "array_distinct(vg_tokens(code))"),
    ("vg_cased_tokens(code STRING)", "ARRAY<STRING>", f"filter(split(trim({_replaced('vg_strip_comments(code)', _BLANKS)}), ' '), w -> w <> '')"),
    ("vg_jaccard(a ARRAY<STRING>, b ARRAY<STRING>)", "DOUBLE", "CASE WHEN size(array_union(a, b)) = 0 THEN 1.0D ELSE size(array_intersect(a, b)) / greatest(size(array_union(a, b)), 1) END"),
    ("vg_redact(t STRING)", "STRING", _replaced("coalesce(t, '')", *REDACTIONS)),
    ("vg_norm_cwe(cwe STRING)", "STRING", f"CASE WHEN startswith({_CWE}, 'CWE-') THEN {_CWE} WHEN startswith({_CWE}, 'CWE') THEN concat('CWE-', regexp_replace(substring({_CWE}, 4), '^[-_]+', '')) WHEN {_CWE} RLIKE '^[0-9]+$' THEN concat('CWE-', {_CWE}) ELSE {_CWE} END"),
    ("vg_repo_key(url STRING)", "STRING", "replace(element_at(split(regexp_replace(lower(trim(coalesce(url, ''))), '/+$', ''), '/'), -1), '.git', '')"),
    ("vg_count_statements(code STRING)", "INT", f"size(filter({_LINES}, x -> {_COUNTED}))"),
    ("vg_count_exits(code STRING)", "INT", f"size(filter({_LINES}, x -> {_COUNTED} AND (contains(x, 'return') OR contains(x, 'throw'))))"),
    ("vg_count_elements(html STRING)", "INT", f"size(regexp_extract_all({_HTML}, '<[a-zA-Z][^>]*>', 0))"),
    ("vg_wilson(k DOUBLE, n DOUBLE, z DOUBLE DEFAULT 1.96)", "STRUCT<ci_low DOUBLE, ci_high DOUBLE>", f"CASE WHEN n > 0 THEN named_struct('ci_low', greatest(0.0D, {_CENTRE} - {_HALF}), 'ci_high', least(1.0D, {_CENTRE} + {_HALF})) ELSE named_struct('ci_low', 0.0D, 'ci_high', 0.0D) END"),
    ("vg_code_words(code STRING)", "TABLE(pos INT, word STRING)", "SELECT p, w FROM (SELECT vg_tokens(code) AS t) LATERAL VIEW posexplode(t) x AS p, w"),
    ("vg_rule_counts(html STRING)", "TABLE(rule STRING, n INT)", """SELECT rule, n FROM (SELECT explode(map('image-alt', size(regexp_extract_all(coalesce(html, ''), '(?i)<img\\\\b', 0)) - size(regexp_extract_all(coalesce(html, ''), '(?i)<img\\\\b[^>]*\\\\balt=', 0)),
'html-has-lang', CASE WHEN coalesce(html, '') RLIKE '(?i)<html\\\\b[^>]*\\\\blang=' THEN 0 ELSE 1 END, 'document-title', CASE WHEN coalesce(html, '') RLIKE '(?i)<title>[^<]*\\\\S[^<]*</title>' THEN 0 ELSE 1 END,
'link-name', size(regexp_extract_all(coalesce(html, ''), '(?i)<a\\\\b[^>]*>\\\\s*</a>', 0)))) AS (rule, n)) WHERE n > 0"""),
]


@udtf(returnType="place int, mark string, line string")
class DiffLines:
    """The lines that two texts don't share, in order: place in the alignment, ``+`` or ``-``, and the line."""

    def eval(self, before: str, after: str) -> Iterator[tuple[int, str, str]]:
        a, b = (before or "").splitlines(), (after or "").splitlines()
        place = 0
        for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if kind != "equal":
                for mark, lines in (("-", a[i:j]), ("+", b[k:m])):
                    for line in lines:
                        yield place, mark, line
                        place += 1


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session, as temporary ones."""
    for head, returns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")
    spark.udtf.register("vg_diff_lines", DiffLines)
