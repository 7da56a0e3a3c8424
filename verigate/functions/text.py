"""Text functions: normal forms, redaction, identifiers, code and HTML structure. All are column expressions.

White space and word bounds follow Unicode (``(?U)``).
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(c: Column | str) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def _sub(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def collapse_whitespace(c: Column | str) -> Column:
    """Runs of white space to one space, none at the ends; comments and case stay."""
    return F.trim(_sub(_text(c), r"(?U)\s+", " "))


def strip_comments(c: Column | str) -> Column:
    """Block comments, then line comments, to a space each."""
    return _sub(_sub(_text(c), r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")


def normalize_code(c: Column | str, lower: bool = True) -> Column:
    """The form that dedup keys are made of: no comments, single spaces, lower case."""
    t = strip_comments(c)
    return collapse_whitespace(F.lower(t) if lower else t)


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(normalize_code(c), F.lit(r"[a-z0-9_]+"), F.lit(0))


def whitespace_tokens(c: Column | str) -> Column:
    t = normalize_code(c, lower=False)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Likeness of two token arrays as sets; two empty ones are alike, an empty one is like no other."""
    a, b = _c(a), _c(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


# The redaction patterns and their placeholders, in the order in which they apply.
REDACTIONS = [
    (r"(?iU)(?://|/\*|#)\s*(?:FIX(?:ME|ED)?|VULN(?:ERABILITY|ERABLE)?|PATCH(?:ED)?|SECURITY|EXPLOIT|SINK)\b[^\n*]*", ""),
    (r"(?iU)\bCVE-\d{4}-\d{4,}\b", "<CVE>"),
    (r"(?iU)\bCWE[-_]?\d+\b", "<CWE>"),
    (r"(?iU)\b(?:VUL4J|VJBENCH|VJBench)[-_]?\d+\b", "<BUGID>"),
    (r"(?U)\b[A-Za-z]:\\(?:[^\s\\]+\\)*[^\s\\]+\.(?:java|kt|xml|properties|json)\b", "<PATH>"),
    (r"(?U)\b(?:[A-Za-z0-9_.\-]+/){1,}[A-Za-z0-9_.\-]+\.(?:java|kt|xml|properties|json)\b", "<PATH>"),
    (r"(?iU)\b[0-9a-f]{7,40}\b", "<HASH>"),
]


def redact(c: Column | str) -> Column:
    """Removes what would give an answer away: ids, paths, hashes, markers."""
    t = _text(c)
    for pattern, by in REDACTIONS:
        t = _sub(t, pattern, by)
    return t


def norm_cwe(c: Column | str) -> Column:
    """CWE-n from CWE-n, CWEn, CWE_n or n; other values in upper case; empty for none."""
    s = F.upper(F.trim(_text(c)))
    rest = _sub(F.substring(s, 4, 1 << 20), r"^[-_]+", "")
    return F.when(s.startswith("CWE-"), s).when(s.startswith("CWE"), F.concat(F.lit("CWE-"), rest)).when(s.rlike(r"^\d+$"), F.concat(F.lit("CWE-"), s)).otherwise(s)


def repo_key(c: Column | str) -> Column:
    """The last path segment of a repository address, lower-cased, without .git."""
    return F.replace(F.element_at(F.split(_sub(F.lower(F.trim(_text(c))), r"/+$", ""), "/"), -1), F.lit(".git"), F.lit(""))


def fenced(c: Column | str, languages: str = "java|jsp") -> Column:
    """The first fenced block of one of the languages (or of none), without the newlines around it; the trimmed text
    where there is none. The fence's first line holds nothing else."""
    pattern = rf"(?is)```[ \t]*(?:{languages})?[ \t]*\r?\n(.*?)```"
    t = _text(c)
    return F.when(t.rlike(pattern), F.btrim(F.regexp_extract(t, pattern, 1), F.lit("\n"))).otherwise(_strip(t))


def _strip(c: Column) -> Column:
    return _sub(c, r"(?U)^\s+|\s+$", "")


def fenced_anyhow(c: Column | str, language: str = "java") -> Column:
    """The first fenced block, also one that begins on the fence's line, trimmed; the trimmed text where there is none."""
    pattern = rf"(?isU)```(?:{language})?\s*(.*?)```"
    t = _text(c)
    return F.when(t.rlike(pattern), _strip(F.regexp_extract(t, pattern, 1))).otherwise(_strip(t))


def relative_path(path: Column | str, root: Column | str) -> Column:
    """An absolute path below a root, from there; any other path as it is."""
    p, r = _c(path), F.concat(F.rtrim(_c(root), F.lit("/")), F.lit("/"))
    return F.when(p.startswith(r) & (r != "/"), F.substring(p, F.length(r) + 1, F.length(p))).otherwise(p)


def skeleton(code: Column | str) -> Column:
    """A class of the same package and name without the code's body: what a deleting patch would leave."""
    t = _text(code)
    package, name = F.regexp_extract(t, r"(?m)^\s*package\s+([\w.]+)\s*;", 1), F.regexp_extract(t, r"\b(?:class|interface|enum)\s+(\w+)", 1)
    head = F.when(package != "", F.concat(F.lit("package "), package, F.lit(";\n\n"))).otherwise("")
    return F.concat(head, F.lit("public class "), F.coalesce(F.nullif(name, F.lit("")), F.lit("Emptied")), F.lit(" {\n}\n"))


# What mustn't be published, by path.
FORBIDDEN = r"(?i)(^|/)(\.env$|secrets/|.*\.token$|.*\.key$|.*\.pptx?$|handbook|problem-statement|photos/)"


def forbidden_path(path: Column | str, pattern: str = FORBIDDEN) -> Column:
    return _text(path).rlike(pattern)


def first_nonempty(*columns: Column | str) -> Column:
    """The first alias that holds anything; empty where none does."""
    return F.coalesce(*[F.nullif(_c(c).cast("string"), F.lit("")) for c in columns], F.lit(""))


def listed(c: Column | str) -> Column:
    """A comma-separated string as an array of its trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(_text(c), ","), lambda x: F.trim(x)), lambda x: x != "")


# What starts a line that isn't a statement.
NOT_STATEMENTS = ["//", "*", "/*", "*/", "@"]


def statement_lines(c: Column | str) -> Column:
    """The trimmed lines of code that count as statements."""
    lines = F.transform(F.split(_text(c), r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: _sub(x, r"(?U)^\s+|\s+$", ""))

    def counts(s: Column) -> Column:
        ok = ~s.isin("", "{", "}")
        for mark in NOT_STATEMENTS:
            ok &= ~s.startswith(mark)
        return ok

    return F.filter(lines, counts)


def count_statements(c: Column | str) -> Column:
    return F.size(statement_lines(c))


def count_returns(c: Column | str) -> Column:
    return F.size(F.filter(statement_lines(c), lambda s: s.contains("return") | s.contains("throw")))


def retained(new: Column | str, old: Column | str) -> Column:
    """The ratio of two counts; 1 where there was nothing to keep."""
    return F.when(_c(old) > 0, _c(new) / F.greatest(_c(old), F.lit(1))).otherwise(F.lit(1.0))


def count_elements(c: Column | str) -> Column:
    """Start tags of an HTML text, outside comments, scripts and styles."""
    t = _sub(_text(c), r"(?s)<!--.*?-->", "")
    t = _sub(t, r"(?is)(<(script|style)\b[^>]*>).*?</\2\s*>", "$1")
    return F.size(F.regexp_extract_all(t, F.lit(r"<[a-zA-Z][^>]*>"), F.lit(0)))


def unified_diff(old: Column | str, new: Column | str, context: int = 3) -> Column:
    """A unified diff. Needs an alignment of lines, so this is a vectorised Python function."""
    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "before", "after", lineterm="", n=context)) for x, y in zip(a, b, strict=True)])

    return diff(_c(old), _c(new))


def changed_lines(old: Column | str, new: Column | str) -> Column:
    """Lines added and removed, by the same alignment."""
    @F.pandas_udf("long")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sum(line[:2] in ("+ ", "- ") for line in difflib.ndiff((x or "").splitlines(), (y or "").splitlines())) for x, y in zip(a, b, strict=True)])

    return count(_c(old), _c(new))


def pair_key(a: Column | str, b: Column | str) -> Column:
    """SHA-256 of two collapsed texts with a NUL between."""
    return F.sha2(F.concat(collapse_whitespace(a), F.lit("\0"), collapse_whitespace(b)), 256)


def code_key(a: Column | str, b: Column | str) -> Column:
    """SHA-1 of two normalised codes with a NUL between."""
    return F.sha1(F.concat(normalize_code(a), F.lit("\0"), normalize_code(b)))

