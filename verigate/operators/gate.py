"""Findings, test outcomes, non-deletion guards and the gate that puts them together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigate.functions.java import java_counts
from verigate.functions.text import count_elements, retained, statement_lines
from verigate.operators.metrics import FLAGS, cleared, tool_clean

MIN_RETAINED = 0.6

#: Fixed value: what the next attempt is told where no layer failed.
NO_FAILURES = "The previous patch did not pass the verification gate."


@dataclass(frozen=True)
class GateOptions:
    """Thresholds and which layers have to be there."""

    min_retained: float = MIN_RETAINED
    require_baseline: bool = True
    semgrep_required: bool = True
    codeql_required: bool = False
    guard: str = "parsed"  # or "lines"


def _base(path: Column) -> Column:
    flat = F.ltrim(F.replace(F.replace(F.coalesce(path, F.lit("")), F.lit("file://"), F.lit("")), F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.element_at(F.split(flat, "/"), -1)


def same_file(a: Column, b: Column) -> Column:
    """Paths name the same file if their last segments agree; an empty path names none."""
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (_base(a) == _base(b))


def suffix_pairs(left: DataFrame, right: DataFrame, by: str, text: str, other: str) -> DataFrame:
    """Distinct (by, text, other) where, for equal ``by``, one of the two texts ends with the other; blank ones never do.

    Texts are turned round, so suffixes are prefixes: each text gives its prefixes of the lengths that the other side
    has with the same ``by``, and equal ones meet in a hash join. No side's texts are gathered anywhere.
    """
    a = left.select(F.col(by).alias("by"), F.reverse(text).alias("a")).where("a <> ''").distinct()
    b = right.select(F.col(by).alias("by"), F.reverse(other).alias("b")).where("b <> ''").distinct()

    def cut(longer: DataFrame, c: str, shorter: DataFrame, d: str) -> DataFrame:
        lengths = shorter.select("by", F.length(d).alias("n")).distinct()
        parts = longer.join(lengths, "by").where(F.length(c) >= F.col("n")).select("by", c, F.expr(f"substring({c}, 1, n)").alias(d))
        return parts.join(shorter, ["by", d]).select("by", "a", "b")

    pairs = cut(a, "a", b, "b").union(cut(b, "b", a, "a")).distinct()
    return pairs.select(F.col("by").alias(by), F.reverse("a").alias(text), F.reverse("b").alias(other))


def in_scope(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings whose rule id is one of the weakness's rules, or is a suffix of one or the other way round.

    ``findings`` has check_id and cwe, ``rules`` has cwe and rule. An empty or unmapped weakness has no scope: all its
    findings stay. An empty check_id never matches.
    """
    keyed = findings.withColumn("_cwe", F.upper("cwe"))
    own = rules.where("rule <> ''").select(F.upper("cwe").alias("_cwe"), "rule")
    hits = suffix_pairs(keyed.select("_cwe", "check_id"), own, "_cwe", "check_id", "rule").select("_cwe", "check_id").distinct()
    mapped = own.select("_cwe").distinct()
    hit = keyed.join(hits, ["_cwe", "check_id"], "left_semi")
    free = keyed.join(mapped, "_cwe", "left_anti")
    return hit.select(*findings.columns).unionByName(free.select(*findings.columns))


def on_file(findings: DataFrame, patches: DataFrame, key: str, path: str = "path", target: str = "patched_file") -> DataFrame:
    """The findings on the file that their patch changes."""
    own = patches.select(F.col(key).alias("_patch"), F.col(target).alias("_target"))
    return findings.join(own, findings[key] == own["_patch"]).where(same_file(F.col(path), F.col("_target"))).drop("_patch", "_target")


def sast_gate(patches: DataFrame, findings: DataFrame, key: str, required: tuple[bool, bool] = (True, False)) -> DataFrame:
    """semgrep_clean and codeql_clean for each patch (columns semgrep_error and codeql_error say that a tool failed).

    ``findings`` are those in scope and on the file: see ``in_scope`` and ``on_file``.
    """
    n = findings.groupBy(key).agg(F.count_if(F.col("tool") == "semgrep").alias("_s"), F.count_if(F.col("tool") == "codeql").alias("_c"))
    both = patches.join(n, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.withColumns({"semgrep_clean": tool_clean(zero(F.col("_s")), F.col("semgrep_error"), required[0]), "codeql_clean": tool_clean(zero(F.col("_c")), F.col("codeql_error"), required[1])}).drop("_s", "_c")


def same_test(wanted: Column, found: Column) -> Column:
    """Does a found id name the wanted test? Class#method (or ::), Class.method, the two without a separator, or the
    class alone, which stands for each of its methods."""
    ids = [F.replace(F.trim(c), F.lit("::"), F.lit("#")) for c in (wanted, found)]
    (w, w_class, w_method), (f, f_class, f_method) = ((i, F.substring_index(i, "#", 1), F.when(i.contains("#"), F.regexp_replace(i, r"^[^#]*#", "")).otherwise("")) for i in ids)
    dotted = (f_method == "") & (w_method != "") & (f == F.concat(w_class, F.lit("."), w_method))
    joined = ((f_method == "") & (w_method != "") & (f_class == F.concat(w_class, w_method))) | ((w_method == "") & (f_method != "") & (w_class == F.concat(f_class, f_method)))
    plain = (f_class == w_class) & ((w_method == "") | (f_method == w_method))
    return (w == f) | dotted | joined | plain


def _test_keys(c: Column, wanted: bool) -> Column:
    """The keys of a test id: a wanted and a found id name the same test if, and only if, they have one in common."""
    i = F.replace(F.trim(c), F.lit("::"), F.lit("#"))
    of, method = F.substring_index(i, "#", 1), F.when(i.contains("#"), F.regexp_replace(i, r"^[^#]*#", "")).otherwise("")
    some, key = method != "", lambda kind, *parts: F.concat(F.lit(kind), *parts)
    if wanted:
        keys = [key("=", i), F.when(some, key(".", of, F.lit("."), method)), F.when(some, key("j", of, method)), F.when(~some, key("+", of)), F.when(~some, key("c", of)), F.when(some, key("m", of, F.lit("#"), method))]
    else:
        keys = [key("=", i), F.when(~some, key(".", i)), F.when(~some, key("j", of)), F.when(some, key("+", of, method)), key("c", of), F.when(some, key("m", of, F.lit("#"), method))]
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull()))


def named_pairs(wanted: DataFrame, found: DataFrame, test: str = "test") -> DataFrame:
    """Distinct (wanted, found) test ids that name the same test, by ``same_test``'s rules, as an equi-join of keys.

    Each distinct id is in a handful of blocks, a class's or a method's own, so ids of other classes never meet. A
    wanted class stands for each of its found methods: those pairs are the result itself.
    """
    w = wanted.select(F.col(test).alias("wanted")).distinct().select("wanted", F.explode(_test_keys(F.col("wanted"), True)).alias("_key"))
    f = found.select(F.col(test).alias("found")).distinct().select("found", F.explode(_test_keys(F.col("found"), False)).alias("_key"))
    # ids that have several keys in common are a pair by the first of these, so the pairs needn't be dealt out again
    once = F.get(F.array_intersect(_test_keys(F.col("wanted"), True), _test_keys(F.col("found"), False)), F.lit(0)) == F.col("_key")
    return w.join(f, "_key").where(once).select("wanted", "found")


def failing_ids(failures: Column) -> Column:
    """Test ids of failure records: Class#method, or the class where no method is named."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(failures, lambda f: F.when(blank(f["test_method"]) != "", F.concat(blank(f["test_class"]), F.lit("#"), f["test_method"])).otherwise(blank(f["test_class"])))


def named(wanted: Column, found: Column) -> tuple[Column, Column]:
    """The wanted ids that are among the found ones, and those that aren't."""
    hit = lambda w: F.exists(found, lambda f: same_test(w, f))
    return F.filter(wanted, hit), F.filter(wanted, lambda w: ~hit(w))


def regressions(wanted: Column, before: Column, after: Column) -> Column:
    """Ids that fail after the patch, aren't wanted ones and didn't fail before."""
    return F.filter(after, lambda f: ~F.exists(wanted, lambda w: same_test(w, f)) & ~F.exists(before, lambda b: same_test(b, f)))


def tests_pass(failing: Column, error: Column, passing: Column, required: Column) -> Column:
    """Nothing fails or errs, and every required id is among the passing ones."""
    return (failing == 0) & (error == 0) & F.forall(required, lambda r: F.exists(passing, lambda p: same_test(r, p)))


def code_guard(before: Column | str, after: Column | str, least: float = MIN_RETAINED) -> Column:
    """struct(ok, ratio, returns_kept, counts): enough statements stay, and no fewer ways out."""

    def counts(c: Column | str) -> Column:
        return F.transform(F.array(statement_lines(c)), lambda s: F.struct(F.size(s).alias("n"), F.size(F.filter(s, lambda x: x.contains("return") | x.contains("throw"))).alias("r")))[0]

    def judged(x: Column) -> Column:
        old, new = x["old"], x["new"]
        ratio, kept = retained(new["n"], old["n"]), new["r"] >= old["r"]
        return F.struct(((ratio >= least) & kept).alias("ok"), ratio.alias("ratio"), kept.alias("returns_kept"), old["n"].alias("orig_statements"), new["n"].alias("new_statements"), old["r"].alias("orig_returns"), new["r"].alias("new_returns"))

    return F.transform(F.array(F.struct(counts(before).alias("old"), counts(after).alias("new"))), judged)[0]  # counts are taken once


def parsed_guard(before: Column | str, after: Column | str, least: float = MIN_RETAINED) -> Column:
    """struct(ok, ratio, returns_kept, method) by parsed statements: code that can't be parsed is rejected as a
    patch, and as an original leaves the judgement of both to lines."""
    both = F.array(F.struct(java_counts(before).alias("old"), java_counts(after).alias("new"), code_guard(before, after, least).alias("lines")))

    def judged(x: Column) -> Column:
        ratio, kept = retained(x["new"]["statements"], x["old"]["statements"]), x["new"]["exits"] >= x["old"]["exits"]
        parsed = F.struct(((ratio >= least) & kept).alias("ok"), ratio.alias("ratio"), kept.alias("returns_kept"), F.lit("parsed").alias("method"))
        rejected = F.struct(F.lit(False).alias("ok"), F.lit(0.0).alias("ratio"), F.lit(False).alias("returns_kept"), F.lit("parsed").alias("method"))
        by_line = F.struct(x["lines"]["ok"].alias("ok"), x["lines"]["ratio"].alias("ratio"), x["lines"]["returns_kept"].alias("returns_kept"), F.lit("lines").alias("method"))
        return F.when(x["new"].isNull(), rejected).when(x["old"].isNull(), by_line).otherwise(parsed)

    return F.transform(both, judged)[0]


#: How the gate judges what a patch leaves of the code: by parsed statements, with lines where the original can't be
#: parsed; or by lines alone.
GUARDS = {"parsed": parsed_guard, "lines": code_guard}


def dom_guard(before: Column | str, after: Column | str, least: float = MIN_RETAINED) -> Column:
    """struct(ok, ratio): enough elements stay."""
    both = F.array(F.struct(count_elements(before).alias("old"), count_elements(after).alias("new")))
    ratio = F.transform(both, lambda x: retained(x["new"], x["old"]))
    return F.transform(ratio, lambda r: F.struct((r >= least).alias("ok"), r.alias("ratio")))[0]


def run_gate(df: DataFrame, options: GateOptions = GateOptions()) -> DataFrame:
    """Six flags, the layers (name, passed, detail) and the verdict for each patch.

    Takes compiles, pov_tests, the failures before and after with the tests that pass after (failures_before,
    failures_after, passing_after), semgrep_clean, codeql_clean, code_before, code_after. A wanted test has flipped if
    it failed before and is among those that pass now; without wanted tests any failure before and none after count.
    If the baseline doesn't fail as it should, the whole verdict is false.
    """
    before, after = failing_ids(F.col("failures_before")), failing_ids(F.col("failures_after"))
    some = F.size("pov_tests") > 0
    failed_first = F.when(some, F.size(named(F.col("pov_tests"), before)[1]) == 0).otherwise(F.size("failures_before") > 0)
    fixed = F.when(some, F.size(named(F.col("pov_tests"), F.col("passing_after"))[1]) == 0).otherwise(F.size("failures_after") == 0)
    out = df.withColumns({
        "baseline_failed": failed_first,
        "regression_pass": F.col("compiles") & (F.size(regressions(F.col("pov_tests"), before, after)) == 0),
        "_guard": GUARDS[options.guard]("code_before", "code_after", options.min_retained),
    })
    out = out.withColumns({"pov_flipped": F.col("compiles") & F.col("baseline_failed") & fixed, "not_deleted": F.col("_guard.ok")}).drop("_guard")
    usable = F.col("baseline_failed") if options.require_baseline else F.lit(True)
    out = out.withColumns({f: usable & F.coalesce(F.col(f), F.lit(False)) for f in FLAGS})
    reason = F.when(usable, "").otherwise("baseline doesn't fail as expected: unusable")
    layers = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("passed"), F.when(F.col(f), "").otherwise(reason).alias("detail")) for f in FLAGS])
    return out.withColumns({"layers": layers, "cleared": cleared()})


def accessibility(html: Column | str) -> Column:
    """map<rule, count> of an own subset of accessibility rules over raw HTML."""
    t = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    n = lambda p: F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0)))
    return F.create_map(
        F.lit("image-alt"), n(r"(?i)<img\b") - n(r"(?i)<img\b[^>]*\balt="),
        F.lit("html-has-lang"), F.when(t.rlike(r"(?i)<html\b[^>]*\blang="), 0).otherwise(1),
        F.lit("document-title"), F.when(t.rlike(r"(?i)<title>[^<]*\S[^<]*</title>"), 0).otherwise(1),
        F.lit("link-name"), n(r"(?i)<a\b[^>]*>\s*</a>"),
        F.lit("button-name"), n(r"(?i)<button\b[^>]*>\s*</button>"),
        F.lit("label"), n(r"(?i)<input\b") - n(r"(?i)<input\b[^>]*\baria-label="),
    )


def a11y_gate(base: Column, after: Column, before_html: Column, after_html: Column, targets: list[str] | None = None, least: float = MIN_RETAINED) -> Column:
    """struct(had_violations, violations_after, flipped, not_deleted, cleared, still_failing) of two rule maps.

    Every rule that failed before (or of ``targets``) has to pass now, and there has to be something to mend.
    """
    only = (lambda m: F.map_filter(m, lambda k, v: (v > 0) & k.isin(targets))) if targets else (lambda m: F.map_filter(m, lambda _, v: v > 0))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda s, v: s + v)

    def judged(x: Column) -> Column:
        wanted = F.array(*[F.lit(t) for t in targets]) if targets else F.map_keys(x["b"])
        still = F.array_sort(F.filter(wanted, lambda k: F.coalesce(F.try_element_at(x["a"], k), F.lit(0)) > 0))
        had, kept = total(x["b"]) > 0, x["kept"]
        flipped = had & (F.size(still) == 0)
        return F.struct(had.alias("had_violations"), total(x["a"]).alias("violations_after"), flipped.alias("flipped"), kept.alias("not_deleted"), (flipped & kept).alias("cleared"), still.alias("still_failing"))

    return F.transform(F.array(F.struct(only(base).alias("b"), only(after).alias("a"), dom_guard(before_html, after_html, least)["ok"].alias("kept"))), judged)[0]


def rule_summary(by_rule: Column) -> Column:
    """"rule (xN), ..." by rule name, or a fixed text for none."""
    entries = F.transform(F.array_sort(F.map_entries(by_rule)), lambda e: F.concat(e["key"], F.lit(" (x"), e["value"].cast("string"), F.lit(")")))
    return F.when(F.size(entries) > 0, F.array_join(entries, ", ")).otherwise("none reported")


def rule_changes(before: Column, after: Column) -> Column:
    """map<rule, (before, after)> over the rules of either, 0 where missing."""
    return F.map_zip_with(before, after, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("before"), F.coalesce(y, F.lit(0)).alias("after")))


def failing_lines(layers: Column) -> Column:
    """The failing layers, a line each (array of struct name, passed, detail)."""
    lines = F.transform(F.filter(layers, lambda x: ~x["passed"]), lambda x: F.concat(F.lit("- "), x["name"], F.lit(": "), F.coalesce(x["detail"], F.lit(""))))
    return F.array_join(lines, "\n")


def feedback(layers: Column, head: str = "") -> Column:
    """The failing layers as text for the next attempt, below ``head``; a fixed sentence where none failed."""
    text = failing_lines(layers)
    return F.when(text == "", NO_FAILURES).otherwise(F.concat(F.lit(head), text))

