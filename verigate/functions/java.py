"""Java code's statements as column expressions: a push-down automaton over tokens, folded over each row.

The automaton keeps a stack of open brackets, each with its kind (class body, code, lambda, array values, condition,
arguments) and with what the statement around it was, so lambdas, anonymous classes and array values stand inside of
statements, and fields of a class aren't statements. Code that doesn't fit (brackets, a statement or a declaration that
doesn't end, text outside of a type) has no result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The statements that a keyword begins, by their kind.
KEYWORD_KINDS = {"if": "I", "for": "F", "while": "W", "do": "D", "switch": "S", "try": "T", "synchronized": "Y", "assert": "A", "break": "B", "continue": "C", "return": "R", "throw": "H"}
#: What else has a part of its own; all other words are ``w``, all other signs ``o``.
_PARTS = KEYWORD_KINDS | {"else": "E", "finally": "E", "catch": "X", "case": "c", "default": "c", "class": "K", "interface": "K", "enum": "K", "new": "N", "import": "i", "package": "i", "->": "l", ".": "d", ">": "g", '"': "q", "'": "q", "`": "q", "\\": "q", "#": "q", "++": "p", "--": "p", "*": "m"} | {c: c for c in "()[]{};:=,"}
NAMES = {k: v for v, k in KEYWORD_KINDS.items()} | {"v": "local", "x": "expression"}

# possessive, for a group that can go back over its rounds would need stack for each character
_STRINGS = r"\"\"\"(?:(?!\"\"\")(?:\\.|[^\\]))*+\"\"\"|\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+'"
_COMMENTS = r"//[^\n]*|/\*.*?\*/"
_TOKENS = r"[A-Za-z_$][\w$]*|\d[\w.]*|->|\+\+|--|\S"
_STATE = "struct<stack:string,first:string,prev:string,type:boolean,made:boolean,anon:boolean,one:boolean,bad:boolean,found:array<struct<kind:string,depth:int,at:int>>>"


def _parts(code: Column) -> Column:
    """The code's tokens, each as one character for the part that it plays. A literal is a word."""
    bare = F.regexp_replace(code, F.lit(f"(?s)({_STRINGS})|{_COMMENTS}"), F.lit(" $1 "))
    bare = F.regexp_replace(bare, F.lit(f"(?s){_STRINGS}"), F.lit(" 0 "))
    known = F.create_map(*[F.lit(x) for pair in _PARTS.items() for x in pair])
    return F.transform(F.regexp_extract_all(bare, F.lit(_TOKENS), F.lit(0)), lambda t: F.coalesce(F.try_element_at(known, t), F.when(t.rlike(r"^[\w$]"), "w").otherwise("o")))


def _step(s: Column, x: Column) -> Column:
    """The state after one more part. ``first`` says what the statement in hand is: n(one yet), k(eyword), c(ase label),
    x (open), d(eclaration), e(xpression), i(mport); the stack has two characters a bracket, its kind and the ``first``
    around it: C(lass) and M(ethod) code, D (class) and L (lambda) within an expression, A(rray), K (a condition),
    N (arguments of new), P and B (other parentheses and brackets)."""
    c, at = x["c"], x["at"]
    stack, first, prev = s["stack"], s["first"], s["prev"]
    top = F.substring(stack, -2, 1)
    saved = F.substring(stack, -1, 1)
    code, inner = top.isin("M", "L"), top.isin("P", "N", "B", "A")
    keyword = c.isin(*KEYWORD_KINDS.values()) & code & (prev != "d")
    opens = F.when(c == "(", F.when(prev.isin("I", "F", "W", "S", "Y", "T", "X") & code, "K").when(s["made"], "N").otherwise("P")).when(c == "[", "B").when(
        c == "{", F.when(s["type"], "C").when(prev.isin("=", "]") | (prev.isin(",", "{") & (top == "A")) | ((prev == "(") & (top == "P")), "A").when(s["anon"], "D").when(prev == "l", "L").otherwise("M")
    )
    closes = F.when(c == ")", top.isin("P", "N", "K")).when(c == "]", top == "B").when(c == "}", top.isin("C", "M", "D", "L", "A"))
    label = (c == ":") & code & ((first == "c") | ((first == "x") & s["one"]))
    arrow = (c == "l") & code & (first == "c")
    declares = (first == "x") & (c == "w") & code & prev.isin("w", "g", "]")
    now = (
        F.when(opens.isin("C", "M", "D", "L"), "n")
        .when(opens.isNotNull(), F.when((opens != "K") & code & first.isin("n", "x") & (c == "("), "e").otherwise(first))
        .when(closes, F.when(top.isin("K", "C", "M"), "n").when(top.isin("A", "D", "L"), F.when(saved == "n", "e").otherwise(saved)).otherwise(first))
        .when(c == ";", F.when(top == "K", first).otherwise("n"))
        .when(label | arrow, "n")
        .when(keyword, F.when(c.isin("D", "T"), "n").otherwise("k"))
        .when(code & (c == "E"), "n")
        .when(code & (c == "X"), "k")
        .when(code & (c == "c"), "c")
        .when((c == "i") & (stack == ""), "i")
        .when(first == "n", F.when(code | (stack == "") | top.isin("C", "D"), "x").otherwise("n"))
        .when(declares, "d")
        .when((c == "=") & (first == "x") & code, "e")
        .otherwise(first)
    )
    ends = (c == ";") & code & first.isin("x", "d", "e")
    kind = F.when(keyword, c).when(ends, F.when(first == "d", "v").otherwise("x"))
    depth = F.length(F.regexp_replace(F.regexp_replace(stack, F.lit("(.)."), F.lit("$1")), F.lit("[^ML]"), F.lit("")))
    cut_off = prev.isin("=", "o", ",", "d", "l", ":") & ~top.isin("", "K")
    bad = (
        s["bad"] | (c == "q") | F.coalesce(~closes, F.lit(False))
        | ((c == ";") & (inner | ((stack == "") & ~first.isin("n", "i")) | (cut_off & (first != "n"))))
        | ((c == "{") & (stack == "") & ~s["type"])
        | ((c == "}") & code & (first != "n"))
    )
    pushed = F.when(opens.isNotNull(), F.concat(stack, opens, first)).when(closes, F.substring(stack, F.lit(1), F.length(stack) - 2)).otherwise(stack)
    return F.struct(
        pushed.alias("stack"), now.alias("first"), F.when(arrow | label, ";").otherwise(c).alias("prev"),
        ((s["type"] & ~c.isin("{", ";")) | ((c == "K") & (prev != "d") & ~inner)).alias("type"),
        ((c == "N") | (s["made"] & ~c.isin("(", ")", "[", "{", ";"))).alias("made"),
        ((c == ")") & (top == "N")).alias("anon"),
        ((now == "x") & (first == "n")).alias("one"), bad.alias("bad"),
        F.when(kind.isNotNull(), F.concat(s["found"], F.array(F.struct(kind.alias("kind"), depth.cast("int").alias("depth"), at.alias("at"))))).otherwise(s["found"]).alias("found"),
    ).cast(_STATE)


def java_statements(code: Column | str) -> Column:
    """array<struct<kind, depth, at>>: the statements in order, how many blocks of code each is in (its parent is the
    last one before it that is less deep), and its place among the tokens. Null where the code can't be parsed.

    Kinds are the keywords, ``local`` (a declaration) and ``expression``; a ``do`` and its ``while`` are two entries.
    """
    text = F.coalesce(F.col(code) if isinstance(code, str) else code, F.lit(""))
    begin = F.expr(f"cast(named_struct('stack', '', 'first', 'n', 'prev', ';', 'type', false, 'made', false, 'anon', false, 'one', false, 'bad', false, 'found', array()) as {_STATE})")
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    rows = lambda s: F.transform(s["found"], lambda f: F.struct(F.element_at(names, f["kind"]).alias("kind"), f["depth"].alias("depth"), f["at"].alias("at")))

    def folded(parts: Column) -> Column:
        # a word after two words changes nothing in the state
        placed = F.transform(parts, lambda c, i: F.struct(c.alias("c"), i.cast("int").alias("at")))
        word = lambda k: F.get(parts, k) == "w"
        steps = F.filter(placed, lambda x: ~((x["c"] == "w") & F.coalesce(word(x["at"] - 1) & word(x["at"] - 2), F.lit(False))))
        # what ends otherwise, or has a sign that is no Java, has no result; that is told without the fold
        ends = (F.size(parts) == 0) | F.coalesce(F.try_element_at(parts, F.lit(-1)).isin(";", "}", ")", "]"), F.lit(False))
        return F.when(ends & ~F.array_contains(parts, "q"), F.aggregate(steps, begin, _step, lambda s: F.when(~s["bad"] & (s["stack"] == "") & (s["first"] == "n"), rows(s))))

    return F.transform(F.array(_parts(text)), folded)[0]


def counts_of(found: Column | str) -> Column:
    """``java_counts`` of statements that are there already."""

    def counted(f: Column) -> Column:
        loops = F.size(F.filter(f, lambda x: x["kind"] == "do"))
        exits = F.size(F.filter(f, lambda x: x["kind"].isin("return", "throw")))
        return F.struct((F.size(f) - loops).alias("statements"), exits.alias("exits"))

    return F.transform(F.array(found), lambda f: F.when(f.isNotNull(), counted(f)))[0]


def java_counts(code: Column | str) -> Column:
    """struct(statements, exits): of all kinds, a loop by do and while being one, and of return and throw. Null where
    the code can't be parsed."""
    return counts_of(java_statements(code))
