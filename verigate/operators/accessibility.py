"""Accessibility findings of web pages: pages to nodes with parents, and rules as joins and groupings over the nodes.

``nodes`` folds a page's tags over a stack of open elements, with the end tags that HTML leaves out; each rule is a
relation over the rows. No page needs another, so all groupings are by page and node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verigate.operators.tables import staged

# Elements without content, and those whose content is text alone.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
RAW = ["script", "style", "textarea", "title"]
# Which open elements a start tag ends, unless one of the bounds stands between.
BLOCKS = "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split()
ENDS = [
    (BLOCKS, ["p"], ["table", "td", "th", "caption", "button", "object", "template"]),
    (["li"], ["li"], ["ul", "ol", "menu"]),
    (["dt", "dd"], ["dt", "dd"], ["dl"]),
    (["option"], ["option"], ["select", "datalist"]),
    (["tr"], ["tr"], ["table"]),
    (["td", "th"], ["td", "th"], ["table", "tr"]),
    (["thead", "tbody", "tfoot"], ["thead", "tbody", "tfoot"], ["table"]),
]
RULES = [
    "area-alt", "button-name", "document-title", "duplicate-id", "empty-heading", "frame-title", "heading-order", "html-has-lang", "html-lang-valid", "image-alt",
    "input-image-alt", "label", "landmark-one-main", "link-name", "list", "listitem", "meta-refresh", "meta-viewport", "select-name", "tabindex",
]

_TAG = r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+"
_TOKENS = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW)})(?=[\s/>]){_TAG}>.*?(?:</\1\s*>|\z)|</?[a-z]{_TAG}>|<[!?][^>]*+>|[^<]++|<"
#: Tokens of a page that are folded in one run.
RUN = 32
_STATE = "struct<tags:array<string>,ids:array<int>,nodes:array<struct<node:int,parent:int,up:array<int>,tag:string,raw:string>>>"


def _position(tags: Column, name: Column) -> Column:
    """The place of the last open element of a name, from 1; 0 for none."""
    back = F.array_position(F.reverse(tags), name).cast("int")
    return F.when(back > 0, F.size(tags) - back + 1).otherwise(0)


def _last(tags: Column, names: list[str]) -> Column:
    return F.greatest(F.lit(0), *[_position(tags, F.lit(n)) for n in names])


def _tree(s: Column, x: Column) -> Column:
    """The state after one more token: open elements (names, ids), and the nodes so far."""
    token, at, name, end = x["token"], x["at"], x["name"], x["end"]
    cut = F.when(end, _position(s["tags"], name))
    for starts, closed, bounds in ENDS:
        cut = cut.when(name.isin(*starts), F.when(_last(s["tags"], closed) > _last(s["tags"], bounds), _last(s["tags"], closed)).otherwise(0))
    keep = F.transform(F.array(F.coalesce(cut, F.lit(0))), lambda c: F.when(c > 0, c - 1).otherwise(F.size(s["tags"])))[0]

    def placed(k: Column) -> Column:
        tags, ids = F.slice(s["tags"], F.lit(1), k), F.slice(s["ids"], F.lit(1), k)
        text = name == "#text"
        row = F.struct(at.alias("node"), F.try_element_at(ids, F.lit(-1)).alias("parent"), ids.alias("up"), name.alias("tag"), token.alias("raw"))
        opens = ~end & ~text & ~name.isin(*VOID, *RAW)
        return F.struct(
            F.when(opens, F.concat(tags, F.array(name))).otherwise(tags).alias("tags"),
            F.when(opens, F.concat(ids, F.array(at))).otherwise(ids).alias("ids"),
            F.when(end, s["nodes"]).otherwise(F.concat(s["nodes"], F.array(row))).alias("nodes"),
        ).cast(_STATE)

    return F.transform(F.array(keep), placed)[0]


def _run(s: Column, tokens: Column) -> Column:
    """The state after a run of tokens. What a fold has so far is copied with each token, so a run has its own nodes;
    those of the page are copied once a run."""
    begin = F.struct(s["tags"].alias("tags"), s["ids"].alias("ids"), F.slice(s["nodes"], F.lit(1), F.lit(0)).alias("nodes")).cast(_STATE)
    return F.aggregate(tokens, begin, _tree, lambda t: F.struct(t["tags"].alias("tags"), t["ids"].alias("ids"), F.concat(s["nodes"], t["nodes"]).alias("nodes")).cast(_STATE))


def nodes(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """Rows (page, node, parent, up, tag, raw, attrs, text): elements and texts of each page in order.

    ``node`` is the token's place, ``up`` the ids of all ancestors, ``attrs`` a map of lower-case names (the first of a
    name counts), ``text`` what a text or an element of text alone holds. A null page has no nodes.
    """
    tokens = F.filter(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_TOKENS), F.lit(0)), lambda t: ~t.rlike(r"(?s)^<[!?]"))
    name = lambda t: F.when(t.rlike(r"^</?[a-zA-Z]"), F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))).otherwise("#text")
    parts = F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.cast("int").alias("at"), name(t).alias("name"), t.rlike("^</[a-zA-Z]").alias("end")))
    begin = F.expr(f"cast(named_struct('tags', array(), 'ids', array(), 'nodes', array()) as {_STATE})")
    # what is used more than once is a column of its own: within a function over an array it would be made for each element
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_parts") - 1, F.lit(0)), F.lit(RUN)), lambda i: F.slice("_parts", i + 1, F.lit(RUN)))
    rows = pages.select(F.col(id_col).alias("page"), parts.alias("_parts"))
    rows = rows.select("page", F.inline(F.aggregate(runs, begin, _run, lambda s: s["nodes"])))
    head = F.when(F.col("tag") != "#text", F.regexp_extract("raw", rf"(?is)^<[a-z][^\s/>]*({_TAG})>", 1))
    pattern = r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
    names, values = (F.regexp_extract_all(F.coalesce("_head", F.lit("")), F.lit(pattern), F.lit(k)) for k in (1, 2))
    rows = rows.withColumn("_head", head).withColumns({"_names": F.transform(names, lambda n: F.lower(n)), "_values": values})
    pairs = F.transform("_names", lambda n, i: F.struct(n.alias("key"), F.regexp_replace(F.get("_values", i), "^[\"']|[\"']$", "").alias("value"), (F.array_position("_names", n) == i + 1).alias("new")))
    attrs = F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["new"]), lambda p: F.struct(p["key"], p["value"])))
    inner = F.when(F.col("tag") == "#text", F.col("raw")).when(F.col("tag").isin(*RAW), F.regexp_extract("raw", rf"(?is)^<[a-z]{_TAG}>(.*?)(?:</[a-z]+\s*>)?\z", 1))
    return rows.withColumns({"attrs": attrs, "text": inner}).drop("_head", "_names", "_values")


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _some(c: Column) -> Column:
    """Is there anything to read, white space and its entities apart?"""
    return F.coalesce(F.regexp_replace(c, r"(?U)\s|&nbsp;|&#160;|&#xa0;", "") != "", F.lit(False))


def _named(tree: DataFrame) -> DataFrame:
    """The nodes with what their names may come from: ``inside`` (text, or alternative text, below), ``referred`` (by
    aria-labelledby) and ``labelled`` (by a label around it or for it)."""
    label = F.coalesce(_some(_attr("aria-label")), F.lit(False))
    gives = F.when(F.col("tag") == "#text", _some(F.col("text"))).when(F.col("tag").isin("img", "area"), _some(_attr("alt")) | label).when(F.col("tag").isin("script", "style", "title", "textarea"), False).otherwise(label)
    inside = tree.where(gives).select("page", F.explode("up").alias("node")).distinct().withColumn("inside", F.lit(True))
    rows = tree.join(inside, ["page", "node"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    ids = rows.where(_some(_attr("id")) & (F.col("inside") | label | _some(_attr("alt")))).select("page", _attr("id").alias("ref"))
    wants = rows.where(_some(_attr("aria-labelledby"))).select("page", "node", F.explode(F.split(F.trim(_attr("aria-labelledby")), r"\s+")).alias("ref"))
    referred = wants.join(ids, ["page", "ref"]).select("page", "node").distinct().withColumn("referred", F.lit(True))
    labels = rows.where((F.col("tag") == "label") & F.col("inside"))
    fields = rows.where(F.col("tag").isin("input", "select", "textarea"))
    around = fields.select("page", F.col("node").alias("field"), F.explode("up").alias("node")).join(labels.select("page", "node"), ["page", "node"]).select("page", "field")
    aimed = fields.where(_some(_attr("id"))).select("page", F.col("node").alias("field"), _attr("id").alias("ref")).join(labels.select("page", _attr("for").alias("ref")), ["page", "ref"]).select("page", "field")
    labelled = around.union(aimed).distinct().select("page", F.col("field").alias("node"), F.lit(True).alias("labelled"))
    out = rows.join(referred, ["page", "node"], "left").join(labelled, ["page", "node"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("referred", "labelled")})


def findings(pages: DataFrame, id_col: str, html: str, only: list[str] | None = None) -> DataFrame:
    """Rows (page, rule, node): the nodes that break a rule. ``only`` is a list of rules to apply; others don't run, and
    a list without any known rule is an error.

    What a whole page lacks (title, language, main part) is found at its html element, or at node -1 without one.
    """
    wanted = sorted(set(RULES) & set(only)) if only is not None else RULES
    if not wanted:
        raise ValueError(f"none of these rules is known: {only}")
    tree = staged(nodes(pages, id_col, html))  # many rules read it
    rows = _named(tree)
    tag, own = F.col("tag"), _some(_attr("aria-label")) | F.col("referred") | _some(_attr("title"))
    kind = F.lower(F.trim(F.coalesce(_attr("type"), F.lit("text"))))
    silent = F.coalesce(F.lower(_attr("role")).isin("presentation", "none"), F.lit(False))
    hidden = F.coalesce(F.lower(_attr("aria-hidden")) == "true", F.lit(False))
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    delay = number(F.regexp_extract(F.coalesce(_attr("content"), F.lit("")), r"^\s*(\d+)", 1))
    scale = F.regexp_extract(F.lower(F.coalesce(_attr("content"), F.lit(""))), r"maximum-scale\s*=\s*([\d.]+)", 1)
    fixed = F.lower(F.coalesce(_attr("content"), F.lit(""))).rlike(r"user-scalable\s*=\s*(no|0)\b")
    field = own | F.col("labelled") | _some(_attr("placeholder"))
    heading = tag.rlike("^h[1-6]$")
    alone = {
        "area-alt": (tag == "area") & _attr("href").isNotNull() & ~_some(_attr("alt")) & ~own,
        "button-name": ((tag == "button") & ~F.col("inside") & ~own) | ((tag == "input") & (kind == "button") & ~_some(_attr("value")) & ~own),
        "empty-heading": heading & ~F.col("inside") & ~own,
        "frame-title": tag.isin("iframe", "frame") & ~own,
        "html-has-lang": (tag == "html") & ~_some(_attr("lang")) & ~_some(_attr("xml:lang")),
        "html-lang-valid": (tag == "html") & _some(_attr("lang")) & ~F.coalesce(F.trim(_attr("lang")).rlike("(?i)^[a-z]{2,3}(-[a-z0-9]+)*$"), F.lit(False)),
        "image-alt": (tag == "img") & _attr("alt").isNull() & ~own & ~silent,
        "input-image-alt": (tag == "input") & (kind == "image") & ~_some(_attr("alt")) & ~own,
        "label": (((tag == "input") & ~kind.isin("hidden", "button", "submit", "reset", "image")) | (tag == "textarea")) & ~field,
        "link-name": (tag == "a") & _attr("href").isNotNull() & ~F.col("inside") & ~own,
        "meta-refresh": (tag == "meta") & (F.lower(F.coalesce(_attr("http-equiv"), F.lit(""))) == "refresh") & (delay > 0) & (delay < 72_000),
        "meta-viewport": (tag == "meta") & (F.lower(F.coalesce(_attr("name"), F.lit(""))) == "viewport") & (fixed | ((scale != "") & (number(scale) < 2))),
        "select-name": (tag == "select") & ~(own | F.col("labelled")),
        "tabindex": number(_attr("tabindex")) > 0,
    }
    found = []
    broken = F.filter(F.array(*[F.when(c & ~hidden, F.lit(r)) for r, c in alone.items() if r in wanted]), lambda r: r.isNotNull())
    found.append(rows.select("page", F.explode(broken).alias("rule"), "node"))
    above = tree.select("page", F.col("node").alias("parent"), F.col("tag").alias("parent_tag"))
    if {"list", "listitem"} & set(wanted):
        child = tree.join(above, ["page", "parent"], "left")
        if "list" in wanted:
            odd = F.when(tag == "#text", _some(F.col("text"))).otherwise(~tag.isin("li", "script", "template"))
            found.append(child.where(F.col("parent_tag").isin("ul", "ol") & odd).select("page", F.lit("list").alias("rule"), F.col("parent").alias("node")).distinct())
        if "listitem" in wanted:
            found.append(child.where((tag == "li") & ~F.coalesce(F.col("parent_tag"), F.lit("")).isin("ul", "ol", "menu")).select("page", F.lit("listitem").alias("rule"), "node"))
    if "duplicate-id" in wanted:
        again = F.row_number().over(Window.partitionBy("page", "ref").orderBy("node"))
        found.append(tree.where(_some(_attr("id"))).select("page", "node", _attr("id").alias("ref")).withColumn("k", again).where("k > 1").select("page", F.lit("duplicate-id").alias("rule"), "node"))
    if "heading-order" in wanted:
        level = F.substring("tag", 2, 1).cast("int")
        heads = tree.where(heading).select("page", "node", level.alias("level")).withColumn("before", F.lag("level").over(Window.partitionBy("page").orderBy("node")))
        found.append(heads.where("level > before + 1").select("page", F.lit("heading-order").alias("rule"), "node"))
    whole = tree.groupBy("page").agg(F.min(F.when(tag == "html", F.col("node"))).alias("node"), F.max(F.when(tag == "title", _some(F.col("text")))).alias("title"), F.max((tag == "main") | F.coalesce(F.lower(_attr("role")) == "main", F.lit(False))).alias("main"))
    whole = whole.withColumn("node", F.coalesce("node", F.lit(-1)))
    if "document-title" in wanted:
        found.append(whole.where(~F.coalesce("title", F.lit(False))).select("page", F.lit("document-title").alias("rule"), "node"))
    if "landmark-one-main" in wanted:
        found.append(whole.where(~F.col("main")).select("page", F.lit("landmark-one-main").alias("rule"), "node"))
    if "html-has-lang" in wanted:
        found.append(whole.where("node = -1").select("page", F.lit("html-has-lang").alias("rule"), "node"))
    return reduce(DataFrame.unionAll, found)


def by_rule(pages: DataFrame, id_col: str, html: str, only: list[str] | None = None) -> DataFrame:
    """The pages with ``by_rule``, a map of rules to their numbers of nodes; an empty map for a page without findings."""
    counts = findings(pages, id_col, html, only).groupBy("page", "rule").agg(F.count(F.lit(1)).cast("int").alias("n"))
    maps = counts.groupBy("page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("by_rule"))
    out = pages.join(maps, pages[id_col] == maps["page"], "left").drop("page")
    return out.withColumn("by_rule", F.coalesce("by_rule", F.expr("cast(map() as map<string,int>)")))
