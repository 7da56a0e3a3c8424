"""Nodes of pages against a tree made by html.parser, and each rule on pages that break it and that don't."""

from __future__ import annotations

from html.parser import HTMLParser

import pytest

from verigate.operators import accessibility as A


class Tree(HTMLParser):
    """(tag, tags above) of every element in order."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        for starts, closed, bounds in A.ENDS:
            if tag in starts:
                last = lambda names: max((i + 1 for i, t in enumerate(self.open) if t in names), default=0)
                if last(closed) > last(bounds):
                    del self.open[last(closed) - 1 :]
                break
        self.found.append((tag, tuple(self.open)))
        if tag not in A.VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]


ODD = [
    "", "no tags < at & all", "<p>a<p>b<div>c</div>d</p></p>", "<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "<table><tr><td>a<td>b<tr><td><table><tr><td>x</table>y</table>",
    "<b><i>x</b></i>", "<a href='>' title=\">\">q</a>", "<script>if (a < b) { '<p>' }</script><style>p > q {}</style><p>", "<!-- <p> --><P CLASS=x>T</P>", "<dl><dt>a<dd>b<dt>c</dl>", "<select><option>1<option>2</select>", "</div></p>text", "<p><button><p>in</button>",
]


def test_nodes_equal_a_parser(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] + [(-i - 1, h) for i, h in enumerate(ODD)]
    rows = A.nodes(spark.createDataFrame(pages, "page_id long, html string"), "page_id", "html").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.page, {})[r.node] = r
    for page, html in pages:
        tree = Tree()
        tree.feed(html)
        tree.close()
        own = by.get(page, {})
        got = [(r.tag, tuple(own[k].tag for k in r.up)) for _, r in sorted(own.items()) if r.tag != "#text"]
        assert got == tree.found, html[:200]
        assert all(r.parent == (r.up[-1] if r.up else None) for r in own.values())


def _page(body="", head="<title>t</title>"):
    return f'<html lang="en"><head>{head}</head><body><main>{body}</main></body></html>'


# rule, pages that break it with how many nodes, pages that don't
CASES = [
    ("image-alt", [(_page("<img><img src=x alt>"), 1), (_page("<IMG SRC='>'>"), 1)], ["<img alt=''>", "<img aria-label=x>", "<img role=presentation>", "<img title=t>", "<!--<img>-->", "<img aria-hidden=true>"]),
    ("html-has-lang", [("<html><title>t</title><main></main>", 1), ("<title>t</title><main></main>", 1), ('<html lang=" "><title>t</title><main></main>', 1)], [""]),
    ("html-lang-valid", [('<html lang="english!"><title>t</title><main></main>', 1)], [""]),
    ("document-title", [(_page(head=""), 1), (_page(head="<title> &nbsp;</title>"), 1)], [""]),
    ("link-name", [(_page("<a href=x></a><a href=y> &nbsp;<b></b></a><a href=z><img alt=''></a>"), 3)], ["<a href=x>t</a>", "<a href=x><i><b>t</b></i></a>", "<a href=x><img alt=t></a>", "<a name=x></a>", "<a href=x aria-labelledby=q></a><i id=q>t</i>", "<a href=x aria-label=t></a>"]),
    ("button-name", [(_page("<button></button><input type=button><button aria-labelledby=none></button>"), 3)], ["<button>t</button>", "<button title=t></button>", "<input type=button value=t>", "<input type=submit>"]),
    ("label", [(_page("<input><input type=text id=a><label for=b>t</label><textarea></textarea>"), 3), (_page("<label></label><label><input></label>"), 1)], ["<input id=a><label for=a>t</label>", "<label>t<input></label>", "<input aria-label=t>", "<input placeholder=t>", "<input type=hidden>", "<input aria-labelledby='x y'><b id=y>t</b>"]),
    ("select-name", [(_page("<select><option>1</select>"), 1)], ["<label>t<select></select></label>", "<select title=t></select>"]),
    ("input-image-alt", [(_page("<input type=image>"), 1)], ["<input type=image alt=t>"]),
    ("area-alt", [(_page("<map><area href=x><area></map>"), 1)], ["<map><area href=x alt=t></map>"]),
    ("frame-title", [(_page("<iframe></iframe>"), 1)], ["<iframe title=t></iframe>"]),
    ("empty-heading", [(_page("<h1></h1><h2><b> </b></h2>"), 2)], ["<h1>t</h1>", "<h1><img alt=t></h1>"]),
    ("heading-order", [(_page("<h1>a</h1><h3>b</h3><h4>c</h4><h2>d</h2><h5>e</h5>"), 2)], ["<h2>a</h2><h3>b</h3><h1>c</h1>"]),
    ("duplicate-id", [(_page("<i id=a></i><b id=a></b><u id=a></u>"), 2)], ["<i id=a></i><b id=A></b>", "<i id=''></i><b id=''></b>"]),
    ("list", [(_page("<ul>text<li>a</ul><ol><div></div></ol>"), 2)], ["<ul> <li>a<li>b<script></script></ul>"]),
    ("listitem", [(_page("<li>a</li><div><li>b</li></div>"), 2)], ["<ul><li>a</ul>", "<menu><li>a</menu>"]),
    ("landmark-one-main", [("<html lang=en><title>t</title><body></body>", 1)], ["", "<div role=main></div>"]),
    ("meta-refresh", [(_page(head="<title>t</title><meta http-equiv=Refresh content='5; url=x'>"), 1)], ["<meta http-equiv=refresh content=0>"]),
    ("meta-viewport", [(_page(head="<title>t</title><meta name=viewport content='user-scalable=no'><meta name=viewport content='maximum-scale=1.0'>"), 2)], ["<meta name=viewport content='width=device-width, maximum-scale=5'>"]),
    ("tabindex", [(_page("<i tabindex=1></i><i tabindex=x></i>"), 1)], ["<i tabindex=0></i>", "<i tabindex=-1></i>"]),
]


def test_rules(spark):
    assert [c[0] for c in sorted(CASES)] == A.RULES
    rows, want = [], {}
    for rule, bad, good in CASES:
        for html, n in bad:
            want[len(rows)] = (rule, n)
            rows.append((len(rows), html))
        for body in good:
            want[len(rows)] = (rule, 0)
            rows.append((len(rows), _page(body)))
    found = A.findings(spark.createDataFrame(rows, "page_id int, html string"), "page_id", "html").collect()
    for k, (rule, n) in want.items():
        assert sum(f.page == k and f.rule == rule for f in found) == n, (rule, rows[k][1])


def test_only_and_maps(spark):
    df = spark.createDataFrame([(1, _page("<img><img><i tabindex=2></i>")), (2, _page()), (3, None)], "page_id int, html string")
    assert {r.page_id: r.by_rule for r in A.by_rule(df, "page_id", "html").collect()} == {1: {"image-alt": 2, "tabindex": 1}, 2: {}, 3: {}}
    assert {f.rule for f in A.findings(df, "page_id", "html", ["tabindex", "no-such-rule"]).collect()} == {"tabindex"}
    with pytest.raises(ValueError):
        A.findings(df, "page_id", "html", ["no-such-rule"])


def test_long_page(spark):
    body = "<p title='" + "q" * 200_000 + "'>" + "<ul><li>a</ul>" * 1500 + "x" * 300_000 + "<!--" + "y" * 200_000 + "--><img>"
    found = A.findings(spark.createDataFrame([(1, _page(body))], "page_id int, html string"), "page_id", "html").collect()
    assert [f.rule for f in found] == ["image-alt"]


def test_long_pages_are_one_tree(spark):
    """A page of many runs of tokens has one tree; no expression over a page is made again for each of its elements."""
    deep, flat = 3 * A.RUN + 5, 2 * A.RUN
    pages = spark.createDataFrame([(1, "<div>" * deep + "x" + "</div>" * deep + "<i></i>" * flat), (2, ""), (3, "<p>" * (A.RUN + 1))], "id int, html string")
    tree = A.nodes(pages, "id", "html")
    got = {(r.page, r.node): r for r in tree.collect()}
    assert len(got) == deep + 1 + flat + A.RUN + 1
    assert [got[1, i].parent for i in range(deep + 1)] == [None, *range(deep)] and got[1, deep].up == list(range(deep))
    assert all(got[1, 2 * deep + 1 + 2 * i].parent is None for i in range(flat)) and all(got[3, i].parent is None for i in range(A.RUN + 1))
    assert tree._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 3
