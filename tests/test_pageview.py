"""The page view against plain walks of trees, scripts by construction, tables cell by cell, fragments by all pairs."""

import random
import time
from html.parser import HTMLParser

import pytest

from tidemark.functions import markup as M
from tidemark.operators import fragments as G
from tidemark.operators import pageview as V
from tidemark.operators import passages as P

def inline(rng):
    """(mark-up, Markdown) of a run of words."""
    parts = []
    for _ in range(rng.randrange(1, 5)):
        w = rng.choice(("red", "green", "naïve", "x1"))
        kind = rng.randrange(8)
        if kind == 0:
            parts.append((f"<b>{w}</b>", f"**{w}**"))
        elif kind == 1:
            parts.append((f"<em> {w}</em>", f"*{w}*"))
        elif kind == 2:
            parts.append((f"<a title='t' href=/p?{w}&amp;k=1><strong>{w}</strong></a>", f"[**{w}**](/p?{w}&k=1)"))
        elif kind == 3:
            parts.append((f'<img alt="{w}" src="/i.png">', f"![{w}](/i.png)"))
        elif kind == 4:
            parts.append((f"<span><u>{w}</u></span> &amp;", f"{w} &"))
        elif kind == 5:
            parts.append((f"<code>{w}</code><script>if (a</script>", f"`{w}`"))
        else:
            parts.append((w, w))
    return "\n ".join(a for a, _ in parts), " ".join(b for _, b in parts)


def tree(rng, depth, quote, level):
    """(mark-up, expected (kind, level, quote, marker, text, cells)) of a random block."""
    kind = rng.choice(("p", "h2", "div", "quote", "list", "pre", "hr", "layout", "data", "text"))
    if depth > 3 and kind in ("div", "quote", "list", "layout"):
        kind = "p"
    own = ("item", level) if level else ("prose", 0)
    if kind in ("p", "text"):
        a, b = inline(rng)
        return (f"<p>{a}</p>" if kind == "p" else f"<div>{a}</div>"), [(*own, quote, "", b, None)]
    if kind == "h2":
        a, b = inline(rng)
        return f"<h2 class=x>{a}</h2>", [("heading", 2, quote, "", b, None)]
    if kind == "hr":
        return "<hr/>", [("rule", 0, quote, "", "", None)]
    if kind == "pre":
        return "<pre>a  b\n  c</pre>", [("code", level, quote, "", "a  b\n  c", None)]
    if kind == "data":
        cells = [[inline(rng) for _ in range(3)] for _ in range(2)]
        rows = "".join("<tr>" + "".join(f"<td>{a}</td>" for a, _ in r) + "</tr>" for r in cells)
        heads = "<tr><th>k</th><th colspan='2'>v</th></tr>" if rng.random() < 0.5 else ""
        want = [("row", None, quote, "", "", [("k", 1), ("v", 2)])] if heads else []
        return f"<table><tbody>{heads}{rows}</tbody></table>", want + [("row", None, quote, "", "", [(b, 1) for _, b in r]) for r in cells]
    if kind == "list":
        ordered, html, want = rng.random() < 0.5, "", []
        for k in range(rng.randrange(1, 4)):
            a, b = inline(rng)
            html += f"<li>{a}"
            want.append(("item", level + 1, quote, f"{k + 1}." if ordered else "-", b, None))
            if rng.random() < 0.4:
                inner, found = tree(rng, depth + 1, quote, level + 1)
                html += inner
                want += found
            html += rng.choice(("</li>", ""))
        name = "ol" if ordered else "ul"
        return f"<{name}>{html}</{name}>", want
    inner = [tree(rng, depth + 1, quote + (kind == "quote"), level) for _ in range(rng.randrange(1, 4))]
    html = [a for a, _ in inner]
    if kind == "layout":
        html = "<table>" + "".join(f"<tr><td>{a}</td></tr>" for a in html) + "</table>"
        if any(w[0] == "row" for _, f in inner for w in f):
            html = html.replace("<table>", '<table role="presentation">', 1)
    else:
        name = "blockquote" if kind == "quote" else "div"
        html = f"<{name}>{''.join(html)}</{name}>"
    return html, [w for _, f in inner for w in f]


def test_blocks_are_those_of_the_tree():
    rng = random.Random(8)
    for _ in range(600):
        made = [tree(rng, 0, 0, 0) for _ in range(rng.randrange(1, 5))]
        page = "<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body>" + "<!-- c -->".join(a for a, _ in made) + "</body></html>"
        got = [(k, None if k == "row" else n, q, m, t, [(c["text"], c["columns"]) for c in cells] if cells else None) for k, n, q, m, t, _, cells in V.blocks(page)[0]]
        assert got == [w for _, f in made for w in f], page


class Walk(HTMLParser):
    """Blocks of the given pages by a plain walk: paragraphs, items, links and bold text only."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.kind, self.bold, self.href = [], [], "", None, None

    def cut(self):
        """A bold part that is open ends with its block; where its paragraph ends, it is over."""
        parts = []
        for line in "".join(self.text).split("\0"):
            line = " ".join(line.split())
            parts += [line] if line else []
        if parts:
            self.out.append((self.kind or "prose", "  \n".join(parts)))
        self.text = []

    def end_bold(self):
        if self.bold is not None:
            inner = "".join(self.text[self.bold :])
            self.text[self.bold :] = [inner.replace(inner.strip(), f"**{inner.strip()}**")] if inner.strip() else [inner]
            self.bold = None

    def handle_starttag(self, tag, attrs):
        if tag == "b":
            self.bold = len(self.text)
        elif tag == "br":
            self.text.append("\0")
        elif tag == "a":
            self.href, self.at = dict(attrs)["href"], len(self.text)
        elif tag in ("title", "style", "script"):
            self.cut()
            self.hold = True
        else:
            self.end_bold()
            self.cut()
            self.kind = {"h1": "heading", "li": "item", "ul": "item"}.get(tag, "")

    def handle_endtag(self, tag):
        if tag == "b":
            self.end_bold()
        elif tag == "a":
            self.text[self.at :] = [f"[{''.join(self.text[self.at:])}]({self.href})"]
        elif tag in ("title", "style", "script"):
            self.text = []
        else:
            self.end_bold()
            self.cut()
            self.kind = ""

    def handle_data(self, data):
        self.text.append(data)


def test_blocks_of_the_given_pages(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        walk = Walk()
        walk.feed(r.html)
        walk.close()
        walk.end_bold()
        walk.cut()
        assert [(b[0], b[4]) for b in V.blocks(r.html)[0]] == walk.out, r.page_id


def test_broken_and_deep_markup():
    text = lambda s: [b[4] for b in V.blocks(s)[0]]
    assert text("a</p></div></b>b<p>c<p>d") == ["ab", "c", "d"]
    assert text("<p>x<b>y<p>z") == ["x**y**", "z"]
    assert text("<b>x<p>y</p>z</b>w") == ["**x**", "**y**", "**z**w"]
    assert text('<a href="u">x<div>y</div></a>') == ["[x](u)", "[y](u)"]
    assert text("<table><tr><td>a<td>b<tr><td>c<td>d</table>e")[-1] == "e" and len(V.blocks("<table><tr><td>a<td>b<tr><td>c<td>d</table>e")[0]) == 3
    assert text("a<b") == ["a"] and text("a < b") == ["a < b"] and text('<p class="x>y') == ["y"] and text("<!-- x") == [] and text("") == []
    deep = "<div><span>" * 500 + "x" + "</span></div>" * 500 + "<p>y"
    assert text(deep) == ["x", "y"]
    assert text("<font>" * 300 + "x<table><tr><th>k</table>" + "</font>" * 300 + "y") == ["x", "", "y"]
    nested = M.Tree("<table><tr><td>" * 3000 + "x")
    assert len(nested.above(len(nested.tag) - 1)) <= M.ALL_DEPTH + 1 and nested.words(0) == "x"
    assert text("<noframes><body><p>seen</p></noframes>") == ["seen"] and V.blocks("<noframes>x</noframes>")[1] == ["noframes"]


def test_layout_tables_and_scaffolding():
    kinds = lambda s: [b[0] for b in V.blocks(s)[0]]
    two = "<tr><td>a</td><td>b</td></tr>"
    assert kinds(f"<table>{two}</table>") == ["row"] and kinds(f"<table background=x>{two}</table>") == ["prose"] * 2
    assert kinds(f"<table role=none>{two}</table>") == ["prose"] * 2 and kinds("<table><tr><td>a</td><td> </td></tr></table>") == ["prose"]
    assert kinds("<table><caption>c</caption><tr><td>a</td></tr></table>") == ["prose", "row"]
    assert kinds(f"<table><tr><td>x<table>{two}</table></td></tr></table>") == ["prose", "row"]
    days = "".join(f"<td>{d}</td>" for d in "Su Mo Tu We Th Fr Sa".split())
    month = "".join("<tr>" + "".join(f"<td>{7 * w + d + 1}</td>" for d in range(7)) + "</tr>" for w in range(4))
    calendar = f"<table><tr><td>May 2003</td></tr><tr>{days}</tr>{month}</table>"
    assert V.blocks(calendar + "x") == (V.blocks("x")[0], ["calendar"]) and V.blocks(calendar.replace("<td>9<", "<td>9 raid night<"))[1] == []
    login = '<form><div>User name <input name=login> Password: <input type=password> <a href=/r>Register</a></div></form>'
    assert V.blocks(login + "x") == (V.blocks("x")[0], ["login"]) and V.blocks(login.replace("User name", "Our story"))[1] == []
    panel = '<div><script src="//x.com/ads/s.js"></script><a href=1>aa</a><a href=2>bb</a><a href=3><img src=i>cc</a></div>'
    assert V.blocks(panel + "x")[1] == ["advertising"] and V.blocks(panel.replace("/ads/", "/lib/"))[1] == [] and V.blocks(f"<article>{panel}</article>")[1] == []


def script(rng):
    """(script with its tags, whether a string of it holds a closing tag before any other)."""
    closing = rng.choice(("</script>", "</SCRIPT >"))
    quote = rng.choice("\"'`")
    pieces = [
        "var a = 1;", "x = y / 2 / z;", "// it's a note\n", "/* it's \"one\" too */", "f('it\\'s');", 'g("a\\\\");', "r = /[/'\"]+\\/'/g;", "if (a) return /x'y/;", "`t ${1} '`;", "\n", "a < b && c > d;", "<!-- old\n",
    ]
    held = f"write({quote}<iframe>{closing}{quote} + 1);"
    body = [rng.choice(pieces) for _ in range(rng.randrange(7))]
    inside = rng.random() < 0.6
    if inside:
        body.insert(rng.randrange(len(body) + 1), held)
    return "<script type=x>" + "\n".join(body) + closing, inside


def test_scripts_end_outside_of_their_strings():
    rng = random.Random(3)
    for _ in range(1500):
        made = [script(rng) for _ in range(rng.randrange(1, 4))]
        page = "<p>a</p>" + "<p>b</p>".join(s for s, _ in made) + "<p>c</p>"
        want = "<p>a</p>" + "<p>b</p>".join("<script></script>" if inside else s for s, inside in made) + "<p>c</p>"
        assert M.isolated(page) == (want, sum(inside for _, inside in made))


def test_uncertain_scripts_stay():
    for page in (
        "<script>var a = 'x</script><p>it's</p>", "<script>w('</script>') <div> x</script>", "<script>w('</script>' x)</script>", "<script>w('</script>'", "<script>", "", "<script>a</script>", "<script>/* </script> '</script>' */",
        "<script>w('</script>');" + " " * M.SCRIPT_REACH + "</script>", "<script>r = /'\n'</script>'/</script>",
    ):
        assert M.isolated(page) == (page, 0), page


def plain_isolated(page, end):
    parts, at, n = [], 0, 0
    while opening := M._OPENING.search(page, at):
        if not (closing := M._CLOSING.search(page, opening.end())):
            break
        stop = end(page, opening.end())
        parts.append(page[at : opening.start()] + "<script></script>" if stop else page[at : closing.end()])
        at, n = stop or closing.end(), n + bool(stop)
    return "".join([*parts, page[at:]]), n


def test_long_scripts_are_followed_to_their_end(spark):
    held, filler = "<script>write('</script>');", "a = b / 2 / c; // it's\n"
    long = held + filler * 9000 + "</script>"
    assert len(long) > 3 * M.SCRIPT_REACH and M.isolated(long, None) == ("<script></script>", 1) and M.isolated(long) == (long, 0)
    page = "<p>a</p>" + long + "<p>b</p>" + held + "</script><p>c</p>"
    df = spark.createDataFrame([(1, page), (2, held + filler * 9000), (3, None)], "id long, html string")
    got = {r.id: (r.html, r.isolated) for r in V.isolated_pages(df, "id", "html").collect()}
    assert got == {1: ("<p>a</p><script></script><p>b</p><script></script><p>c</p>", 2), 2: (held + filler * 9000, 0), 3: ("", 0)}
    assert V.markdown(V.page_blocks(df.where("id = 1"), "id", "html"), "id").first().markdown == "a\n\nb\n\nc"
    # Scripts inside of a script's comments, none of which ends: the work stays in proportion to the page.
    began, many = time.process_time(), "<script>" + "f('</script>');/*<script>*/" * 20_000
    assert M.isolated(many, None) == (many, 0) and time.process_time() - began < 20


def test_scripts_that_share_their_text_end_alike():
    rng = random.Random(9)
    pieces = ["'</script>'", '"</script>"', "/*<script>*/", "<script>", "</script>", ";", "a", "/", "=", "'", '"', "\\", "\n", ") ", "x" * 40, "'" + "y" * 50 + "';"]
    for _ in range(4000):
        page = "<script>'</script>';" + "".join(rng.choices(pieces, [6, 6, 6, 1, 1, 8, 4, 2, 2, 1, 1, 1, 2, 2, 4, 6], k=rng.randrange(2, 40)))
        assert M.isolated(page, None) == plain_isolated(page, M.script_end)


def test_pages_in_rows(spark):
    rows = [(1, "<h1>T</h1><ul><li>a<li>b<ul><li>c</ul></ul><blockquote>q<p>r</blockquote><pre>x\ny</pre><table><tr><th>k<th>v<tr><td colspan=2>a|b</table>z"), (None, "<p>n"), (3, None), (3, ""), (4, "<p>" + "w " * 50000)]
    df = spark.createDataFrame(rows, "id long, html string")
    got = {r.id: r for r in V.markdown(V.page_blocks(df, "id", "html"), "id").collect()}
    assert got[1].markdown == "# T\n\n- a\n- b\n    - c\n\n> q\n\n> r\n\n```\nx\ny\n```\n\n| k | v |\n| --- | --- |\n| a\\|b |  |\n\nz"
    assert (got[None].markdown, got[3].markdown, got[3].blocks, len(got[4].markdown)) == ("n", "", 0, 99999)
    assert V.markdown(V.page_blocks(df.limit(0), "id", "html"), "id").count() == 0


def plain_grid(rows):
    taken, out = {}, []
    for r, cells in enumerate(rows):
        c = 0
        for cell in cells:
            while (r, c) in taken:
                c += 1
            for i in range(cell["rows"]):
                for j in range(cell["columns"]):
                    taken[r + i, c + j] = cell["text"] if i == j == 0 else ""
            c += cell["columns"]
        width = max([c] + [k + 1 for i, k in taken if i == r])
        out.append([taken.get((r, k), "") for k in range(width)])
    return out


def test_grids_show_each_cell_once():
    rng = random.Random(5)
    for _ in range(500):
        rows = [[{"text": f"{r}.{c}", "columns": rng.choice((1, 1, 2)), "rows": rng.choice((1, 1, 3)), "head": False} for c in range(rng.randrange(1, 4))] for r in range(rng.randrange(1, 6))]
        want, got = plain_grid(rows), list(G.grid(rows))
        if all(len(w) == len(g) for w, g in zip(want, got)):
            assert got == want
        assert sorted(x for line in got for x in line if x) == sorted(c["text"] for r in rows for c in r)


def test_chunks_of_tables(spark):
    cells = lambda r: "".join(f"<td>{r}-{c} {'word ' * (r % 7)}</td>" for c in range(3))
    long = "<tr><td>" + "many " * 400 + "</td><td>b</td></tr>"
    html = "<table><tr><th>one<th>two<th>three</tr>" + "".join(f"<tr>{cells(r)}</tr>" for r in range(40)) + long + f"<tr>{cells(50)}</tr></table><p>x</p><table><tr><td>p<td>q</table>"
    df = spark.createDataFrame([(7, html), (8, None)], "id long, html string")
    got = sorted(G.table_chunks(V.page_blocks(df, "id", "html"), "id", budget=120).collect(), key=lambda r: (r.table, r.chunk))
    first, second = ([r for r in got if r.table == t] for t in sorted({r.table for r in got}))
    assert all(len(P.token_starts(r.header)) + len(P.token_starts(r.body)) == r.tokens <= 120 for r in got)
    assert {r.header for r in first} == {"| one | two | three |"} and [(r.header, r.body) for r in second] == [("", "| p | q |")]
    body = "\n".join(r.body for r in first)
    assert all(body.count(f"| {r}-0 ") == 1 and body.count(f"| {r}-2 ") == 1 for r in [*range(40), 50]) and body.count("many") == 400
    assert [r.first for r in first] == sorted(r.first for r in first) and first[0].first == 1
    with pytest.raises(ValueError):
        G.table_chunks(df, "id", budget=90)


def test_fragments_are_packed_in_order_and_inner_ones_go(spark):
    rng, rows = random.Random(2), []
    for d in range(12):
        at = 0
        for k in range(rng.randrange(1, 40)):
            at += rng.choice((0, 0, 0, 5))
            rows.append((d, k, at, at + (n := rng.randrange(1, 30)), n, rng.choice(("prose", "prose", "prose", "heading", "code")), rng.choice("aab")))
            at += n
    df = spark.createDataFrame(rows, "id long, passage long, start long, end long, tokens long, kind string, context string")
    got = sorted(map(tuple, G.packed(df, "id", 50).collect()))
    want = []
    for d in range(12):
        own = []
        for _, _, a, b, n, kind, context in (r for r in rows if r[0] == d):
            if own and own[-1][1] == a and own[-1][4] == context and own[-1][2] + n <= 50 and (own[-1][3] == "heading" or (own[-1][3], kind) == ("prose", "prose")):
                own[-1] = (own[-1][0], b, own[-1][2] + n, kind, context)
            else:
                own.append((a, b, n, kind, context))
        want += [(d, k, *x) for k, x in enumerate(own)]
    assert got == want
    spans = [(rng.randrange(3), k, a, a + rng.randrange(12)) for k, a in ((k, rng.randrange(30)) for k in range(150))]
    left = G.outermost(spark.createDataFrame(spans, "id long, passage long, start long, end long"), "id").collect()
    inside = lambda x, y: x[0] == y[0] and y[2] <= x[2] and x[3] <= y[3] and x is not y and (y[2:] != x[2:] or y[1] < x[1])
    assert sorted(map(tuple, left)) == sorted(x for x in spans if not any(inside(x, y) for y in spans))
    assert G.packed(df.limit(0), "id").count() == 0
