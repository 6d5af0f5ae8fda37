"""Proofs of discussions and boards, mail views, pieces, strict JSON and graph growth against plain versions and hard cases."""

import json
import random

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators import discussions as D
from tidemark.operators import growth as G

MARKS = '<td class="postbody">x</td><td class="postdetails">y</td>'


def test_resolved(spark):
    base = "HTTP://a.example.org:81/x/y.php?q=1"
    cases = {
        "z.php?t=1": "http://a.example.org:81/x/z.php?t=1", "./z.php": "http://a.example.org:81/x/z.php", "/z": "http://a.example.org:81/z", "?t=2": "http://a.example.org:81/x/y.php?t=2",
        "//b.org/c": "http://b.org/c", "https://b.org/?a=1&amp;b=2": "https://b.org/?a=1&b=2", "mailto:x@y.org": None, "#top": None, "../z": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "link string").select("link", U.resolved(F.lit(base), F.col("link")).alias("u")).collect()
    assert {r["link"]: r["u"] for r in rows} == cases


def test_topic_pages_need_marks_and_an_own_link(spark):
    url = "http://a.org/f/viewtopic.php?t=7"
    own = '<a href="viewtopic.php?t=7">x</a>'
    cases = {
        "whole": (url, own + MARKS), "upper": (url, '<A class=b HREF=viewtopic.php?t=7>x</A>' + MARKS), "other host": (url, '<a href="http://b.org/f/viewtopic.php?t=7">x</a>' + MARKS),
        "other folder": (url, '<a href="/g/viewtopic.php?t=7">x</a>' + MARKS), "other topic": (url, '<a href="viewtopic.php?t=70">x</a>' + MARKS),
        "quoted": (url, f"<pre>{own}</pre>{MARKS}"), "quoted over lines": (url, f"<blockquote\n class=q>\n{own}\n</blockquote>{MARKS}"), "no marks": (url, own),
        "zero": ("http://a.org/f/viewtopic.php?t=07", '<a href="viewtopic.php?t=07">x</a>' + MARKS), "twice": (url + "&t=8", own + MARKS),
        "no topic": ("http://a.org/f/index.php", own + MARKS), "null url": (None, own + MARKS), "null page": (url, None), "empty": (url, "")}
    pages = spark.createDataFrame([(k, *v, 1) for k, v in cases.items()], "page string, url string, html string, platform int")
    found = {r["page"]: r for r in D.topic_pages(pages, "page", "url", "html").collect()}
    assert set(found) == {"whole", "upper"}
    assert (found["whole"]["platform"], found["whole"]["forum"], found["whole"]["topic"]) == ("phpbb", "/f", "7")
    assert D.topic_pages(pages.limit(0), "page", "url", "html").count() == 0


def _feed(asked="3", board="b", title="Re: Talk", first="Talk", items=("1", "3", "2"), part="M", origin="http://x.org"):
    link = f"http://x.org/c/board/message?board.id={board}&amp;message.id="
    posts = "".join(f"<item><title>{first if k == 0 else 'Re: Talk'}</title><link>{link}{m}#{part}{m}</link></item>" for k, m in enumerate(items))
    return f"{origin}/rss/message?board.id=b&message.id={asked}", f"<rss><channel><title>{title}</title><link>{link}{asked}</link>{posts}</channel></rss>"


def test_feeds_prove_only_as_a_whole(spark):
    good = _feed()
    bad = [
        _feed(board="z"), _feed(title="Other"), _feed(first="Re: Talk"), _feed(first=""), _feed(items=("2", "1")), _feed(items=("1", "2", "2")), _feed(part="N"), _feed(items=()),
        _feed(origin="http://y.org"), (good[0].replace("/rss/", "/atom/"), good[1]), (good[0], good[1][:-9]), (good[0], "<!DOCTYPE rss>" + good[1]), (good[0], None), (None, good[1])]
    members = lambda feeds: sorted(map(tuple, D.feed_members(spark.createDataFrame(feeds, "url string, xml string"), "url", "xml").collect()))
    assert members(bad) == []
    assert members([good, good]) == [("http://x.org", "/c/b", m, "1") for m in "123"]
    other = _feed(asked="9", items=("2", "9"))  # a second topic claims 2
    assert members([good, other]) == [("http://x.org", "/c/b", "1", "1"), ("http://x.org", "/c/b", "3", "1"), ("http://x.org", "/c/b", "9", "2")]


def test_board_evidence(spark):
    hosts = r"^p\d\.org$"
    captures = spark.createDataFrame([
        ("index", "http://p1.org/bNews/index.html", "[a](http://p2.org/fnewsone.html) http://p9.org/fnews http://q.org/fnewstwo http://p1.org/fothers"),
        ("other index", "http://q.org/bnews", "http://p1.org/fnewsthree"), ("forum", "http://p3.org/fnewsone/5", ""), ("page", "http://p3.org/fnewsone.showMessage?x=1", None),
        ("longer", "http://p3.org/fnewsonemore", ""), ("unproven", "http://p3.org/fnewstwo", ""), ("null", None, None)], "k string, u string, t string")
    evidence = D.forum_links(captures, "u", "t", hosts)
    assert [tuple(r) for r in evidence.collect()] == [("bnews", "fnewsone")]
    assert sorted(map(tuple, D.board_captures(captures, "k", "u", evidence, hosts).collect())) == [("forum", "bnews"), ("index", "bnews"), ("page", "bnews")]


def test_reciprocal_pairs(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(12)}", rng.choice([None, *[f"n{k}" for k in range(12)]])) for _ in range(90)]
    found = D.reciprocal(spark.createDataFrame(links, "s string, t string"), "s", "t").collect()
    assert sorted(map(tuple, found)) == sorted({(a, b) for a, b in links if b and a < b and (b, a) in links})


def _pieces(text, most):
    out = []
    while text:
        n = len(text) if len(text) <= most else max((k + 1 for k in range(most // 2, most) if text[k] in " \n"), default=most)
        out, text = [*out, text[:n]], text[n:]
    return out


def test_pieces_are_whole_and_bounded(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab \n😀é" if k % 2 else "abcdefghijklmno ") for _ in range(rng.randrange(150))) for k in range(120)] + ["", None, "x" * 100, " " * 61, "x" * 20 + "\n"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.pieces("t", 20).alias("p")).collect()
    assert {r["k"]: r["p"] for r in rows} == {k: _pieces(t or "", 20) for k, t in enumerate(texts)}


def test_search_view_keeps_what_is_around_promotions(spark):
    text = "**Alternate Page URL:** http://a\nx\n<h1>Two\nlines</h1> ![pic](http://b/c.png) [a]\n> long talk<br/>> YAHOO! groups links here<br>end\nONElist is THE place"
    row = spark.createDataFrame([(text, None)], "t string, n string").select(
        X.search_view("t", F.lit(True)).alias("mail"), X.search_view("t", F.lit(False)).alias("page"), X.promotions("t").alias("n"), X.search_view("n", F.lit(True)).alias("none")).first()
    assert row["mail"] == "x\n# Two\nlines pic [a]\n> long talk\nend\n" and row["n"] == 2 and row["none"] is None
    assert row["page"] == "x\n# Two\nlines pic [a]\n> long talk<br/>> YAHOO! groups links here<br>end\nONElist is THE place"


def _strict(text):
    def unique(pairs):
        if len(dict(pairs)) < len(pairs):
            raise ValueError("key")
        return dict(pairs)

    def refuse(_):
        raise ValueError("constant")

    try:
        json.loads(text, object_pairs_hook=unique, parse_constant=refuse)
        return True
    except ValueError:
        return False


def test_strict_json_against_a_plain_reader(spark):
    rng = random.Random(7)
    parts = ["{", "}", "[", "]", ",", ":", '"a"', '"b"', '"\\u0061"', "1", "null", "NaN", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    texts += ['{"a":1,"b":{"a":2}}', '{"a":{"b":1,"b":1}}', '[{"a":1,"a":1}]', '{"a":1} x', "1] , [2", '1,"value":2', "1}, {", "", "[1, 2]", '{"a": [1, {"b": null}]}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.strict_json("t").isNotNull().alias("ok")).collect()
    assert [(r["t"], _strict(r["t"])) for r in rows if r["ok"] != _strict(r["t"])] == []
    assert any(r["ok"] for r in rows) and not all(r["ok"] for r in rows)


def _reads(captures, scans, most_reads, most_bytes):
    own, out, size = {}, [], 0
    for c in captures:
        own.setdefault(c[0], []).append(c)
    for _, group in sorted(own.items(), key=lambda x: (-max((c[4] for c in x[1] if c[4] is not None), default=-1), x[0])):
        fresh = sorted(c for c in group if (c[2], c[1]) not in scans)
        if max((c[4] for c in group if c[4] is not None), default=-1) < G.GRADE or size + sum(c[3] for c in group) > most_bytes:
            continue
        for c in fresh[: most_reads - len(out)]:
            out.append(c[1])
            size += c[3]
        if len(out) >= most_reads or size >= most_bytes:
            break
    return sorted(out)


def test_reads_are_those_of_a_walk(spark):
    rng = random.Random(8)
    for _ in range(6):
        captures = [(rng.randrange(25), f"p{k}", f"h{k % 40}", rng.randrange(1, 60), rng.choice([None, 0, 2, 3, 4])) for k in range(60)]
        scans = {(c[2], c[1]) for c in captures if rng.random() < 0.3}
        most_reads, most_bytes = rng.choice([1, 5, 20, 100]), rng.choice([1, 90, 400, 10_000])
        frame = spark.createDataFrame(captures, "candidate long, path string, sha256 string, bytes long, grade int")
        found = G.reads(frame, spark.createDataFrame([*scans, ("zz", "zz")], "sha256 string, path string"), most_reads, most_bytes)
        assert sorted(r["path"] for r in found.collect()) == _reads(captures, scans, most_reads, most_bytes)
    assert G.reads(frame.limit(0), frame.select("sha256", "path"), 5, 5).count() == 0
