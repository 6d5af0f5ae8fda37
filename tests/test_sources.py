"""Feeds that come back or are broken, tree objects behind pushed filters."""

import contextlib
import hashlib
import io
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.sources import feeds as Fe
from tidemark.sources import trees as Tr

RSS = '<?xml version="1.0"?><rss version="2.0"><channel><title>News</title><item><title>A &amp; B</title><guid isPermaLink="true">http://a/1</guid><pubDate>Tue, 3 Jun 2003 09:39:21 GMT</pubDate><description>&lt;p&gt;one  &lt;b&gt;two&lt;/b&gt;&lt;/p&gt;</description></item><item><title>C</title><link>http://a/2</link></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>Blog</title><entry><title>X</title><link rel="self" href="s"/><link href="http://b/1"/><id>urn:1</id><updated>2003-12-13T18:30:02Z</updated><content><![CDATA[<i>hi</i>]]></content></entry></feed>'
RDF = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Old</title></channel><item><title>R</title><link>http://c/1</link><dc:date>2001-02-03T04:05:06+01:00</dc:date></item></rdf:RDF>'


def test_feeds_of_all_formats(spark):
    rows = [("rss", RSS), ("atom", ATOM), ("rdf", RDF), ("cut", RSS[:-30]), ("page", "<html><body><p>x</body>"), ("none", "<rss><channel><title>t</title></channel></rss>"), ("null", None)]
    got = {}
    for r in Fe.entries(spark.createDataFrame(rows, "k string, x string"), "k", "x").collect():
        got.setdefault(r.k, []).append(r)
    utc = [r.published for r in sorted(got["rss"], key=lambda r: r.entry)]
    assert [(r.title, r.link, r.identity, r.summary, r.entry, r.format) for r in got["rss"]] == [("A & B", "http://a/1", "http://a/1", "one two", 0, "rss"), ("C", "http://a/2", "http://a/2", None, 1, "rss")] and utc[1] is None
    assert [(r.title, r.link, r.identity, r.summary, r.feed_title) for r in got["atom"]] == [("X", "http://b/1", "urn:1", "hi", "Blog")]
    assert [(r.title, r.link, r.format, r.feed_title) for r in got["rdf"]] == [("R", "http://c/1", "rdf", "Old")]
    shown = spark.createDataFrame(rows, "k string, x string").where("k IN ('rss', 'atom', 'rdf')")
    text = {r.k: r.p for r in Fe.entries(shown, "k", "x").where("published IS NOT NULL").select("k", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("p")).collect()}
    assert text == {"rss": "2003-06-03 09:39:21", "atom": "2003-12-13 18:30:02", "rdf": "2001-02-03 03:05:06"}
    assert all(got[k][0].broken and got[k][0].entry is None and len(got[k]) == 1 for k in ("cut", "page"))
    assert [(r.entry, r.broken) for r in got["none"] + got["null"]] == [(None, False)] * 2


def write_trees(spark, tmp_path, trees):
    at = str(tmp_path / uuid.uuid4().hex)
    spark.createDataFrame([(t, bytearray(c) if c is not None else None) for t, c in trees], "tree string, content binary").write.parquet(at)
    return at


def test_tree_objects_behind_filters(spark, tmp_path):
    oid = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    blob = lambda mode, name, o: f"{mode} {name}".encode() + b"\0" + bytes.fromhex(o)
    trees = {
        "r": blob("100644", "a b.txt", oid(1)) + blob("40000", "dir", "ab" * 20) + blob("120000", "link", "0020" * 10) + blob("100755", "é", oid(2)),
        "ab" * 20: blob("100644", "x", oid(3)) + blob("40000", "deep", "cd" * 20), "cd" * 20: blob("100644", "y", oid(4)), "empty": b"", "null": None,
    }
    at = write_trees(spark, tmp_path, trees.items())
    found = Tr.tree_entries(spark, at)
    assert found.count() == 7 and [(r.place, r.name, r.mode, r.oid) for r in found.where("tree = 'r'").orderBy("place").collect()] == [
        (0, "a b.txt", "100644", oid(1)), (1, "dir", "40000", "ab" * 20), (2, "link", "120000", "0020" * 10), (3, "é", "100755", oid(2))]
    wanted = "mode IN ('100644', '100755') AND tree <> 'r' AND name = 'x'"
    some = Tr.scan(spark, at, pushed=True).where(wanted)
    assert [r.oid for r in some.collect()] == [r.oid for r in Tr.tree_entries(spark, at, wanted).collect()] == [r.oid for r in found.where(wanted).collect()] == [oid(3)]
    with contextlib.redirect_stdout(io.StringIO()) as said:
        some.explain("formatted")
    plan = said.getvalue()
    assert "PushedFilters: [In(mode, [100644,100755]), EqualTo(name,x)]" in plan
    condition = re.search(r"Condition : (.*)", plan)[1]
    assert "100644" not in condition and "= x" not in condition  # what was pushed is not filtered again
    roots = spark.createDataFrame([("r",), ("empty",), ("absent",)], "root string")
    paths = {(r.root, r.path, r.complete) for r in Tr.listing(found, roots).collect()}
    assert paths == {("r", p, True) for p in ("a b.txt", "dir/x", "dir/deep/y", "link", "é")}
    assert {(r.path, r.complete) for r in Tr.listing(found, roots, most=2).collect()} == {("a b.txt", False), ("dir/deep/y", False)}


def test_cut_off_and_looping_trees(spark, tmp_path):
    loop = b"40000 again\0" + bytes.fromhex("11" * 20) + b"100644 f\0" + bytes.fromhex("22" * 20)
    found = Tr.tree_entries(spark, write_trees(spark, tmp_path, [("11" * 20, loop)]))
    assert Tr.listing(found, spark.createDataFrame([("11" * 20,)], "root string"), depth=4).count() == 4
    with pytest.raises(ValueError):
        list(Tr.entries(loop[:-1]))
    assert list(Tr.entries(b"")) == []
    assert Tr.tree_entries(spark, write_trees(spark, tmp_path, [])).count() == 0


def test_tree_names_are_those_of_the_format(spark):
    content = b"100644 a\0" + bytes.fromhex("33" * 20)
    row = spark.range(1).select(Tr.entry("100644", F.lit("a"), F.lit("33" * 20)).alias("c")).select("c", Tr.tree_oid(F.col("c")).alias("o")).first()
    assert bytes(row.c) == content and row.o == hashlib.sha1(b"tree %d\0" % len(content) + content).hexdigest()
