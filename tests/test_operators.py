"""Operators on small fixtures: nulls, ties, empty tables, edges."""

import itertools
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators import facets as A
from tidemark.operators import fusion as R
from tidemark.operators import history as H
from tidemark.operators import lexical as L
from tidemark.operators import passages as P
from tidemark.operators import vectors as V
from tidemark.sources import tables as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_terms_skip_null_and_empty(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("b",)], "x string")
    assert rows(A.terms(df, "x").select("value", "n")) == [("a", 2), ("b", 1)]
    tags = spark.createDataFrame([(["a", "a", "b"],), ([],), (None,)], "x array<string>")
    assert rows(A.terms(tags, "x").select("value", "n")) == [("a", 1), ("b", 1)]


def test_total_says_when_it_stops(spark):
    assert rows(A.total(spark.range(1001))) == [(1001, "eq")]
    assert rows(A.total(spark.range(1002))) == [(1001, "gte")]
    assert rows(A.total(spark.range(0))) == [(0, "eq")]


def test_last_page_of_the_window(spark):
    page = A.page(spark.range(1500), F.asc("id"), offset=990, limit=50).select("id", "has_more", "next_offset", "limit_reached")
    assert rows(page)[0] == (990, True, None, True) and page.count() == 10


def test_groups_keep_the_first_hit(spark):
    hits = spark.createDataFrame([(1, "a", 3), (2, "b", 1), (3, "a", 2)], "id int, k string, rank int")
    assert rows(A.groups(hits, "k").select("k", "id", "matches")) == [("a", 3, 2), ("b", 2, 1)]


def test_latest_and_upsert(spark):
    stored = spark.createDataFrame([(1, 5, "x"), (2, 5, "x")], "k int, version int, v string")
    changes = spark.createDataFrame([(1, 5, "y"), (2, 6, "y"), (3, 0, None)], "k int, version int, v string")
    assert rows(H.upsert(stored, changes, ["k"], "version")) == [(1, 5, "x"), (2, 6, "y"), (3, 0, None)]
    assert rows(H.latest(stored.union(changes), ["k"], "version").select("k", "version")) == [(1, 5), (2, 6), (3, 0)]
    assert H.create_only(stored, changes, ["k"]).select("k").collect()[0].k == 3
    swaps = H.swapped(stored, spark.createDataFrame([(1, 5, "x"), (2, 4, "x"), (9, 1, None)], "k int, version int, v string"), "k", ["version", "v"])
    assert rows(swaps.select("k", "applied")) == [(1, True), (2, False), (9, False)]


def test_query_syntax(spark):
    df = spark.createDataFrame([(1, "red green blue"), (2, "red"), (3, "green red"), (4, ""), (5, None)], "id int, t string")
    found = lambda q: [r.id for r in df.where(L.matches(X.words("t"), q)).orderBy("id").collect()]
    assert found("red green") == [1, 3]
    assert found('"red green"') == [1]
    assert found("red -green") == [2]
    assert found("blue | green") == [1, 3]
    assert found("red green blue yellow black") == [1]
    assert found("red NOT (green OR blue)") == [2]
    assert found("") == [1, 2, 3, 4, 5]


def test_bm25_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert L.bm25(none, asked, "doc_id", "text", "item_id", "text").count() == 0


def test_rerank_keeps_unscored_places(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 2, None), (0, 3, 5.0), (0, 4, 9.0)], "q int, rank long, s double").withColumn("id", F.col("rank"))
    assert {r.id: r["rank"] for r in R.reranked(df, "s", ["q"], 3).collect()} == {3: 1, 2: 2, 1: 3, 4: 4}


def test_fusion_ties_go_by_key(spark):
    a = spark.createDataFrame([("b", 1), ("a", 2)], "k string, rank long")
    b = spark.createDataFrame([("a", 1), ("b", 2)], "k string, rank long")
    assert [r.k for r in R.rrf([a, b], "k").orderBy("rank").collect()] == ["a", "b"]


def test_nearest_with_zero_vectors_and_ties(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "id long, v array<float>")
    got = [(r.id, round(r.score, 6)) for r in V.nearest(df, [(9, [3.0, 0.0])], "id", "v", 3, floor=-0.5).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 1.0), (4, 0.0)]
    assert rows(V.mean_vectors(df.where("id in (1, 4)").withColumn("k", F.lit(1)), "k", "v"))[0][1][0] - math.sqrt(0.5) < 1e-9


def test_urls(spark):
    cases = [
        ("HTTP://Www.Example.com:80/a/../b?x=1#f", "http://www.example.com/a/../b?x=1"), ("https://h.org", "https://h.org/"), ("ftp://h.org/", None),
        ("http://u:p@h.org/", None), ("http://h.org/a b", None), ("https://a.org/web/20010101000000/http://b.com/p", "http://b.com/p"), (None, None),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string")
    assert [r.c for r in df.select("i", U.canonical("u").alias("c")).orderBy("i").collect()] == [c for _, c in cases]
    assert "www.h.org:443" in U.aliases("www.h.org")


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab \n", max_size=60), max_size=6))
def test_chunks_cover_every_token(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = P.chunks(df, "id", "t", budget=5, overlap=2)
    assert P.plan_faults(found, "id", 5).count() == 0
    for i, own in itertools.groupby(sorted(found.collect(), key=lambda r: (r.id, r.passage)), key=lambda r: r.id):
        own, words = list(own), texts[i].split()
        assert own[-1].end == len(words) and all(r.body == " ".join(words[r.start : r.end]) for r in own)


def test_links_resolve_against_the_base(spark):
    page = '<base href="http://h.org/d/"><p>see <a href=\'x?q=1&amp;r#f\'>the x</a><a href="mailto:a@b.c">m</a><iframe src=/y></iframe>'
    df = spark.createDataFrame([(1, "http://g.org/", page), (2, None, None)], "id long, u string, h string")
    assert rows(P.links(df, "id", "u", "h").select("target", "anchor")) == [("http://h.org/d/x?q=1&r", "the x"), ("http://h.org/y", "")]


def test_messages_and_mails(spark):
    files = spark.createDataFrame([("a", "From: x@y\nSubject: Hi\n\nbody\n\nmore"), ("b", "no header")], "path string, content string")
    assert rows(S.messages(files).select("path", "author", "subject", "sent", "body")) == [("a", "x@y", "Hi", None, "body\n\nmore"), ("b", None, None, None, "")]
    mail = spark.createDataFrame([("c", '{"ygData":{"messageBody":"m","from":"z","postDate":"0"}}'), ("d", "broken")], "path string, content string")
    got = rows(S.mails(mail).select("path", "author", F.unix_seconds("sent"), "body"))
    assert got == [("c", "z", 0, "m"), ("d", None, None, None)]


def test_captures_and_manifest(spark, tmp_path):
    (tmp_path / "websites/h/20000101000000").mkdir(parents=True)
    (tmp_path / "websites/h/20000101000000/p.html").write_text("x")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/config").write_text("hidden")
    files = S.captures(spark, str(tmp_path)).select("sha256", *[c.alias(k) for k, c in S.capture_parts(F.col("path")).items()])
    assert [(r.host, r.captured, r.page) for r in files.collect()] == [("h", "20000101000000", "p.html")]


def test_phrase_and_markup_helpers(spark):
    df = spark.createDataFrame([("A [link](http://x.y) <b>to</b> a@b.cc &amp; me",)], "t string")
    r = df.select(X.plain("t").alias("p"), X.escaped("t").alias("e"), X.ngrams(X.words(F.lit("a b c")), 2).alias("n"), X.marked(F.lit("a.b A.B"), "a.b").alias("m"), X.ngrams(X.words(F.lit("a")), 3).alias("z")).first()
    assert r.p.split() == ["A", "link", "to", "me"] and "&lt;b&gt;" in r.e and r.n == ["a b", "b c"] and r.m == "<em>a.b</em> <em>A.B</em>" and r.z == []


def test_overlap_best_takes_every_item(spark):
    docs = spark.createDataFrame([(1, "s", "red green"), (2, "s", "green blue blue"), (3, None, "x"), (4, "s", None)], "doc_id long, source string, text string")
    items = spark.createDataFrame([(k, t) for k, t in ((0, "red"), (7, "Green, blue"), (40, "no one"), (41, None))], "item_id long, text string")
    got = rows(L.overlap_best(docs, items, "doc_id", "source", "text", "item_id", "text"))
    assert got == sorted([(0, "s", 3, 1), (7, "s", 9, 2), (40, "s", 0, 1), (41, "s", 0, 1), *((k, None, 0, 3) for k in (0, 7, 40, 41))], key=repr)


def test_nearest_takes_queries_as_a_table(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 8)
    monkeypatch.setattr(V, "SLICE", 16)
    df = spark.range(100).select("id", F.array(F.cos("id"), F.sin("id")).alias("v"))
    asked = df.where("id % 5 = 0").withColumnRenamed("id", "query")
    got = rows(V.nearest(df, asked, "id", "v", 3).select("query", "rank", "id"))
    near = lambda q: sorted(range(100), key=lambda i: (-round(math.cos(i - q), 9), i))[:3]
    assert got == sorted([(q, r + 1, i) for q in range(0, 100, 5) for r, i in enumerate(near(q))], key=repr)
    assert V.nearest(df, asked.limit(0), "id", "v", 3).count() == V.nearest(df.limit(0), asked, "id", "v", 3).count() == 0


def test_query_lexemes():
    assert L.signed('red AND "a OR b" OR (blue NOT green)') == 'red + "a OR b" | ( blue -green )'
    assert [L.constrained(q) for q in ("red green", "red-green", "red -green", '"red"', "a | b", "c++", "")] == [False, False, True, True, True, True, False]


def test_open_brackets_and_quotes(spark):
    df = spark.createDataFrame([(1, "red green"), (2, "blue")], "id int, t string")
    found = lambda q: [r.id for r in df.where(L.matches(X.words("t"), q)).orderBy("id").collect()]
    assert found("(red") == found('"red green') == found("red)") == found("red | ") == [1]
    assert found("- ") == [1, 2] and found("-red") == [2]


def test_lineage_of_cycles_and_long_chains(spark):
    rows = [(k, k - 1) for k in range(1, 131)] + [(0, None), (200, 201), (201, 200), (300, 999), (400, 400)]
    got = dict(map(tuple, H.lineage(spark.createDataFrame(rows, "k long, p long"), "k", "p", 100).collect()))
    assert got == {k: k if k <= 100 else None for k in range(131)} | {200: None, 201: None, 300: 0, 400: None}


def test_a_stream_resumes_and_drops_late_rows(spark, tmp_path):
    from tidemark.streaming import events as S

    def write(name, rows):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).toPandas().to_parquet(tmp_path / "in" / f"events{name}.parquet", coerce_timestamps="us")

    row = lambda k, day: (k, f"2024-01-{day:02} 12:00:00", 1, "view", 1.0, "{}")
    run = lambda: {str(r.start)[:10]: r.n for r in S.drained(S.windowed_counts(S.event_stream(spark, str(tmp_path / "in")), "1 day", late="2 days"), "append", folder=str(tmp_path / "work")).collect()}
    (tmp_path / "in").mkdir()
    write(1, [row(1, 1), row(2, 1), row(3, 5)])
    assert run() == {"2024-01-01": 2}
    write(2, [row(4, 1), row(5, 4), row(6, 9)])
    assert run() == {"2024-01-01": 2, "2024-01-04": 1, "2024-01-05": 1}
    assert run() == {"2024-01-01": 2, "2024-01-04": 1, "2024-01-05": 1}
