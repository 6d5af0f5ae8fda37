"""Passages by distance of sentences, and assets, against plain versions and hard pages."""

import math
import random
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import assets as A
from tidemark.operators import semantic as S


def test_chunks_against_a_plain_version(spark):
    rng = random.Random(3)
    docs = {k: [(p, f"s{p}.", [float(rng.choice([0, 0, 1, 2])) for _ in range(3)]) for p in range(rng.choice([1, 2, 3, 30, 60]))] for k in range(25)}
    docs[99] = [(p, "same.", [1.0, 1.0, 1.0]) for p in range(50)]
    rows = spark.createDataFrame([(k, *x) for k, own in docs.items() for x in own], "doc long, place int, sentence string, v array<double>")
    found = {(r["doc"], r["chunk"]): r["body"] for r in S.chunks(rows, "doc", "v", 0.9).collect()}
    expected = {}
    for k, own in docs.items():
        gaps = []
        for (_, _, a), (_, _, b) in zip(own, own[1:]):
            size = math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b))
            gaps.append(round(1 - np.dot(a, b) / size, 9) if size else 1.0)
        bound, chunk, parts = round(float(np.percentile(gaps, 90)), 9) if gaps else 0, 0, {0: [own[0][1]]}
        for g, (_, s, _) in zip(gaps, own[1:]):
            chunk += g > bound
            parts.setdefault(chunk, []).append(s)
        expected |= {(k, c): " ".join(p) for c, p in parts.items()}
    assert found == expected and (99, 1) not in found


def test_sentences(spark):
    rows = spark.createDataFrame([(1, "One. Two?  Three!\nfour 3.5 x"), (2, None), (3, ""), (4, "  ")], "k int, t string")
    found = [(r["k"], r["sentence"], r["context"]) for r in S.sentences(rows, "k", "t").orderBy("k", "place").collect()]
    assert found[:4] == [(1, "One.", "One. Two?"), (1, "Two?", "One. Two? Three!"), (1, "Three!", "Two? Three! four 3.5 x"), (1, "four 3.5 x", "Three! four 3.5 x")]


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = set()

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag in A.SRC and own.get("src"):
            self.found.add(own["src"])
        if tag == "link" and set((own.get("rel") or "").lower().split()) & set(A.RELATIONS) and own.get("href"):
            self.found.add(own["href"])
        self.found |= {own[x] for x in ("background", "poster") if own.get(x)}


def test_assets_against_a_parser(spark):
    rng = random.Random(4)

    def tag(n):
        quote = lambda v: rng.choice([f'"{v}"', f"'{v}'", v])
        own = [f"{rng.choice(['src', 'SRC', 'href', 'background', 'poster', 'data-src', 'title'])}={quote(f'/f{n}_{k}')}" for k in range(rng.randrange(3))]
        if rng.random() < 0.4:
            own.append(f"rel={quote(rng.choice(['icon', 'next', 'Stylesheet']))}")
        names = {x.split("=")[0].lower() for x in own}
        return "" if len(names) < len(own) else f"<{rng.choice(['img', 'LINK', 'p', 'embed', 'table'])}{rng.choice([' ', chr(10)])}{' '.join(own)}{rng.choice(['', ' ', ' alt=\"a > b\"'])}>"

    pages = {k: "".join(tag(n) + "text" for n in range(rng.randrange(12))) for k in range(120)}
    rows = spark.createDataFrame([(k, "http://a.org/", h) for k, h in pages.items()], "k int, u string, h string")
    found = {}
    for r in A.assets(rows, "k", "u", "h").collect():
        found.setdefault(r["k"], set()).add(r["asset"].removeprefix("http://a.org"))
    for k, h in pages.items():
        plain = _Plain()
        plain.feed(h)
        assert found.get(k, set()) == plain.found, h


def test_hard_pages(spark):
    rows = spark.createDataFrame([
        (1, "http://a.org/x/", None), (2, None, '<img src="/a">'), (3, "http://a.org/x/", ""), (4, "http://a.org/", "<img " + "word " * 60_000), (5, "http://a.org/", "<b " + "x='1' " * 20_000),
        (6, "http://a.org/", '<base href="http://b.org/c/"><img src="d.png">'), (7, "http://a.org/x/", "<img src=e.png><img src=e.png#f>" * 3)], "k int, u string, h string")
    assert sorted(map(tuple, A.assets(rows, "k", "u", "h").collect())) == [(6, "http://b.org/c/d.png"), (7, "http://a.org/x/e.png")]
    assert A.assets(rows.where(F.lit(False)), "k", "u", "h").count() == 0
