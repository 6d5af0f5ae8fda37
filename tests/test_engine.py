"""The approximate index against exact search, and random requests against an evaluator that reads row by row."""

import json
import random
import re

import numpy as np
import pytest

from tidemark.operators import ann as N
from tidemark.operators import phrases as P
from tidemark.operators import requests as Q
from tidemark.operators import vectors as V
from tidemark.plans import engine


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_index(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    exact = V.nearest(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query"), "vec_id", "embedding", 10).withColumnRenamed("vec_id", "id")
    got = N.recall(engine.q21_index_search(spark, f"/root/testdata/{sf}"), exact, 10).agg({"strict": "avg", "ties": "avg"}).first()
    assert min(got) >= 0.9


def test_index_on_edges(spark, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 20)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    x[50:120] = x[50]  # one hot cell of equal vectors
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, [0.0] * 4), (501, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    cells = N.fit(df, "id", "v", 6)
    indexed = N.index(df, "id", "v", cells).checkpoint()
    assert indexed.count() == 200 and indexed.select("cell").distinct().count() > 3
    found = N.search(indexed, df.where("id IN (3, 50, 60, 500)"), "id", "v", cells, 5, probes=6).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (3, 50, 60):
        score = np.round(unit.astype(np.float32) @ unit[q].astype(np.float32), 6)
        got = sorted((r.rank, round(r.score, 5)) for r in found if r.query == q)
        assert [s for _, s in got] == [round(float(s), 5) for s in sorted(score, reverse=True)[:5]]
    assert {r.query for r in found} == {3, 50, 60} and [r.id for r in sorted(found, key=lambda r: r.rank) if r.query == 60] == [50, 51, 52, 53, 54]
    centres = rng.normal(size=(6, 4)) * 9
    near = spark.createDataFrame([(k, (centres[k % 6] + rng.normal(size=4) / 50).tolist()) for k in range(300)], "id long, v array<double>")
    cells = N.fit(near, "id", "v", 6)
    assert N.probes_for(N.index(near, "id", "v", cells), near, "id", "v", cells, 10) <= 2
    none = N.fit(df.limit(0), "id", "v", 6)
    assert N.search(N.index(df.limit(0), "id", "v", none), df.limit(0), "id", "v", none, 5, 1).count() == 0


SCHEMA = Q.Schema({"id": Q.NUMBER, "tag": Q.KEYWORD, "size": Q.NUMBER, "day": Q.DATE, "body": Q.TEXT}, "id")


def words(text):
    return re.findall("[0-9a-z]+", (text or "").lower())


def holds(clause, row):
    """What a clause means, for one row."""
    (name, body), = clause.items()
    if name == "match_all":
        return True
    if name == "ids":
        return str(row["id"]) in map(str, body["values"])
    if name == "exists":
        return row[body["field"]] is not None
    if name == "bool":
        part = lambda k: [holds(c, row) for c in body.get(k, [])]
        least = body.get("minimum_should_match", 1 if body.get("should") and not body.get("must") and not body.get("filter") else 0)
        return all(part("must")) and all(part("filter")) and not any(part("must_not")) and sum(part("should")) >= least
    (field, value), = body.items()
    own = row[field]
    if name == "match":
        asked = words(value["query"])
        return bool(asked) and (all if value["operator"] == "and" else any)(w in words(own) for w in asked)
    if name == "match_phrase":
        asked, has = words(value), words(own)
        return bool(asked) and any(has[k : k + len(asked)] == asked for k in range(len(has)))
    if own is None:
        return False
    if name == "term":
        return own == value
    if name == "terms":
        return own in value
    if name == "prefix":
        return own.startswith(value)
    return all({"gte": own >= v, "lte": own <= v, "gt": own > v, "lt": own < v}[k] for k, v in value.items())


def clause(rng, depth):
    kind = rng.choice(("bool", "bool", "term", "terms", "range", "day", "exists", "prefix", "match", "phrase", "ids", "all"))
    if kind == "bool" and depth < 4:
        body = {k: [clause(rng, depth + 1) for _ in range(rng.randrange(1, 3))] for k in ("must", "filter", "should", "must_not") if rng.random() < 0.4}
        if rng.random() < 0.3:
            body["minimum_should_match"] = rng.randrange(3)
        return {"bool": body}
    text = " ".join(rng.choices(("red", "Blue", "the", "x", "..."), k=rng.randrange(1, 3)))
    return rng.choice((
        {"term": {"tag": rng.choice("abc")}}, {"terms": {"size": [rng.randrange(9), rng.randrange(9)]}}, {"range": {"size": {rng.choice(("gte", "gt")): rng.randrange(9), "lt": 8}}},
        {"range": {"day": {"lte": f"2024-01-0{rng.randrange(1, 9)}"}}}, {"exists": {"field": rng.choice(("tag", "day", "body"))}}, {"prefix": {"tag": rng.choice(("a", "", "b"))}},
        {"match": {"body": {"query": text, "operator": rng.choice(("or", "and"))}}}, {"match_phrase": {"body": text}}, {"ids": {"values": [1, "2", 30]}}, {"match_all": {}},
    ))


def test_random_requests_give_the_evaluators_rows(spark):
    rng = random.Random(9)
    maybe = lambda x: None if rng.random() < 0.15 else x
    rows = [{"id": k, "tag": maybe(rng.choice(("a", "ab", "b", "c"))), "size": maybe(rng.randrange(9)), "day": maybe(f"2024-01-0{rng.randrange(1, 9)}"), "body": maybe(" ".join(rng.choices(("Red", "blue", "the", "x-y"), k=4)))} for k in range(60)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, tag string, size int, day string, body string").coalesce(1).cache()
    for _ in range(60):
        asked = {"query": clause(rng, 1), "post_filter": clause(rng, 2), "sort": [{"size": rng.choice(("asc", "desc"))}], "size": 20, "from": rng.choice((0, 5))}
        found = Q.compiled(json.dumps(asked), SCHEMA)
        hits = [r for r in rows if holds(asked["query"], r)]
        down = asked["sort"][0]["size"] == "desc"
        shown = sorted((r for r in hits if holds(asked["post_filter"], r)), key=lambda r: (r["size"] is None, (-r["size"] if down else r["size"]) if r["size"] is not None else 0, r["id"]))
        assert [r.id for r in Q.rows_of(found, df, SCHEMA).collect()] == [r["id"] for r in shown][asked["from"] : asked["from"] + 20], asked
        assert Q.total(found, df).first().total == len(hits)


@pytest.mark.parametrize("asked", [
    "[]", "{", '{"query": {"match_all": {}, "match_all": {}}}', {"script": 1}, {"query": {"script": {}}}, {"query": {"term": {"secret": 1}}}, {"query": {"term": {"body": "x"}}}, {"query": {"term": {"size": True}}},
    {"query": {"term": {"size": float("nan")}}}, {"query": {"range": {"size": {"above": 1}}}}, {"query": {"range": {"size": {}}}}, {"query": {"range": {"day": {"gte": "2024-13-01"}}}}, {"query": {"terms": {"tag": []}}},
    {"query": {"terms": {"tag": ["a"] * 1001}}}, {"query": {"match": {"body": {"query": "x", "operator": "xor"}}}}, {"query": {"match": {"body": "x" * 601}}}, {"query": {}}, {"query": {"bool": {"may": []}}}, {"query": {"prefix": {"size": "1"}}},
    {"size": 101}, {"size": -1}, {"from": 990, "size": 20}, {"sort": [{"size": "up"}]}, {"sort": [{"body": "asc"}]}, {"sort": [{"size": "asc"}] * 4}, {"fields": ["secret"]}, {"query": {"ids": {"values": [True]}}},
    {"query": {"bool": {"must": [{"match_all": {}}] * 160}}}, {"query": {"bool": {"minimum_should_match": "75%"}}},
])
def test_refused_requests(asked, spark):
    with pytest.raises(Q.Refused):
        Q.compiled(asked, SCHEMA)


def test_limits_hold_exactly(spark):
    Q.compiled({"query": {"bool": {"must": [{"match_all": {}}] * 158}}}, SCHEMA)
    deep = {"match_all": {}}
    for _ in range(7):
        deep = {"bool": {"must": [deep]}}
    Q.compiled({"query": deep}, SCHEMA)
    with pytest.raises(Q.Refused):
        Q.compiled({"query": {"bool": {"must": [deep]}}}, SCHEMA)


def test_phrases_are_shuffled_once(spark):
    rows = [(k, f"s{k % 2}", "a b c d a b c") for k in range(4)] + [(3, "s1", "a b c"), (9, "s0", "x y"), (10, "s1", None)]
    found = P.frequent(spark.createDataFrame(rows, "p long, s string, t string"), "p", "s", "t", 3, 4)
    assert {tuple(r) for r in found.collect()} == {(x, 4, 2, 2) for x in ("a b c", "b c d", "c d a", "d a b")}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1
