"""The approximate index and compiled search requests."""

from __future__ import annotations

import functools
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ann as N
from tidemark.operators import requests as Q
from tidemark.operators import vectors as V
from tidemark.plans.registry import query
from tidemark.sources.tables import table
from tidemark.storage import cut


def _index(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    cells = N.fit(rows, "vec_id", "embedding", cells=max(8, math.isqrt(min(N.SAMPLE, rows.count()))))
    return rows, cells, cut(N.index(rows, "vec_id", "embedding", cells))


@query()
def q21_index_search(spark, folder):
    """Ten nearest of every vector whose id is divisible by 50, by the index; tests measure its recall."""
    rows, cells, indexed = _index(spark, folder)
    probes = N.probes_for(indexed, rows, "vec_id", "embedding", cells, 10)
    return N.search(indexed, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", cells, 10, probes)


@query("SELECT vec_id AS query, 10::BIGINT AS hits, 1.0::DOUBLE AS strict, 1.0::DOUBLE AS ties FROM embeddings WHERE vec_id % 50 = 0")
def q21_full_probe(spark, folder):
    """With every cell probed the index finds the exact ten nearest."""
    rows, cells, indexed = _index(spark, folder)
    asked = rows.where("vec_id % 50 = 0")
    exact = V.nearest(rows, asked.withColumnRenamed("vec_id", "query"), "vec_id", "embedding", 10).withColumnRenamed("vec_id", "id")
    return N.recall(N.search(indexed, asked, "vec_id", "embedding", cells, 10, probes=len(cells.centres)), exact, 10)


SCHEMA = Q.Schema({"doc_id": Q.NUMBER, "lang": Q.KEYWORD, "source": Q.KEYWORD, "n_chars": Q.NUMBER, "text": Q.TEXT}, "doc_id")
# Requests as a browser sends them.
REQUESTS = {
    "terms": {"query": {"bool": {"filter": [{"terms": {"lang": ["de", "fr"]}}, {"range": {"n_chars": {"gte": 200, "lt": 2000}}}], "must_not": [{"term": {"source": "src1"}}]}}, "size": 100, "sort": [{"n_chars": "desc"}]},
    "words": {"query": {"bool": {"must": [{"match": {"text": {"query": "the and", "operator": "and"}}}], "should": [{"prefix": {"source": "src1"}}]}}, "post_filter": {"term": {"lang": {"value": "en"}}}, "size": 50, "from": 20},
    "should": {"query": {"bool": {"should": [{"match_phrase": {"text": "of the"}}, {"range": {"n_chars": {"gt": 5000}}}, {"ids": {"values": [1, "2", 3]}}], "minimum_should_match": 2}}, "sort": [{"lang": "asc"}, {"doc_id": "desc"}], "size": 100},
}
_WORDS = "regexp_extract_all(lower(text), '[0-9a-z]+')"
_HITS = {
    "terms": "lang IN ('de', 'fr') AND n_chars >= 200 AND n_chars < 2000 AND source <> 'src1' ORDER BY n_chars DESC, doc_id LIMIT 100",
    "words": "list_has_all(w, ['the', 'and']) AND lang = 'en' ORDER BY doc_id LIMIT 50 OFFSET 20",
    "should": "(contains(' ' || array_to_string(w, ' ') || ' ', ' of the '))::INT + (n_chars > 5000)::INT + (doc_id IN (1, 2, 3))::INT >= 2 ORDER BY lang, doc_id DESC LIMIT 100",
}


@query(f"WITH d AS (SELECT *, {_WORDS} AS w FROM documents) " + " UNION ALL ".join(f"(SELECT '{n}' AS request, doc_id, lang, source, n_chars FROM d WHERE {p})" for n, p in _HITS.items()))
def q17_compiled_requests(spark, folder):
    docs = table(spark, folder, "documents")
    pages = [Q.rows_of(Q.compiled(json.dumps(r), SCHEMA), docs, SCHEMA).select(F.lit(n).alias("request"), "doc_id", "lang", "source", "n_chars") for n, r in REQUESTS.items()]
    return functools.reduce(DataFrame.unionByName, pages)


@query(f"WITH d AS (SELECT *, {_WORDS} AS w FROM documents) SELECT 'terms' AS request, count(*) AS total FROM d WHERE {_HITS['terms'].split(' ORDER')[0]} UNION ALL SELECT 'words', count(*) FROM d WHERE list_has_all(w, ['the', 'and']) UNION ALL SELECT 'should', count(*) FROM d WHERE {_HITS['should'].split(' ORDER')[0]}")
def q17_request_totals(spark, folder):
    docs = table(spark, folder, "documents")
    return functools.reduce(DataFrame.unionByName, [Q.total(Q.compiled(r, SCHEMA), docs).select(F.lit(n).alias("request"), "total") for n, r in REQUESTS.items()])
