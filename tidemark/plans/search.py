"""Lexical, vector and fused search, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import facets as A
from tidemark.operators import fusion as R
from tidemark.operators import lexical as L
from tidemark.operators import vectors as V
from tidemark.plans.registry import query
from tidemark.sources.tables import table
from tidemark.storage import cut

TOKENS = "regexp_extract_all(lower(text), '[0-9a-z]+')"
_BM25 = f"""d AS (SELECT doc_id, {TOKENS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
    p AS (SELECT doc_id, len(w) AS length, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), q AS (SELECT item_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark),
    b AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
          FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY 1, 2),
    r AS (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b)"""


def lexical_top(spark, folder, k: int) -> DataFrame:
    return _best(_found(spark, folder, k, False).withColumn("score", F.round("score", 6)).select("item_id", "doc_id", "score"), "score", k)


def _found(spark, folder, k: int, counts: bool) -> DataFrame:
    asked = L.asked_terms(table(spark, folder, "benchmark"), "item_id", "text")
    index = L.postings(table(spark, folder, "documents"), asked, "doc_id", "text")
    return L.candidates(index, asked, "doc_id", "item_id", k, counts)


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10")
def q01_bm25(spark, folder):
    return lexical_top(spark, folder, 10)


@query(f"""SELECT doc_id, 'or' AS kind FROM (SELECT doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS t FROM documents)
      WHERE CAST(contains(t, ' the ') AS INT) + CAST(contains(t, ' from ') AS INT) + CAST(contains(t, ' with ') AS INT) + CAST(contains(t, ' der ') AS INT) + CAST(contains(t, ' les ') AS INT) >= 3
    UNION ALL SELECT doc_id, 'and' FROM (SELECT doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS t FROM documents) WHERE contains(t, ' of the ') AND (contains(t, ' from ') OR contains(t, ' by ')) AND NOT contains(t, ' this ')""")
def f14_simple_query(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", X.words("text").alias("tokens"))
    kinds = {"or": "the from with der les", "and": '"of the" AND (from OR by) NOT this'}
    flags = F.array_compact(F.array(*[F.when(L.matches(F.col("tokens"), q), k) for k, q in kinds.items()]))
    return docs.select("doc_id", F.explode(flags).alias("kind"))


@query(f"""SELECT doc_id, greatest(CAST(contains(t, ' the ') AS INT) + CAST(contains(t, ' and ') AS INT), 3 * CAST(lang = 'en' AS INT)) AS best, regexp_matches(t, ' of th[0-9a-z]*') AS prefix
    FROM (SELECT doc_id, lang, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS t FROM documents)""")
def f18_multi_match(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", X.spaced(X.words("text")).alias("t"))
    in_text = F.contains("t", F.lit(" the ")).cast("int") + F.contains("t", F.lit(" and ")).cast("int")
    return docs.select("doc_id", F.greatest(in_text, 3 * (F.col("lang") == "en").cast("int")).alias("best"), F.contains("t", F.lit(" of th")).alias("prefix"))


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS w FROM embeddings)
    SELECT query, vec_id, round(list_cosine_similarity(v, w), 6) AS score FROM q, e QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(v, w), 9) DESC, vec_id) <= 10""")
def q02_nearest(spark, folder):
    rows = table(spark, folder, "embeddings")
    asked = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query")
    return V.nearest(rows, asked, "vec_id", "embedding", 10).select("query", "vec_id", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), e AS (SELECT vec_id, label % 4 AS label, embedding::DOUBLE[] AS w FROM embeddings),
    s AS (SELECT query, vec_id, label, round(list_cosine_similarity(v, w), 9) AS score FROM q, e), r AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query, vec_id, round(sum((score * CASE label WHEN 0 THEN 30 WHEN 1 THEN 20 ELSE 10 END)::DECIMAL(38,12)), 5)::DOUBLE AS score FROM r WHERE rank <= 20 AND score >= 0 GROUP BY 1, 2""")
def q03_field_fan_out(spark, folder):
    rows = table(spark, folder, "embeddings")
    asked = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query")
    legs = [(V.nearest(rows.where(F.col("label") % 4 == k), asked, "vec_id", "embedding", 20, floor=0.0), boost) for k, boost in enumerate((30.0, 20.0, 10.0, 10.0))]
    return R.boosted(legs, "vec_id", ["query"]).withColumn("score", F.round("score", 5).cast("double"))


@query("""SELECT label, round(sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS size, round(m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS first FROM
    (SELECT label, list(mean ORDER BY place) AS m FROM (SELECT label, place, avg(x::DOUBLE) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY 1, 2) GROUP BY 1)""")
def a28_mean_vector(spark, folder):
    rows = table(spark, folder, "embeddings")
    means = V.mean_vectors(rows, "label", "embedding").select("label", F.round(F.element_at("mean", 1), 6).alias("first"))
    places = rows.select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.join(places.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("size")), "label")


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS square, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) BETWEEN 0.9 AND 1.1 AS is_unit FROM embeddings")
def m01_norms(spark, folder):
    v = F.col("embedding")
    return table(spark, folder, "embeddings").select("vec_id", F.round(V.dot(v, v), 5).alias("square"), V.unit(v).alias("is_unit"))


_LEGS = f"""{_BM25}, l AS (SELECT item_id, doc_id, rank FROM r WHERE rank <= 100),
    o AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, count(*) AS n FROM q JOIN p USING (term) GROUP BY 1, 2) QUALIFY rank <= 100),
    u AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM o) GROUP BY 1, 2)"""


def _legs(spark, folder, k: int) -> list[DataFrame]:
    """The k best by BM25 and by shared terms, both from one pass over one table of postings."""
    found = cut(_found(spark, folder, k, True))
    scored = found.select("item_id", "doc_id", F.round("score", 6).alias("score"))
    return [_best(scored, "score", k), _best(found.select("item_id", "doc_id", "n"), "n", k)]


def _best(found: DataFrame, by: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(by), "doc_id")).cast("bigint")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


@query(f"WITH {_LEGS} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM u QUALIFY rank <= 20")
def q06_rank_fusion(spark, folder):
    return R.rrf(_legs(spark, folder, 100), "doc_id", ["item_id"]).where("rank <= 20")


@query(f"""WITH {_LEGS}, h AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM u QUALIFY rank <= 20),
    t AS (SELECT item_id, doc_id, rank, 1 AS segment FROM l ANTI JOIN h USING (item_id, doc_id)), z AS (SELECT *, 0 AS segment FROM h UNION ALL SELECT * FROM t)
    SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY segment, rank, doc_id) AS rank FROM z""")
def o06_head_and_tail(spark, folder):
    lexical, overlap = _legs(spark, folder, 100)
    head = R.rrf([lexical, overlap], "doc_id", ["item_id"]).where("rank <= 20")
    return R.with_tail(head, lexical, "doc_id", ["item_id"])


@query(f"""WITH {_BM25}, t AS (SELECT item_id, doc_id, rank, CASE WHEN lang = 'en' THEN n_chars END AS s FROM r JOIN documents USING (doc_id) WHERE rank <= 30),
    k AS (SELECT *, s IS NOT NULL AND rank <= 20 AS takes FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY item_id, takes ORDER BY rank) AS slot, row_number() OVER (PARTITION BY item_id, takes ORDER BY s DESC, rank) AS ord FROM k)
    SELECT a.item_id, a.doc_id, CASE WHEN a.takes THEN b.rank ELSE a.rank END AS rank FROM n a LEFT JOIN n b ON a.takes AND b.takes AND a.item_id = b.item_id AND a.ord = b.slot""")
def q10_rerank(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("n_chars")).alias("s"))
    rows = lexical_top(spark, folder, 30).join(docs, "doc_id").select("item_id", "doc_id", "rank", "s")
    return R.reranked(rows, "s", ["item_id"], 20).select("item_id", "doc_id", "rank")


@query(f"""WITH {_BM25} SELECT item_id, arg_min(doc_id, rank) AS doc_id, source, min(rank) AS rank, count(*) AS matches FROM r JOIN documents USING (doc_id) WHERE rank <= 50 GROUP BY item_id, source""")
def q13_grouped_search(spark, folder):
    rows = lexical_top(spark, folder, 50).join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("item_id", "source").agg(F.min_by("doc_id", "rank").alias("doc_id"), F.min("rank").alias("rank"), F.count("*").alias("matches"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'blue b') ORDER BY p_name, p_partkey LIMIT 10")
def q19_autocomplete(spark, folder):
    return table(spark, folder, "part").where(F.startswith(F.lower("p_name"), F.lit("blue b"))).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(10)


@query("SELECT source, max(doc_id) AS latest, count(*) AS n FROM documents GROUP BY 1 ORDER BY latest DESC, source LIMIT 8")
def q20_recent_sites(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.max("doc_id").alias("latest"), F.count("*").alias("n")).orderBy(F.desc("latest"), "source").limit(8)


@query(f"WITH {_LEGS} SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, doc_id FROM l WHERE rank <= 10 UNION ALL SELECT item_id, doc_id FROM o WHERE rank <= 10)")
def q23_pool(spark, folder):
    legs = [x.where("rank <= 10").select("item_id", "doc_id") for x in _legs(spark, folder, 100)]
    return legs[0].union(legs[1]).distinct()


_GAIN = f"""{_BM25}, g AS (SELECT item_id, rank, coalesce(quality, 0) * 2 + coalesce(1 - toxic, 0) AS grade, quality IS NOT NULL AS judged FROM r LEFT JOIN labels USING (doc_id) WHERE rank <= 50)"""


@query(f"""WITH {_GAIN}, i AS (SELECT item_id, grade, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, rank) AS place FROM g),
    x AS (SELECT item_id, sum((power(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10) AS dcg, avg(judged::INT) AS judged FROM g GROUP BY 1), y AS (SELECT item_id, sum((power(2, grade) - 1) / log2(place + 1)) FILTER (place <= 10) AS ideal FROM i GROUP BY 1)
    SELECT item_id, round(dcg / nullif(ideal, 0), 6) AS ndcg, round(judged, 6) AS judged FROM x JOIN y USING (item_id)""")
def a29_ndcg(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", (F.col("quality") * 2 + 1 - F.col("toxic")).alias("grade"))
    rows = lexical_top(spark, folder, 50).join(labels, "doc_id", "left").select("item_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade"), F.col("grade").isNotNull().cast("int").alias("judged"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("grade"), "rank")))
    gain = lambda at: F.sum(F.when(F.col(at) <= 10, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col(at) + 1)))
    return rows.groupBy("item_id").agg(F.round(gain("rank") / F.nullif(gain("place"), F.lit(0.0)), 6).alias("ndcg"), F.round(F.avg("judged"), 6).alias("judged"))


@query(f"""WITH {_GAIN} SELECT item_id, count(*) FILTER (grade >= 2 AND rank <= 10)::DOUBLE / 10 AS precision, coalesce(round(1.0 / min(rank) FILTER (grade >= 2 AND rank <= 10), 6), 0)::DOUBLE AS mrr,
    round(count(*) FILTER (grade >= 2 AND rank <= 10) / nullif(count(*) FILTER (grade >= 2), 0)::DOUBLE, 6) AS recall FROM g GROUP BY 1""")
def a30_precision_mrr_recall(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", (F.col("quality") * 2 + 1 - F.col("toxic")).alias("grade"))
    rows = lexical_top(spark, folder, 50).join(labels, "doc_id", "left")
    good = F.col("grade") >= 2
    top = F.count_if(good & (F.col("rank") <= 10))
    mrr = F.round(F.lit(1.0) / F.min(F.when(good & (F.col("rank") <= 10), F.col("rank"))), 6)
    return rows.groupBy("item_id").agg((top / 10).alias("precision"), F.coalesce(mrr, F.lit(0.0)).alias("mrr"), F.round(top / F.nullif(F.count_if(good), F.lit(0)), 6).alias("recall"))


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS w FROM embeddings),
    a AS (SELECT query, vec_id FROM q, e QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(v, w), 9) DESC, vec_id) <= 10),
    b AS (SELECT query, vec_id FROM q, e QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(v[1:32], w[1:32]), 9) DESC, vec_id) <= 10)
    SELECT a.query, count(b.vec_id)::DOUBLE / 10 AS recall FROM a LEFT JOIN b ON a.query = b.query AND a.vec_id = b.vec_id GROUP BY 1""")
def a36_recall(spark, folder):
    rows = table(spark, folder, "embeddings")
    asked = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query")
    half = lambda x: x.withColumn("embedding", F.slice("embedding", 1, 32))
    exact, rough = V.nearest(rows, asked, "vec_id", "embedding", 10), V.nearest(half(rows), half(asked), "vec_id", "embedding", 10)
    met = rough.select("query", "vec_id", F.lit(1).alias("met"))
    return exact.join(met, ["query", "vec_id"], "left").groupBy("query").agg((F.count("met") / 10).alias("recall"))
