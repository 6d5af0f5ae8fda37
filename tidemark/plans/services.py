"""Decoding, source passages, evidence, manifests, decisions, lanes and small projections of the archive's services."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators import facets as A
from tidemark.operators import fusion as Fu
from tidemark.operators import history as H
from tidemark.operators import passages as P
from tidemark.operators import vectors as V
from tidemark.plans.registry import query
from tidemark.sources import decoding as D
from tidemark.sources.tables import table

TOKENS = "regexp_extract_all(lower(text), '[0-9a-z]+')"
_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


@query("""SELECT doc_id, sha256(text) AS text_sha256, CASE WHEN doc_id % 3 = 0 THEN 'utf-16' WHEN doc_id % 3 = 1 OR NOT regexp_matches(text, '[^\\x00-\\x7F]') THEN 'utf-8' ELSE 'cp1252' END AS encoding,
    CASE WHEN doc_id % 3 = 0 THEN 'mark' WHEN doc_id % 3 = 1 OR NOT regexp_matches(text, '[^\\x00-\\x7F]') THEN 'valid' ELSE 'fallback' END AS reason, 0::BIGINT AS damaged FROM documents WHERE text IS NOT NULL""")
def t02_decoded_sources(spark, folder):
    k = F.col("doc_id") % 3
    content = F.when(k == 0, F.encode("text", "UTF-16")).when(k == 1, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    files = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", content.alias("content"))
    return D.decoded(files, "doc_id", "content").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "encoding", "reason", "damaged")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'kept' ELSE substr(text, 1, 40) END AS title FROM documents")
def t05_repaired_titles(spark, folder):
    own, k = F.substring("text", 1, 40), F.col("doc_id") % 3
    stored = F.when(k == 0, F.decode(F.encode(own, "UTF-8"), "ISO-8859-1")).when(k == 1, own).otherwise("kept")
    return table(spark, folder, "documents").select("doc_id", D.repaired(stored, own).alias("title"))


@query("SELECT doc_id, sha256(text) AS text_sha256, true AS within_budget FROM documents WHERE text <> ''")
def t19_stitched_passages(spark, folder):
    """The passages of a text, put together by their offsets, are the text; none is over the budget."""
    passages = P.source_passages(table(spark, folder, "documents"), "doc_id", "text", "title: none | text: ")
    sizes = passages.groupBy("doc_id").agg((F.max("tokens") <= P.BUDGET).alias("within_budget"))
    return P.stitched(passages, "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256")).join(sizes, "doc_id")


_SCORED = f"SELECT conv_id, turn, len(list_intersect({TOKENS}, ['une', 'with', 'ist'])) AS lexical, CASE WHEN role = 'user' THEN length(text) % 7 END AS semantic FROM conversations"


def _scored(spark, folder) -> DataFrame:
    common = F.size(F.array_intersect(X.words("text"), F.array(*map(F.lit, ("une", "with", "ist"))))).cast("bigint")
    return table(spark, folder, "conversations").select("conv_id", "turn", common.alias("lexical"), F.when(F.col("role") == "user", F.length("text") % 7).alias("semantic"))


_EVIDENCE = f"""e AS (SELECT conv_id, arg_max(turn, (semantic, -turn)) FILTER (semantic > 0) AS semantic_place, arg_max(turn, (lexical, -turn)) FILTER (lexical > 0) AS lexical_place, min(turn) AS first FROM ({_SCORED}) GROUP BY 1)"""


@query(f"WITH {_EVIDENCE} SELECT conv_id, semantic_place, lexical_place, CASE WHEN semantic_place IS NULL AND lexical_place IS NULL THEN first END AS fallback_place FROM e")
def q08_passage_evidence(spark, folder):
    return P.evidence(_scored(spark, folder), "conv_id", "turn", "semantic", "lexical")


@query(f"""WITH {_EVIDENCE}, s AS (SELECT conv_id, unnest(list_distinct([coalesce(semantic_place, lexical_place, first), coalesce(lexical_place, semantic_place, first)])) AS turn FROM e)
    SELECT conv_id, md5(text) AS content, min(turn) AS turn FROM s JOIN conversations USING (conv_id, turn) GROUP BY 1, 2""")
def q09_paired_evidence(spark, folder):
    """The best semantic and the best lexical passage of a document, equal contents once."""
    found = P.evidence(_scored(spark, folder), "conv_id", "turn", "semantic", "lexical")
    pair = F.array(F.coalesce("semantic_place", "lexical_place", "fallback_place"), F.coalesce("lexical_place", "semantic_place", "fallback_place"))
    chosen = found.select("conv_id", F.explode(F.array_distinct(pair)).alias("turn"))
    texts = table(spark, folder, "conversations").select("conv_id", "turn", F.md5("text").alias("content"))
    return chosen.join(texts, ["conv_id", "turn"]).groupBy("conv_id", "content").agg(F.min("turn").alias("turn"))


@query("SELECT count(*) AS n FROM documents WHERE lang = 'en' AND n_chars > 200")
def q18_count(spark, folder):
    return table(spark, folder, "documents").where("lang = 'en' AND n_chars > 200").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT lang, source, avg(n_chars % 10) FILTER (doc_id % 2 = 0) AS tuning, avg(n_chars % 10) FILTER (doc_id % 2 = 1) AS held, count(*) FILTER (doc_id % 2 = 1) AS n FROM documents GROUP BY 1, 2)
    SELECT lang, arg_max(source, (tuning, source)) AS config, round(arg_max(held, (tuning, source)), 9) AS validation, arg_max(n, (tuning, source)) AS n FROM t WHERE tuning IS NOT NULL GROUP BY 1""")
def q24_frozen_choice(spark, folder):
    """The configuration that is best on the tuning half, judged on the other half only."""
    even, score = F.col("doc_id") % 2 == 0, F.col("n_chars") % 10
    means = table(spark, folder, "documents").groupBy("lang", "source").agg(F.avg(F.when(even, score)).alias("tuning"), F.avg(F.when(~even, score)).alias("held"), F.count_if(~even).alias("n"))
    best = means.where("tuning IS NOT NULL").groupBy("lang").agg(F.max(F.struct("tuning", F.col("source").alias("config"), "held", "n")).alias("b"))
    return best.select("lang", "b.config", F.round("b.held", 9).alias("validation"), "b.n")


@query(f"""WITH l AS (SELECT conv_id, turn, len(list_filter({TOKENS}, lambda w: w IN ('une', 'with', 'ist'))) AS s FROM conversations), m AS (SELECT conv_id, turn, 3.0::DOUBLE * s AS score FROM l WHERE s > 0 UNION ALL SELECT conv_id, turn, 0.5::DOUBLE * (length(text) % 13) FROM conversations WHERE length(text) % 13 > 6)
    SELECT conv_id, turn, sum(score) AS score FROM m GROUP BY 1, 2 ORDER BY score DESC, conv_id, turn LIMIT 25""")
def o05_boosted_merge(spark, folder):
    rows = table(spark, folder, "conversations")
    hits = F.size(F.filter(X.words("text"), lambda w: w.isin("une", "with", "ist"))).cast("double")
    lexical = rows.select("conv_id", "turn", hits.alias("score")).where("score > 0")
    near = rows.select("conv_id", "turn", (F.length("text") % 13).cast("double").alias("score")).where("score > 6")
    return Fu.boosted([(lexical, 3.0), (near, 0.5)], "turn", ["conv_id"]).orderBy(F.desc("score"), "conv_id", "turn").limit(25)


@query("""WITH r AS (SELECT conv_id, turn, turn + 1 AS rank, CASE WHEN role <> 'system' AND turn < 4 THEN length(text) END AS score FROM conversations),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank) AS slot, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, rank) AS place FROM r WHERE score IS NOT NULL)
    SELECT conv_id, turn, rank FROM r WHERE score IS NULL UNION ALL SELECT a.conv_id, a.turn, b.rank FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.place = b.slot""")
def o07_reranked_head(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("rank"), F.when(F.col("role") != "system", F.length("text")).alias("score"))
    return Fu.reranked(rows, "score", ["conv_id"], 4).select("conv_id", "turn", "rank")


@query("SELECT doc_id, substr(text, 1, 12) AS head FROM documents WHERE text IS NOT NULL ORDER BY head DESC, doc_id LIMIT 100")
def o09_code_points(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.substring("text", 1, 12).alias("head")).orderBy(F.desc("head"), "doc_id").limit(100)


_ENTRIES = """e AS (SELECT doc_id AS id, source || '/' || (doc_id - CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END) AS path, CASE WHEN doc_id % 90 = 7 THEN -1 WHEN doc_id > 0 THEN doc_id // 2 END AS parent, length(text) + CASE WHEN doc_id % 70 = 3 THEN 1 ELSE 0 END AS size, md5(text || CASE WHEN doc_id % 60 = 9 THEN '!' ELSE '' END) AS h FROM documents),
    f AS (SELECT doc_id AS id, length(text) AS size, md5(text) AS h FROM documents WHERE doc_id % 80 <> 5)"""


@query(f"""WITH {_ENTRIES} SELECT id, 'path used twice' AS problem FROM e WHERE path IN (SELECT path FROM e GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT id, 'outside scope' FROM e WHERE starts_with(path, 'src1/')
    UNION ALL SELECT id, 'no parent' FROM e WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM e) UNION ALL SELECT id, 'missing' FROM e WHERE id NOT IN (SELECT id FROM f)
    UNION ALL SELECT e.id, 'size' FROM e JOIN f USING (id) WHERE e.size <> f.size UNION ALL SELECT e.id, 'digest' FROM e JOIN f USING (id) WHERE e.h <> f.h""")
def n09_manifest_problems(spark, folder):
    docs, k = table(spark, folder, "documents").where("text IS NOT NULL"), F.col("doc_id")
    path = F.concat_ws("/", "source", (k - F.when(k % 50 == 1, 1).otherwise(0)).cast("string"))
    entries = docs.select(k.alias("id"), path.alias("path"), F.when(k % 90 == 7, -1).when(k > 0, F.floor(k / 2)).alias("parent"),
                          (F.length("text") + F.when(k % 70 == 3, 1).otherwise(0)).alias("size"), F.md5(F.concat("text", F.when(k % 60 == 9, "!").otherwise(""))).alias("sha256"))
    files = docs.where("doc_id % 80 <> 5").select(k.alias("id"), F.length("text").alias("size"), F.md5("text").alias("sha256"))
    return H.manifest_problems(entries, files, [f"src{n}/" for n in range(40) if n != 1])


@query("""WITH d AS (SELECT doc_id % 40 AS batch, doc_id AS id, md5(text || CASE WHEN doc_id % 97 = 0 THEN '!' ELSE '' END) AS h FROM documents UNION ALL SELECT 3, doc_id, md5(text) FROM documents WHERE doc_id = 3),
    j AS (SELECT batch, id, count(*) AS n, count(*) FILTER (h <> md5(text)) AS stale FROM d JOIN documents ON doc_id = id GROUP BY 1, 2)
    SELECT batch, sum(n) <= 500 AND sum(n) = count(*) AND sum(stale) = 0 AS accepted, sum(stale)::BIGINT AS stale FROM j GROUP BY 1""")
def n20_decision_batches(spark, folder):
    docs, k = table(spark, folder, "documents"), F.col("doc_id")
    made = docs.select((k % 40).alias("batch"), k.alias("id"), F.md5(F.concat("text", F.when(k % 97 == 0, "!").otherwise(""))).alias("sha256"))
    twice = docs.where("doc_id = 3").select(F.lit(3).cast("bigint").alias("batch"), k.alias("id"), F.md5("text").alias("sha256"))
    return H.whole_batches(made.unionByName(twice), docs.select(k.alias("id"), F.md5("text").alias("sha256")), 500)


_LEDGERS = "CASE WHEN o_orderpriority < '2' THEN 'first' WHEN o_orderpriority < '4' THEN 'second' ELSE 'third' END"


@query(f"""WITH t AS (SELECT max(o_orderdate) AS now FROM orders) SELECT {_LEDGERS} AS ledger, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total,
    coalesce(sum(round(o_totalprice * 100)::BIGINT) FILTER (date_trunc('month', o_orderdate) = date_trunc('month', now)), 0)::BIGINT AS month, coalesce(sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderdate::DATE = now::DATE), 0)::BIGINT AS today FROM orders, t GROUP BY 1""")
def n13_spend_snapshot(spark, folder):
    orders = table(spark, folder, "orders")
    spent = orders.select("o_orderpriority", F.col("o_orderdate").alias("at"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    parts = [("first", "o_orderpriority < '2'"), ("second", "o_orderpriority >= '2' AND o_orderpriority < '4'"), ("third", "o_orderpriority >= '4'")]
    ledgers = functools.reduce(DataFrame.unionByName, [spent.where(w).withColumn("ledger", F.lit(n)) for n, w in parts])
    rows = ledgers.crossJoin(F.broadcast(orders.agg(F.max("o_orderdate").alias("now"))))  # one row
    within = lambda unit: F.coalesce(F.sum(F.when(F.date_trunc(unit, "at") == F.date_trunc(unit, "now"), F.col("cents"))), F.lit(0))
    return rows.groupBy("ledger").agg(F.sum("cents").alias("total"), within("month").alias("month"), within("day").alias("today"))


@query("SELECT user_id AS site, count(DISTINCT event_id // 100) AS batches, count(*) AS operations, max(event_id // 100) AS latest FROM events GROUP BY 1")
def n15_site_reviews(spark, folder):
    """Batches that list their sites, turned into one review for each site."""
    batches = table(spark, folder, "events").groupBy(F.floor(F.col("event_id") / 100).alias("batch")).agg(F.collect_list("user_id").alias("sites"))
    sites = batches.select("batch", F.explode("sites").alias("site"))
    return sites.groupBy("site").agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("operations"), F.max("batch").alias("latest"))


@query("SELECT source, count(DISTINCT md5(text)) AS missing FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def n24_uncached(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", F.md5("text").alias("blob"))
    return docs.join(docs.where("doc_id % 3 = 0").select("blob"), "blob", "left_anti").groupBy("source").agg(F.count_distinct("blob").alias("missing"))


@query("SELECT doc_id, rank, source, n_chars FROM (SELECT l_orderkey AS doc_id, row_number() OVER (ORDER BY q DESC, l_orderkey) AS rank FROM (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ORDER BY rank LIMIT 200) JOIN documents USING (doc_id)")
def j13_ranked_lookup(spark, folder):
    ranked = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sum("l_quantity").alias("q")).orderBy(F.desc("q"), "doc_id").limit(200)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("q"), "doc_id")).cast("bigint")).drop("q")  # 200 rows
    return table(spark, folder, "documents").select("doc_id", "source", "n_chars").join(F.broadcast(ranked), "doc_id")


@query(f"WITH b AS (SELECT regexp_replace(host, '^(www|m|blog)\\.', '') AS token, min(host) AS board FROM (SELECT {_HOST} AS host FROM pages) WHERE regexp_matches(host, '^(m|blog)\\.') GROUP BY 1) SELECT page_id, coalesce('https://' || board || '/', url) AS resolved FROM pages LEFT JOIN b ON token = {_HOST}")
def j18_aliases(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", U.host("url").alias("token"))
    boards = pages.where(F.col("token").rlike(r"^(m|blog)\.")).groupBy(F.regexp_replace("token", r"^(www|m|blog)\.", "").alias("token")).agg(F.min("token").alias("board"))
    return pages.join(boards, "token", "left").select("page_id", F.coalesce(F.concat(F.lit("https://"), "board", F.lit("/")), "url").alias("resolved"))


@query("SELECT source AS term, count(*) AS n, false AS approximate FROM documents GROUP BY 1 ORDER BY n DESC, term LIMIT 10")
def a02_exact_terms(spark, folder):
    return table(spark, folder, "documents").groupBy(F.col("source").alias("term")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(10).withColumn("approximate", F.lit(False))


@query("SELECT conv_id, count(DISTINCT lower(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 6))) AS excerpts, count(*) AS n FROM conversations GROUP BY 1")
def a14_distinct_excerpts(spark, folder):
    excerpt = F.lower(F.substring(X.collapsed("text"), 1, 6))
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.count_distinct(excerpt).alias("excerpts"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM r)
    SELECT event_id, user_id, event_type, run FROM g QUALIFY row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) <= 2""")
def a27_capped_runs(spark, folder):
    """The first two of each run of equal kinds."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(own))).cast("bigint").alias("new"))
    runs = rows.select("event_id", "user_id", "event_type", F.sum("new").over(own).alias("run"))
    place = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("event_id"))
    return runs.withColumn("place", place).where("place <= 2").drop("place")


@query("SELECT source, max(n_chars) AS longest, sum(n_chars)::BIGINT AS total, count(*) FILTER (n_chars <> length(trim(text))) AS changed FROM documents GROUP BY 1")
def a38_audit_totals(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.max("n_chars").alias("longest"), F.sum("n_chars").alias("total"), F.count_if(F.col("n_chars") != F.length(F.trim("text"))).alias("changed"))


@query("""SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'https://archive.example.org/websites/' || lang || '/' || doc_id WHEN source = 'src2' THEN 'https://archive.example.org/mailing-lists/' || lang || '#' || doc_id ELSE 'https://archive.example.org/newsgroups/' || doc_id END AS url FROM documents""")
def p07_archive_urls(spark, folder):
    root, k = F.lit("https://archive.example.org/"), F.col("doc_id").cast("string")
    site = F.concat(root, F.lit("websites/"), "lang", F.lit("/"), k)
    mail = F.concat(root, F.lit("mailing-lists/"), "lang", F.lit("#"), k)
    return table(spark, folder, "documents").select("doc_id", F.when(F.col("source").isin("src0", "src1"), site).when(F.col("source") == "src2", mail).otherwise(F.concat(root, F.lit("newsgroups/"), k)).alias("url"))


@query("SELECT doc_id, coalesce(quality, -1)::BIGINT AS quality, coalesce(toxic, 0)::BIGINT AS toxic, coalesce(lang, 'und') AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def p12_defaults(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id", "left")
    return A.with_defaults(rows, {"doc_id": None, "lang": "und", "quality": -1, "toxic": 0}).select("doc_id", F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"), "lang")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN 'web' ELSE source END AS source FROM documents")
def p17_merged(spark, folder):
    """What a later task found replaces what an earlier one did; nulls replace nothing."""
    later = [F.when(F.col("doc_id") % 3 == 0, "en").alias("lang"), F.when(F.col("doc_id") % 2 == 0, "web").alias("source")]
    new = table(spark, folder, "documents").select("doc_id", *later).alias("new")
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source").alias("old").join(new, "doc_id")
    return rows.select("doc_id", *(F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in ("lang", "source")))


@query("SELECT event_id, make_timestamp(1700000000000000 + event_id * 1000000) AS sent, CASE WHEN event_id % 3 = 2 THEN NULL ELSE ts::DATE END AS day FROM events")
def d03_times(spark, folder):
    k = F.col("event_id")
    written = F.when(k % 3 == 0, F.date_format("ts", "d MMM yyyy")).when(k % 3 == 1, F.date_format("ts", "yyyy/MM/dd")).otherwise("some day")
    day = F.coalesce(*(F.try_to_timestamp("written", F.lit(p)) for p in ("d MMM yyyy", "yyyy/MM/dd"))).cast("date")
    return table(spark, folder, "events").withColumn("written", written).select("event_id", F.timestamp_seconds(k + 1700000000).cast("timestamp_ntz").alias("sent"), day.alias("day"))


@query("SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1, 2")
def d06_buckets(spark, folder):
    return table(spark, folder, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("year"), F.month("o_orderdate").cast("bigint").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN contains(html, (page_id % 1000)::VARCHAR) THEN page_id % 1000 END AS kept FROM pages")
def d07_supported_guess(spark, folder):
    """A guess stays only where the source says it."""
    guess = F.col("page_id") % 1000
    return table(spark, folder, "pages").select("page_id", F.when(F.contains("html", guess.cast("string")), guess).alias("kept"))


@query("SELECT vec_id, len(embedding) AS width, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def r02_packed_vectors(spark, folder):
    packed = table(spark, folder, "embeddings").select("vec_id", V.packed("embedding").alias("p"))
    vectors = packed.select("vec_id", V.unpacked("p").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select("vec_id", F.size("v").cast("bigint").alias("width"), F.round(norm, 6).alias("norm"))


@query("SELECT event_id, user_id, count(*) OVER w AS points, max(event_id) OVER w - min(event_id) OVER w AS reach FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def z06_last_points(spark, folder):
    last = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-29, 0)
    return table(spark, folder, "events").select("event_id", "user_id", F.count("*").over(last).alias("points"), (F.max("event_id").over(last) - F.min("event_id").over(last)).alias("reach"))


@query("SELECT event_type AS lane, event_id, user_id FROM events WHERE user_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 5")
def z16_lane_claims(spark, folder):
    """Each lane claims the oldest five that are not held;"""
    rows = table(spark, folder, "events").where("user_id % 5 <> 0").select(F.col("event_type").alias("lane"), "ts", "event_id", "user_id")
    return A.top_of(rows, ["lane"], 5, F.asc("ts"), F.asc("event_id")).select("lane", "event_id", "user_id")


@query("""WITH q AS (SELECT user_id, count(*) AS waiting, min(event_id) AS oldest, max(event_id) % 7 AS turn FROM events GROUP BY 1), c AS (SELECT * FROM q ORDER BY turn, oldest, user_id LIMIT 12)
    SELECT user_id, CASE WHEN c.user_id IS NULL THEN q.turn ELSE (SELECT max(turn) FROM q) + 1 END AS turn, c.user_id IS NOT NULL AS claimed FROM q LEFT JOIN c USING (user_id)""")
def w07_rotating_turns(spark, folder):
    hosts = table(spark, folder, "events").groupBy("user_id").agg(F.min("event_id").alias("oldest"), (F.max("event_id") % 7).alias("turn"))
    claimed = hosts.orderBy("turn", "oldest", "user_id").limit(12).select("user_id", F.lit(True).alias("claimed"))
    rows = hosts.join(F.broadcast(claimed), "user_id", "left").crossJoin(F.broadcast(hosts.agg((F.max("turn") + 1).alias("next"))))
    return rows.select("user_id", F.when(F.col("claimed"), F.col("next")).otherwise(F.col("turn")).alias("turn"), F.coalesce("claimed", F.lit(False)).alias("claimed"))


@query("SELECT doc_id, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 150 AND source <> 'src1' AND contains(text, 'the')")
def f22_filter_chain(spark, folder):
    chain = [lambda d: d.where(F.col("lang").isin("en", "de")), lambda d: d.where("n_chars >= 150"), lambda d: d.where("source <> 'src1'"), lambda d: d.where(F.contains("text", F.lit("the")))]
    return functools.reduce(DataFrame.transform, chain, table(spark, folder, "documents")).select("doc_id", "n_chars")


@query(f"SELECT page_id FROM pages WHERE starts_with({_PATH}, '/en/') AND page_id BETWEEN 10 AND 200 AND contains({_HOST}, 'example') AND contains(lower(html), 'the')")
def f23_explore_selection(spark, folder):
    chosen = F.startswith(U.path("url"), F.lit("/en/")) & F.col("page_id").between(10, 200) & F.contains(U.host("url"), F.lit("example")) & F.contains(F.lower("html"), F.lit("the"))
    return table(spark, folder, "pages").where(chosen).select("page_id")


@query("SELECT doc_id, source || ', document ' || doc_id || ' (' || lang || '), ' || n_chars || ' characters' AS citation FROM documents")
def k12_citations(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.concat("source", F.lit(", document "), F.col("doc_id").cast("string"), F.lit(" ("), "lang", F.lit("), "), F.col("n_chars").cast("string"), F.lit(" characters")).alias("citation"))


@query(f"SELECT host, min_by(dir, (length(dir), dir)) AS boundary FROM (SELECT {_HOST} AS host, regexp_extract({_PATH}, '^(/[^/]*/)', 1) AS dir, count(*) AS n FROM pages GROUP BY 1, 2) WHERE dir <> '' AND n >= 1 GROUP BY 1")
def t34_widened_scope(spark, folder):
    """The shortest folder of a host that holds a page."""
    folders = table(spark, folder, "pages").select(U.host("url").alias("host"), F.regexp_extract(U.path("url"), "^(/[^/]*/)", 1).alias("dir")).where("dir <> ''").distinct()
    return folders.groupBy("host").agg(F.min_by("dir", F.struct(F.length("dir"), "dir")).alias("boundary"))


_KIND = "CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'IMAGE/png' WHEN 2 THEN 'application/xhtml+xml' ELSE 'application/zip' END"


@query(f"SELECT page_id, CASE WHEN m LIKE 'text/%' OR m = 'application/xhtml+xml' THEN 'text' WHEN m LIKE 'image/%' THEN 'image' ELSE 'other' END AS route FROM (SELECT page_id, lower(trim(split_part({_KIND}, ';', 1))) AS m FROM pages)")
def t01_routes(spark, folder):
    k = F.col("page_id") % 4
    kind = F.when(k == 0, "text/html; charset=utf-8").when(k == 1, "IMAGE/png").when(k == 2, "application/xhtml+xml").otherwise("application/zip")
    rows = table(spark, folder, "pages").select("page_id", F.lower(F.trim(F.split_part(kind, F.lit(";"), F.lit(1)))).alias("m"))
    text, image = F.startswith("m", F.lit("text/")) | (F.col("m") == "application/xhtml+xml"), F.startswith("m", F.lit("image/"))
    return rows.select("page_id", F.when(text, "text").when(image, "image").otherwise("other").alias("route"))
