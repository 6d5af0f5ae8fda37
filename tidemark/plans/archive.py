"""Captured pages: links, graph, passages, threads, identity and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators import facets as A
from tidemark.operators import history as H
from tidemark.operators import passages as P
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"
_LINKS = "l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"(/[^\"#]*)\"', 1)) AS href FROM pages), t AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS target FROM l)"


@query(f"WITH {_LINKS} SELECT page_id, target, count(*) AS n FROM t GROUP BY 1, 2")
def t30_links(spark, folder):
    return P.links(table(spark, folder, "pages"), "page_id", "url", "html").groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, length(html) AS size, regexp_matches(html, '</html>\\s*$') AS closed FROM pages")
def t08_page_head(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.length("html").cast("bigint").alias("size"), F.col("html").rlike(r"</html>\s*$").alias("closed"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<p>([^<]*)</p>', 1)) AS paragraph FROM pages""")
def t17_paragraphs(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1))).alias("paragraph"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<a href')) AS links, round(coalesce(list_sum(list_transform(regexp_extract_all(html, '<a href=[^>]*>([^<]*)<', 1), lambda x: length(x))), 0) / length(html)::DOUBLE, 6) AS density FROM pages""")
def t11_link_density(spark, folder):
    anchors = F.regexp_extract_all("html", F.lit("<a href=[^>]*>([^<]*)<"), F.lit(1))
    inked = F.aggregate(anchors, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))
    return table(spark, folder, "pages").select("page_id", F.regexp_count("html", F.lit("<a href")).cast("bigint").alias("links"), F.round(inked / F.length("html"), 6).alias("density"))


_CHUNKS = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil((len(w) - 48) / 432.0) AS BIGINT), 1))) AS passage FROM w WHERE len(w) > 0),
    p AS (SELECT doc_id, passage, passage * 432 AS start, least(passage * 432 + 480, len(w)) AS "end", array_to_string(w[passage * 432 + 1 : passage * 432 + 480], ' ') AS body FROM c)"""


@query(f"""WITH {_CHUNKS} SELECT * FROM p""")
def t18_chunks(spark, folder):
    return P.chunks(table(spark, folder, "documents"), "doc_id", "text")


@query(f"""WITH {_CHUNKS}, d AS (SELECT doc_id, passage, start, CASE WHEN passage % 11 = 5 THEN "end" + 200 ELSE "end" END AS "end" FROM p WHERE passage % 7 <> 3),
    f AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY passage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM d)
    SELECT doc_id, passage, CASE WHEN start > coalesce(reached, 0) THEN 'gap' ELSE 'budget' END AS fault FROM f WHERE start > coalesce(reached, 0) OR "end" - start > 480""")
def t22_plan_faults(spark, folder):
    plan = P.chunks(table(spark, folder, "documents"), "doc_id", "text").where("passage % 7 <> 3")
    damaged = plan.withColumn("end", F.when(F.col("passage") % 11 == 5, F.col("end") + 200).otherwise(F.col("end")))
    return P.plan_faults(damaged, "doc_id").select("doc_id", "passage", "fault")


@query(f"""WITH {_CHUNKS}, r AS (SELECT doc_id, passage, sha256('title: ' || source || ' | text: ' || body) AS request_sha256 FROM p JOIN documents USING (doc_id)) SELECT request_sha256, count(*) AS uses FROM r GROUP BY 1""")
def t23_embedding_requests(spark, folder):
    docs = table(spark, folder, "documents")
    passages = P.chunks(docs, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id")
    distinct, places = P.requests(passages, "doc_id", F.col("source"))
    return places.groupBy("request_sha256").agg(F.count("*").alias("uses")).join(distinct.select("request_sha256"), "request_sha256")


@query("""WITH n AS (SELECT md5(text) AS h, doc_id, source FROM documents), o AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE source IN ('src0', 'src1')) SELECT doc_id, o.h IS NOT NULL AS reused FROM n LEFT JOIN o USING (h)""")
def t39_reuse(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    old = docs.where(F.col("source").isin("src0", "src1")).select("h").distinct().withColumn("reused", F.lit(True))
    return docs.join(old, "h", "left").select("doc_id", F.coalesce("reused", F.lit(False)).alias("reused"))


@query("SELECT conv_id, count(*) AS posts, count(DISTINCT role) AS roles, min_by(text, turn) AS first, max(turn) AS last, string_agg(role, '>' ORDER BY turn) AS flow FROM conversations GROUP BY 1")
def t14_threads(spark, folder):
    flow = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">")
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").alias("posts"), F.count_distinct("role").alias("roles"), F.min_by("text", "turn").alias("first"), F.max("turn").alias("last"), flow.alias("flow"))


@query("""SELECT text AS member, min(conv_id) AS owner, count(DISTINCT conv_id) > 1 AS ambiguous FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def t26_membership(spark, folder):
    rows = table(spark, folder, "conversations").where("role = 'assistant'")
    return rows.groupBy(F.col("text").alias("member")).agg(F.min("conv_id").alias("owner"), (F.min("conv_id") != F.max("conv_id")).alias("ambiguous"))


@query("SELECT doc_id, least(2, coalesce(quality, 0) + CASE WHEN n_chars > 1000 THEN 2 ELSE 1 END, CASE WHEN toxic = 1 THEN 0 ELSE 3 END) AS grade FROM documents LEFT JOIN labels USING (doc_id)")
def t29_grades(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    grade = F.least(F.lit(2), F.coalesce("quality", F.lit(0)) + F.when(F.col("n_chars") > 1000, 2).otherwise(1), F.when(F.col("toxic") == 1, 0).otherwise(3))
    return rows.select("doc_id", grade.alias("grade"))


@query(f"""WITH {_LINKS}, h AS (SELECT page_id, {_HOST} AS host FROM pages), e AS (SELECT target, page_id, host, row_number() OVER (PARTITION BY target ORDER BY page_id) AS k FROM (SELECT DISTINCT target, page_id FROM t) JOIN h USING (page_id))
    SELECT target, 3 * CAST(regexp_matches(target, '(the|der|los)') AS INT) + 8 * count(DISTINCT host) + 10 * CAST(min(page_id) < 100 AS INT) AS priority, count(*) AS sources FROM e WHERE k <= 8 GROUP BY target""")
def a26_link_priority(spark, folder):
    pages = table(spark, folder, "pages")
    edges = P.links(pages, "page_id", "url", "html").select("target", "page_id").distinct().join(pages.select("page_id", U.host("url").alias("host")), "page_id")
    kept = A.top_of(edges, ["target"], 8, F.asc("page_id"))
    score = 3 * F.col("target").rlike("(the|der|los)").cast("int") + 8 * F.count_distinct("host") + 10 * (F.min("page_id") < 100).cast("int")
    return kept.groupBy("target").agg(score.alias("priority"), F.count("*").alias("sources"))


@query(f"""WITH h AS (SELECT {_HOST} AS host, url FROM pages), a AS (SELECT DISTINCT host FROM h WHERE starts_with(url, 'https')) SELECT host, count(*) AS pages, host IN (SELECT host FROM a) AS secure,
    CASE WHEN count(*) >= 10 THEN 'present' WHEN count(*) >= 3 THEN 'partial' ELSE 'absent' END AS coverage FROM h GROUP BY host""")
def n01_host_coverage(spark, folder):
    hosts = table(spark, folder, "pages").select(U.host("url").alias("host"), F.startswith("url", F.lit("https")).alias("s")).groupBy("host").agg(F.count("*").alias("pages"), F.bool_or("s").alias("secure"))
    return hosts.withColumn("coverage", F.when(F.col("pages") >= 10, "present").when(F.col("pages") >= 3, "partial").otherwise("absent"))


@query(f"""SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY regexp_replace({_HOST}, '^(www|m|blog)\\.', '') ORDER BY starts_with(url, 'https') DESC, page_id) = 1 THEN 'owner' ELSE 'duplicate' END AS role FROM pages""")
def n04_site_owner(spark, folder):
    site = F.regexp_replace(U.host("url"), r"^(www|m|blog)\.", "")
    n = F.row_number().over(Window.partitionBy(site).orderBy(F.desc(F.startswith("url", F.lit("https"))), "page_id"))
    return table(spark, folder, "pages").select("page_id", F.when(n == 1, "owner").otherwise("duplicate").alias("role"))


@query(f"""WITH p AS (SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS k FROM pages) SELECT k AS page_key, count(*) AS captures, min(page_id) AS first, max(page_id) AS last FROM p GROUP BY 1""")
def q14_captures(spark, folder):
    key = F.concat(U.bare_host("url"), U.path("url"))
    return table(spark, folder, "pages").groupBy(key.alias("page_key")).agg(F.count("*").alias("captures"), F.min("page_id").alias("first"), F.max("page_id").alias("last"))


@query("""SELECT path, CASE WHEN found IS NULL THEN 'missing' WHEN found = sha THEN 'ok' ELSE 'altered' END AS state FROM
    (SELECT 'doc/' || doc_id AS path, sha256(text) AS sha FROM documents) LEFT JOIN (SELECT 'doc/' || doc_id AS path, sha256(CASE WHEN lang = 'es' THEN text || '.' ELSE text END) AS found FROM documents WHERE source <> 'src9') USING (path)""")
def s21_verified_manifest(spark, folder):
    from tidemark.sources.tables import verified

    docs = table(spark, folder, "documents").withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    files = docs.where("source <> 'src9'").select("path", F.sha2(F.when(F.col("lang") == "es", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"))
    return verified(files, docs.select("path", F.sha2("text", 256).alias("sha256"))).select("path", "state")


@query("""WITH s AS (SELECT doc_id AS k, 1 AS version, lang AS v FROM documents WHERE lang <> 'de'), c AS (SELECT doc_id AS k, CASE WHEN source = 'src1' THEN 0 ELSE 2 END AS version, source AS v FROM documents WHERE lang <> 'fr')
    SELECT k, version, v FROM (SELECT *, 0 AS new FROM s UNION ALL SELECT *, 1 FROM c) QUALIFY row_number() OVER (PARTITION BY k ORDER BY version DESC, new) = 1""")
def k05_upsert(spark, folder):
    docs = table(spark, folder, "documents")
    stored = docs.where("lang <> 'de'").select(F.col("doc_id").alias("k"), F.lit(1).alias("version"), F.col("lang").alias("v"))
    changes = docs.where("lang <> 'fr'").select(F.col("doc_id").alias("k"), F.when(F.col("source") == "src1", 0).otherwise(2).alias("version"), F.col("source").alias("v"))
    return H.upsert(stored, changes, ["k"], "version")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en') GROUP BY 2")
def k02_create_only(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.md5("text").alias("h"))
    new = docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    return H.create_only(docs.where("lang = 'en'"), new, ["h"]).select("doc_id", "h")


@query("SELECT doc_id, lang IS NOT DISTINCT FROM CASE WHEN source = 'src2' THEN 'xx' ELSE lang END AS applied FROM documents")
def k04_compare_and_swap(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    changes = docs.select("doc_id", F.when(F.col("source") == "src2", "xx").otherwise(F.col("lang")).alias("lang"))
    return H.swapped(docs.drop("source"), changes, "doc_id", ["lang"]).select("doc_id", "applied")
