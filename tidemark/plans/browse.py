"""Browsing: filters, facets, totals, pages and projections over records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators import facets as A
from tidemark.plans.registry import query
from tidemark.sources.tables import table

DOCS = ["doc_id", "lang", "source", "n_chars"]


@query("""
    SELECT 'lang' AS facet, lang AS value, count(*) AS n, false AS approximate FROM documents WHERE n_chars >= 100 AND lang <> '' GROUP BY lang
    UNION ALL SELECT 'source', source, count(*), false FROM documents WHERE n_chars >= 100 AND source <> '' GROUP BY source
    UNION ALL SELECT 'total', 'records', count(*), false FROM documents WHERE n_chars >= 100
    UNION ALL SELECT 'total', 'sources', count(DISTINCT source), false FROM documents WHERE n_chars >= 100
    UNION ALL SELECT 'total', 'tagged', count(lang), false FROM documents WHERE n_chars >= 100""")
def explore_overview(spark, folder):
    docs = table(spark, folder, "documents").where("n_chars >= 100").select("lang", "source")
    sums = docs.agg(F.count("*").alias("records"), F.count_distinct("source").alias("sources"), F.count("lang").alias("tagged"))
    sums = sums.select(F.lit("total").alias("facet"), F.explode(F.create_map(*[x for c in sums.columns for x in (F.lit(c), F.col(c))])).alias("value", "n"), F.lit(False).alias("approximate"))
    return A.terms(docs, "lang").unionByName(A.terms(docs, "source")).unionByName(sums)


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src0'")
def f01_term(spark, folder):
    return table(spark, folder, "documents").where("lang = 'en' AND source = 'src0'").select(DOCS)


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('fr', 'de') AND source IN ('src1', 'src2', 'src3')")
def f02_terms(spark, folder):
    return table(spark, folder, "documents").where(F.col("lang").isin("fr", "de") & F.col("source").isin("src1", "src2", "src3")).select(DOCS)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-03-16'")
def f03_day_range(spark, folder):
    return table(spark, folder, "orders").where("o_orderdate >= TIMESTAMP_NTZ'1996-03-01' AND o_orderdate < TIMESTAMP_NTZ'1996-03-16'").select("o_orderkey", "o_orderdate")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= greatest(DATE '1995-06-01', DATE '1996-01-01', DATE '1994-01-01')
    AND o_orderdate < least(DATE '1997-01-01', DATE '1998-01-01', DATE '1996-06-30') + INTERVAL 1 DAY""")
def f04_window_intersection(spark, folder):
    windows = [("1995-06-01", "1997-01-01"), ("1996-01-01", "1998-01-01"), ("1994-01-01", "1996-06-30")]
    low, high = max(a for a, _ in windows), min(b for _, b in windows)
    return table(spark, folder, "orders").where((F.col("o_orderdate") >= F.lit(low).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.date_add(F.lit(high).cast("date"), 1).cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'STANDARD')")
def f05_prefix(spark, folder):
    return table(spark, folder, "part").where(F.startswith(F.col("p_type"), F.lit("STANDARD"))).select("p_partkey", "p_type")


@query("""SELECT doc_id, (text IS NOT NULL OR lang IS NOT NULL) AS has_any, text IS NOT NULL AS has_text, nullif(trim(text), '') IS NULL AS is_blank
    FROM documents WHERE NOT (source IS NULL)""")
def f06_exists(spark, folder):
    docs = table(spark, folder, "documents").where(F.col("source").isNotNull())
    return docs.select("doc_id", (F.col("text").isNotNull() | F.col("lang").isNotNull()).alias("has_any"), F.col("text").isNotNull().alias("has_text"), F.nullif(F.trim("text"), F.lit("")).isNull().alias("is_blank"))


@query("SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'https?://(www|m|blog)\\.[^/]+/(en|de)/[0-9]+.*')")
def f07_full_regexp(spark, folder):
    return table(spark, folder, "pages").where(F.col("url").rlike(r"^(?:https?://(www|m|blog)\.[^/]+/(en|de)/[0-9]+.*)$")).select("page_id", "url")


@query("""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
    SELECT 'host' AS kind, page_id FROM p WHERE h = 'm.ththth.example.net'
    UNION ALL SELECT 'directory', page_id FROM p WHERE h = 'm.ththth.example.net' AND (path = '/en' OR starts_with(path, '/en/'))
    UNION ALL SELECT 'page', page_id FROM p WHERE h = 'm.ththth.example.net' AND path = '/en/25'""")
def f09_url_scope(spark, folder):
    pages = table(spark, folder, "pages")
    scopes = [("host", "/"), ("directory", "/en"), ("page", "/en/25")]
    flagged = pages.select("page_id", F.array(*[F.when(U.in_scope("url", k, "m.ththth.example.net", p), k) for k, p in scopes]).alias("kinds"))
    return flagged.select(F.explode(F.array_compact("kinds")).alias("kind"), "page_id")


@query("""SELECT doc_id, CAST(CAST(n_chars > 1000 AS INT) + CAST(source IN ('src1', 'src2') AS INT) + CAST(lang = 'fr' AS INT) AS BIGINT) AS score
    FROM documents WHERE lang IN ('en', 'fr') AND NOT source = 'src3' AND CAST(n_chars > 1000 AS INT) + CAST(source IN ('src1', 'src2') AS INT) + CAST(lang = 'fr' AS INT) >= 1""")
def f11_bool_query(spark, folder):
    should = [F.col("n_chars") > 1000, F.col("source").isin("src1", "src2"), F.col("lang") == "fr"]
    score = sum((s.cast("bigint") for s in should), F.lit(0).cast("bigint"))
    docs = table(spark, folder, "documents").where(F.col("lang").isin("en", "fr") & ~(F.col("source") == "src3"))
    return docs.select("doc_id", score.alias("score")).where("score >= 1")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-02-01' AND l_returnflag = 'R'")
def f12_nested_same_element(spark, folder):
    items = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_shipdate", "l_returnflag")).alias("items"))
    hit = F.exists("items", lambda x: (x["l_shipdate"] >= F.lit("1996-01-01").cast("timestamp_ntz")) & (x["l_shipdate"] < F.lit("1996-02-01").cast("timestamp_ntz")) & (x["l_returnflag"] == "R"))
    return items.where(hit).select("l_orderkey")


@query("SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[0-9a-z]+'), ' ') || ' ', ' of the ')")
def f13_match_phrase(spark, folder):
    return table(spark, folder, "documents").where(X.has_phrase(X.words("text"), ["of", "the"])).select("doc_id")


@query("""SELECT doc_id FROM documents WHERE list_has_all(list_distinct(split(lang || ' ' || source, ' ')), ['en', 'src4'])
    UNION ALL SELECT doc_id FROM documents WHERE NOT list_has_any(split(lang || ' ' || source, ' '), ['en', 'fr', 'de']) AND n_chars BETWEEN 100 AND 2000""")
def f20_facet_filters(spark, folder):
    docs = table(spark, folder, "documents").withColumn("tags", F.array("lang", "source"))
    every = docs.where(F.size(F.array_intersect("tags", F.array(F.lit("en"), F.lit("src4")))) == 2)
    none = docs.where(~F.arrays_overlap("tags", F.array(*map(F.lit, ("en", "fr", "de")))) & F.col("n_chars").between(100, 2000))
    return every.select("doc_id").unionAll(none.select("doc_id"))


@query("""SELECT 'hit' AS kind, CAST(doc_id AS VARCHAR) AS value, CAST(1 AS BIGINT) AS n FROM documents WHERE source = 'src5' AND lang = 'de'
    UNION ALL SELECT 'facet', lang, count(*) FROM documents WHERE source = 'src5' GROUP BY lang""")
def f21_post_filter(spark, folder):
    docs = table(spark, folder, "documents").where("source = 'src5'")
    hits = docs.where("lang = 'de'").select(F.lit("hit").alias("kind"), F.col("doc_id").cast("string").alias("value"), F.lit(1).cast("bigint").alias("n"))
    return hits.unionByName(A.terms(docs, "lang").select(F.lit("facet").alias("kind"), "value", "n"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') AS captured, CASE WHEN year(o_orderdate) BETWEEN 1999 AND 2001 THEN 1 WHEN year(o_orderdate) BETWEEN 2002 AND 2006 THEN 2 END AS tier FROM orders""")
def f24_capture_tier(spark, folder):
    ts = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    year = F.substring(ts, 1, 4)
    tier = F.when(year.between("1999", "2001"), 1).when(year.between("2002", "2006"), 2)
    return table(spark, folder, "orders").select("o_orderkey", ts.alias("captured"), tier.alias("tier"))


@query("""SELECT page_id, url NOT LIKE '%\\%' AND regexp_matches(url, '^https?://[^/@?#]+\\.[^/@?#]+') AS safe, regexp_matches(url, '^https?://(ad|ads)\\.') AS advert,
    regexp_matches(lower(url), '\\.(css|js|gif|jpg|png)$') AS asset FROM pages""")
def f25_url_predicates(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.is_safe("url").alias("safe"), U.is_advert("url").alias("advert"), U.is_asset("url").alias("asset"))


@query("""SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT (quality IS NOT DISTINCT FROM 1 AND toxic IS NOT DISTINCT FROM 0) AND (text IS NOT NULL AND text <> '')""")
def f29_remaining_work(spark, folder):
    done = F.col("quality").eqNullSafe(1) & F.col("toxic").eqNullSafe(0)
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return docs.where(~done & (F.col("text") != "")).select("doc_id")


@query("""SELECT o_orderkey, CASE WHEN l.k IS NULL THEN 'missing' WHEN o_orderstatus = 'P' THEN 'incomplete' WHEN l.t < o_orderdate + INTERVAL 30 DAY THEN 'stale' ELSE 'current' END AS decision
    FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(l_shipdate) AS t FROM lineitem GROUP BY 1) l ON l.k = o_orderkey""")
def f30_needs_indexing(spark, folder):
    seen = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_shipdate").alias("t"))
    orders = table(spark, folder, "orders").join(seen, F.col("k") == F.col("o_orderkey"), "left")
    stale = F.col("t") < F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")
    decision = F.when(F.col("k").isNull(), "missing").when(F.col("o_orderstatus") == "P", "incomplete").when(stale, "stale").otherwise("current")
    return orders.select("o_orderkey", decision.alias("decision"))


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def f33_folded_search(spark, folder):
    return table(spark, folder, "part").where(F.instr(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), "brand#1") > 0).select("p_partkey")


@query("SELECT lang AS value, count(*) AS n, 'lang' AS facet, false AS approximate FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 3")
def a01_terms_facet(spark, folder):
    return A.terms(table(spark, folder, "documents"), "lang", 3)


@query("""SELECT 'lang' AS facet, lang AS value, count(*) AS n, false AS approximate FROM documents WHERE source IN ('src1', 'src2') GROUP BY lang
    UNION ALL SELECT 'source', source, count(*), false FROM documents WHERE lang IN ('fr') GROUP BY source""")
def a03_multi_select_facets(spark, folder):
    return A.multi_select(table(spark, folder, "documents"), {"lang": ["fr"], "source": ["src1", "src2"]}, ["lang", "source"])


@query("SELECT source AS value, count(*) AS n FROM documents WHERE source <> '' AND source > 'src12' GROUP BY 1 ORDER BY 1 LIMIT 5")
def a04_composite_terms(spark, folder):
    return A.composite(table(spark, folder, "documents"), "source", "src12", 5)


@query("""SELECT label, n FROM (SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS high, count(*) FILTER (event_type IN ('click', 'view')) AS visits,
    count(*) FILTER (ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31') AS week, count(*) AS everything FROM events) UNPIVOT (n FOR label IN (errors, high, visits, week, everything))""")
def a05_filters(spark, folder):
    week = (F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-31").cast("timestamp_ntz"))
    named = {"errors": F.col("event_type") == "error", "high": F.col("value") > 50, "visits": F.col("event_type").isin("click", "view"), "week": week, "everything": F.lit(True)}
    return A.named_counts(table(spark, folder, "events"), named)


@query("SELECT o_custkey, max(o_orderdate) AS latest, count(*) AS n FROM orders GROUP BY 1 ORDER BY latest DESC, o_custkey LIMIT 21")
def a06_recent_groups(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"), F.count("*").alias("n")).orderBy(F.desc("latest"), "o_custkey").limit(21)


@query("SELECT source, min(n_chars) AS least, max(n_chars) AS most, count(lang) AS tagged, count(*) AS n FROM documents GROUP BY source")
def a07_sub_metrics(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count("lang").alias("tagged"), F.count("*").alias("n"))


@query("""SELECT d.source, CASE WHEN count(l.quality) = count(*) THEN min(l.quality) END AS least, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def a08_known_if_all(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.when(F.count("quality") == F.count("*"), F.min("quality")).alias("least"), F.count("*").alias("n"))


@query("SELECT CAST(y AS INT) AS year, count(o_orderkey) AS n FROM range(1990, 2006) t(y) LEFT JOIN orders ON year(o_orderdate) = y GROUP BY y")
def a09_year_histogram(spark, folder):
    return A.year_histogram(table(spark, folder, "orders"), "o_orderdate", 1990, 2005)


@query("SELECT year(o_orderdate)::INT AS year, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def a10_distinct_by_year(spark, folder):
    return table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("SELECT count(*) FILTER (quality IS NOT NULL) AS tagged, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)")
def a11_filter_count(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return rows.agg(F.count_if(F.col("quality").isNotNull()).alias("tagged"), F.count("*").alias("n"))


@query("SELECT least(n, 1001) AS value, CASE WHEN n > 1001 THEN 'gte' ELSE 'eq' END AS relation FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F')")
def a12_total_hits(spark, folder):
    return A.total(table(spark, folder, "orders").where("o_orderstatus = 'F'"))


@query("""WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 1000)
    SELECT source, arg_min(doc_id, rank) AS doc_id, arg_min(n_chars, rank) AS n_chars, min(rank) AS rank, count(*) AS matches FROM r GROUP BY source""")
def a13_grouped_page(spark, folder):
    top = A.ranked(table(spark, folder, "documents").select("doc_id", "source", "n_chars"), F.desc("n_chars"), F.asc("doc_id"))
    return A.groups(top, "source")


@query("""WITH r AS (SELECT doc_id, source, md5('7' || doc_id) AS h FROM documents), s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS k FROM r)
    SELECT doc_id, source FROM s WHERE k <= 8 ORDER BY h, doc_id LIMIT 100""")
def a15_diversified_sample(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "source", F.md5(F.concat(F.lit("7"), F.col("doc_id").cast("string"))).alias("h"))
    return A.top_of(rows, ["source"], 8, F.asc("h"), F.asc("doc_id")).orderBy("h", "doc_id").limit(100).select("doc_id", "source")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT lang, doc_id, n_chars FROM r WHERE k <= 3""")
def a16_top_hits(spark, folder):
    return A.top_of(table(spark, folder, "documents").select("lang", "doc_id", "n_chars"), ["lang"], 3, F.desc("n_chars"), F.asc("doc_id"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 50")
def o01_sorted_top(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "n_chars").orderBy(F.desc_nulls_last("n_chars"), F.asc_nulls_last("doc_id")).limit(50)


@query("SELECT doc_id, lang, source FROM documents ORDER BY lang, source DESC, doc_id LIMIT 40")
def o02_three_keys(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", "source").orderBy("lang", F.desc("source"), "doc_id").limit(40)


@query("""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER () AS total FROM documents)
    SELECT doc_id, n_chars, rank, total > 60 AS has_more, CASE WHEN total > 60 THEN CAST(60 AS BIGINT) END AS next_offset, false AS limit_reached FROM r WHERE rank BETWEEN 41 AND 60""")
def o03_page(spark, folder):
    return A.page(table(spark, folder, "documents").select("doc_id", "n_chars"), F.desc("n_chars"), F.asc("doc_id"), offset=40, limit=20)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 25")
def o04_keyset_page(spark, folder):
    from tidemark.sources.tables import after

    return after(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 25)


@query("""SELECT doc_id, coalesce(quality, 0) < 1 AS low, lang, n_chars FROM documents LEFT JOIN labels USING (doc_id) ORDER BY low, lang, n_chars DESC, doc_id LIMIT 30""")
def o08_review_order(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return rows.select("doc_id", (F.coalesce("quality", F.lit(0)) < 1).alias("low"), "lang", "n_chars").orderBy("low", "lang", F.desc("n_chars"), "doc_id").limit(30)


@query("SELECT doc_id, CASE WHEN lang = '' THEN CAST(doc_id AS VARCHAR) ELSE lang END AS title, 'https://' || source || '.example/' || doc_id AS url FROM documents")
def p04_result_projection(spark, folder):
    title = F.coalesce(F.nullif("lang", F.lit("")), F.col("doc_id").cast("string"))
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"))
    return table(spark, folder, "documents").select("doc_id", title.alias("title"), url.alias("url"))


@query("""SELECT doc_id, 'lang' AS name, lang AS value FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source IS NOT NULL
    UNION ALL SELECT doc_id, 'quality', CAST(quality AS VARCHAR) FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL""")
def p05_provenance(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in ("lang", "source", "quality")])
    return rows.select("doc_id", F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


@query("SELECT doc_id, substring(text, 1, 12000) AS excerpt, length(text) > 12000 AS clipped FROM documents")
def p13_clipped_excerpt(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.substring("text", 1, 12000).alias("excerpt"), (F.length("text") > 12000).alias("clipped"))


@query("""SELECT p_partkey, regexp_replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '(part)', '<em>\\1</em>', 'gi') AS marked FROM part""")
def p16_highlight(spark, folder):
    return table(spark, folder, "part").select("p_partkey", X.marked(F.col("p_name"), "part").alias("marked"))


@query("""SELECT page_id, regexp_replace(url, '/index\\.html$', '') AS url, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages""")
def p08_strip_index(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.without_index("url").alias("url"), U.host("url").alias("host"))
