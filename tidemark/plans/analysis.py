"""Text analysis: tokens, phrases, scalar functions, dates, JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators import facets as A
from tidemark.operators import lexical as L
from tidemark.operators import phrases as P
from tidemark.plans.registry import query
from tidemark.sources.tables import table

TOKENS = "regexp_extract_all(lower(text), '[0-9a-z]+')"


@query(f"SELECT conv_id, turn, len({TOKENS}) AS n, len(list_distinct({TOKENS})) AS kinds, array_to_string({TOKENS}[1:12], ' ') AS start FROM conversations")
def c11_tokens(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", X.words("text").alias("w"))
    return rows.select("conv_id", "turn", F.size("w").cast("bigint").alias("n"), F.size(F.array_distinct("w")).cast("bigint").alias("kinds"), F.array_join(F.slice("w", 1, 12), " ").alias("start"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS folded FROM documents")
def c08_digests(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.lower(X.collapsed("text")).alias("folded"))


@query("""SELECT conv_id, turn, count(*) AS sentences, max(length(trim(s))) AS longest FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[.!?;|]+')) AS s FROM conversations) WHERE trim(s) <> '' GROUP BY 1, 2""")
def c12_sentences(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.explode(F.split("text", "[.!?;|]+")).alias("s")).where(F.trim("s") != "")
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("sentences"), F.max(F.length(F.trim("s"))).cast("bigint").alias("longest"))


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), g AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t))
    SELECT gram, count(*) AS docs FROM g GROUP BY 1 HAVING count(*) >= 5""")
def c13_bigrams(spark, folder):
    return P.counted(table(spark, folder, "documents"), "doc_id", "text", 2, 5).select(F.col("phrase").alias("gram"), F.col("pages").alias("docs"))


@query(f"""WITH d AS (SELECT doc_id, source, list_distinct({TOKENS}) AS w FROM documents), q AS (SELECT item_id, list_distinct({TOKENS}) AS v FROM benchmark),
    s AS (SELECT item_id, source, doc_id, coalesce(list_sum(list_transform(list_intersect(v, w), lambda x: length(x))), 0)::BIGINT AS score FROM q, d)
    SELECT item_id, source, max(score) AS score, arg_max(doc_id, (score, -doc_id)) AS doc_id FROM s GROUP BY 1, 2""")
def c14_overlap_best(spark, folder):
    return L.overlap_best(table(spark, folder, "documents"), table(spark, folder, "benchmark"), "doc_id", "source", "text", "item_id", "text")


@query("SELECT doc_id, array_to_string(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:48], ' ') AS short FROM documents")
def c15_shortened(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.shortened("text", 48).alias("short"))


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(regexp_replace(d.text, '\\s+', ' ', 'g'), regexp_replace(b.text, '\\s+', ' ', 'g'))""")
def c16_verbatim_excerpts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", X.collapsed("text").alias("t"))
    items = table(spark, folder, "benchmark").select("item_id", X.collapsed("text").alias("s"))
    # An excerpt's first three words must stand in the text: an equi join before the exact test.
    start = F.array_join(F.slice(F.split("s", " "), 1, 3), " ")
    keyed = items.withColumn("key", start)
    grams = docs.select("doc_id", F.explode(F.array_distinct(X.ngrams(F.split("t", " "), 3))).alias("key")).join(keyed, "key")
    return grams.join(docs, "doc_id").where(F.contains("t", F.col("s"))).select("doc_id", "item_id")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT doc_id + 1 AS doc_id, line FROM l)
    SELECT doc_id, count(*) FILTER (side = 1) AS added, count(*) FILTER (side = 2) AS removed FROM (SELECT doc_id, line, 1 AS side FROM (SELECT DISTINCT * FROM l EXCEPT SELECT * FROM b) UNION ALL SELECT doc_id, line, 2 FROM (SELECT DISTINCT * FROM b EXCEPT SELECT * FROM l)) GROUP BY 1""")
def c17_line_diff(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.array_distinct(F.split("text", "\n")).alias("lines"))
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("lines").alias("old"))
    rows = docs.join(before, "doc_id", "full").select("doc_id", F.coalesce("lines", F.array()).alias("new"), F.coalesce("old", F.array()).alias("old"))
    added, removed = F.size(F.array_except("new", "old")).cast("bigint"), F.size(F.array_except("old", "new")).cast("bigint")
    return rows.select("doc_id", added.alias("added"), removed.alias("removed")).where("added > 0 or removed > 0")


@query("""SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS host,
    regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query, regexp_replace(url, '#.*$', '') AS canonical FROM pages""")
def c01_url_parts(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.scheme("url").alias("scheme"), U.bare_host("url").alias("host"), U.path("url").alias("path"), U.query("url").alias("query"), U.canonical("url").alias("canonical"))


@query("""SELECT page_id, 'websites/' || regexp_extract(url, '^https?://([^/:?#]+)', 1) || '/20000101000000' || p || CASE WHEN ends_with(p, '/') THEN 'index.html' ELSE '' END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS path
    FROM (SELECT *, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages)""")
def c06_archive_path(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.archive_path("url", F.lit("20000101000000")).alias("path"))


@query("""SELECT page_id, split_part(p, '=', 1) AS key, split_part(p, '=', 2) AS value FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&')) AS p FROM pages) WHERE p <> ''""")
def c03_parameters(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.explode(U.parameters("url")))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') AS ts14, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch(o_orderdate)::BIGINT AS seconds, date_trunc('month', o_orderdate)::DATE AS month, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS reset FROM orders""")
def d01_dates(spark, folder):
    day = F.col("o_orderdate").cast("date")
    return table(spark, folder, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("ts14"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("seconds"), F.trunc(day, "month").alias("month"), F.add_months(F.trunc(day, "month"), 1).alias("reset"))


@query("""SELECT l, count(*) AS n FROM (SELECT unnest([CASE WHEN ts >= m - INTERVAL 1 DAY THEN 'day' END, CASE WHEN ts >= m - INTERVAL 7 DAY THEN 'week' END, CASE WHEN ts >= m - INTERVAL 30 DAY THEN 'month' END, 'all']) AS l FROM events, (SELECT max(ts) AS m FROM events)) WHERE l IS NOT NULL GROUP BY 1""")
def d05_recency(spark, folder):
    rows = table(spark, folder, "events").select("ts")
    now = F.lit(rows.agg(F.max("ts").cast("string")).first()[0]).cast("timestamp_ntz")
    named = {name: F.col("ts") >= now - F.expr(f"INTERVAL {days} DAY") for name, days in (("day", 1), ("week", 7), ("month", 30))}
    return A.named_counts(rows, named | {"all": F.lit(True)}).withColumnRenamed("label", "l")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS n FROM events")
def x01_json(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.size(F.json_object_keys("props")).cast("bigint").alias("n"))


@query("""SELECT event_id, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS typed, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 50, false) AS in_range FROM events""")
def x03_json_checks(spark, folder):
    k = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").select("event_id", F.coalesce(k.rlike(r"^-?\d+$"), F.lit(False)).alias("typed"), F.coalesce(k.try_cast("bigint").between(0, 50), F.lit(False)).alias("in_range"))


@query("SELECT l_orderkey, l_linenumber, ceil(round(l_extendedprice * 1000000000))::BIGINT AS nanos, ceil(100.0 * l_quantity / 50)::BIGINT AS percent FROM lineitem")
def m06_money(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.ceil(F.round(F.col("l_extendedprice") * 1000000000)).cast("bigint").alias("nanos"), F.ceil(F.lit(100.0) * F.col("l_quantity") / 50).cast("bigint").alias("percent"))


@query("""SELECT user_id, round(sum(exp(-ln(2) * (epoch(m) - epoch(ts)) / 86400)), 6) AS heat FROM events, (SELECT max(ts) AS m FROM events) GROUP BY 1""")
def m02_decayed_heat(spark, folder):
    rows = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    now = rows.agg(F.max("t")).first()[0]
    return rows.groupBy("user_id").agg(F.round(F.sum(F.exp(-F.log(F.lit(2.0)) * (F.lit(now) - F.col("t")) / 86400)), 6).alias("heat"))


@query("SELECT o_orderkey, least(30, 2 * CAST(substr(o_orderpriority, 1, 1) AS INT)) AS backoff, CASE WHEN o_orderstatus = 'F' THEN 300 ELSE 86400 END AS retry FROM orders")
def m03_backoff(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.least(F.lit(30), 2 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("backoff"), F.when(F.col("o_orderstatus") == "F", 300).otherwise(86400).alias("retry"))


@query("SELECT p_partkey, p_name LIKE '%1%' AS has_one, length(p_name) - length(replace(lower(p_name), 'a', '')) AS count_a, replace(replace(p_type, '&', '&amp;'), '<', '&lt;') AS escaped FROM part")
def c20_escape(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.contains("p_name", F.lit("1")).alias("has_one"), F.regexp_count(F.lower("p_name"), F.lit("a")).cast("bigint").alias("count_a"), X.escaped("p_type").alias("escaped"))


@query("""WITH l AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), d AS (SELECT DISTINCT source, doc_id, line FROM l WHERE line <> ''), n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1),
    g AS (SELECT source, line, count(*) AS c FROM d GROUP BY 1, 2), e AS (SELECT line, count(*) AS c, (SELECT count(*) FROM documents) AS total FROM d GROUP BY 1)
    SELECT line FROM g JOIN n USING (source) WHERE pages >= 3 AND c >= greatest(3, ceil(0.6 * pages)) UNION SELECT line FROM e WHERE length(line) < 200 AND c >= greatest(5, ceil(0.05 * total))""")
def a18_boilerplate_lines(spark, folder):
    return P.boilerplate(P.page_lines(table(spark, folder, "documents"), "doc_id", "source", "text"))


@query(f"""WITH t AS (SELECT doc_id, source, {TOKENS} AS w FROM documents), g AS (SELECT DISTINCT doc_id, source, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase FROM (SELECT doc_id, source, w, unnest(range(1, len(w) - 1)) AS i FROM t))
    SELECT phrase, count(*) AS pages, count(DISTINCT source) AS sites, max(c) AS most FROM (SELECT *, count(*) OVER (PARTITION BY phrase, source) AS c FROM g) GROUP BY 1 HAVING count(*) >= 4""")
def a17_phrase_frequencies(spark, folder):
    return P.frequent(table(spark, folder, "documents"), "doc_id", "source", "text", 3, 4)


@query()
def q16_distinctive_phrases(spark, folder):
    return P.distinctive(table(spark, folder, "documents"), "doc_id", "source", "text", seed="7")


@query("SELECT p_size, count(*) AS n, round(count(*) / max(count(*)) OVER ()::DOUBLE, 6) AS bar FROM part GROUP BY 1")
def n21_chart_bars(spark, folder):
    sizes = table(spark, folder, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return sizes.withColumn("bar", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 6))  # one row a size
