"""Scans, projections, query syntax, URL rules, small joins and aggregates of the archive's services."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators import facets as A
from tidemark.operators import history as H
from tidemark.operators import lexical as L
from tidemark.plans.registry import query
from tidemark.sources import tables as S
from tidemark.sources.tables import table

TOKENS = "regexp_extract_all(lower(text), '[0-9a-z]+')"
_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


@query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def s14_keyset_scan(spark, folder):
    return S.after(table(spark, folder, "documents").select("doc_id", "source"), "doc_id", 100, 50)


@query("SELECT doc_id FROM documents WHERE doc_id > 40 AND doc_id % 7 < 5 ORDER BY doc_id LIMIT 100")
def s15_policy_lag(spark, folder):
    return S.after(table(spark, folder, "documents").where("doc_id % 7 < 5").select("doc_id"), "doc_id", 40, 100)


@query("SELECT doc_id, lang FROM documents ORDER BY md5('7' || doc_id), doc_id LIMIT 60")
def s17_seeded_sample(spark, folder):
    return S.seeded_sample(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", "7", 60)


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def s18_point_lookup(spark, folder):
    asked = table(spark, folder, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("doc_id"))
    return table(spark, folder, "documents").select("doc_id", "source", "n_chars").join(asked, "doc_id", "left_semi")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def k06_insert_or_ignore(spark, folder):
    return A.first_of(table(spark, folder, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], F.asc("event_id"))


@query("SELECT doc_id, CASE WHEN seq = doc_id % 5 THEN source ELSE lang END AS value, seq = doc_id % 5 AS applied FROM (SELECT *, n_chars % 5 AS seq FROM documents)")
def k03_sequence_guarded_update(spark, folder):
    docs = table(spark, folder, "documents")
    stored = docs.select("doc_id", (F.col("doc_id") % 5).alias("seq"), F.col("lang").alias("value"))
    changes = docs.select("doc_id", (F.col("n_chars") % 5).alias("read_seq"), F.col("source").alias("new"))
    applied = F.col("seq") == F.col("read_seq")
    return stored.join(changes, "doc_id").select("doc_id", F.when(applied, F.col("new")).otherwise(F.col("value")).alias("value"), applied.alias("applied"))


@query(f"SELECT page_id, CASE WHEN contains({_HOST}, '.') AND page_id % 3 > 0 THEN url WHEN page_id % 2 = 0 THEN 'https://archive.example.org/' || page_id END AS citation FROM pages")
def p03_citation_url(spark, folder):
    own = F.when(F.col("page_id") % 3 > 0, F.col("url"))
    other = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://archive.example.org/"), F.col("page_id").cast("string"))).otherwise("ftp://none")
    return table(spark, folder, "pages").select("page_id", F.coalesce(F.when(U.is_safe(own), own), F.when(U.is_safe(other), other)).alias("citation"))


@query("""SELECT doc_id, sha256(CASE WHEN toxic = 1 THEN text || chr(10) || '[image text]' || chr(10) || source ELSE text END) AS body, CASE WHEN toxic = 1 THEN 'text+image' WHEN length(trim(text)) > 0 THEN 'text' ELSE 'none' END AS kind, length(trim(text)) > 0 AS has_text
    FROM documents LEFT JOIN labels USING (doc_id)""")
def p06_document_assembly(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id", "left")
    image, has = F.col("toxic") == 1, F.length(F.trim("text")) > 0
    body = F.when(image, F.concat_ws("\n", "text", F.lit("[image text]"), "source")).otherwise(F.col("text"))
    return rows.select("doc_id", F.sha2(body, 256).alias("body"), F.when(image, "text+image").when(has, "text").otherwise("none").alias("kind"), has.alias("has_text"))


@query(f"SELECT page_id, {_HOST} AS host, '20000101000000' AS captured, substr(CASE WHEN ends_with(p, '/') OR p = '' THEN p || 'index.html' ELSE p END, 2) AS page FROM (SELECT *, {_PATH} AS p FROM pages) WHERE regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) = ''")
def p09_capture_parts(spark, folder):
    path = U.archive_path("url", F.lit("20000101000000"))
    return table(spark, folder, "pages").where(U.query("url") == "").select("page_id", *(c.alias(n) for n, c in S.capture_parts(path).items()))


@query("SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h2>([^<]*)</h2>', 1)), ''), 'Untitled') AS title FROM pages")
def p11_title(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.coalesce(F.nullif(F.trim(F.regexp_extract("html", "<h2>([^<]*)</h2>", 1)), F.lit("")), F.lit("Untitled")).alias("title"))


@query("SELECT conv_id, turn, substr(text, greatest(1, strpos(lower(text), 'de') - 119)::BIGINT, 240) AS part FROM conversations")
def p14_excerpt(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", X.excerpt(F.col("text"), "de").alias("part"))


@query("SELECT doc_id, CASE WHEN lower(trim(s)) NOT IN ('', 'none', 'n/a') THEN trim(s) END AS summary FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' None ' WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE ' ' || source END AS s FROM documents)")
def p18_useful_summary(spark, folder):
    k = F.col("doc_id") % 4
    given = F.when(k == 0, " None ").when(k == 1, "n/a").when(k == 2, "").otherwise(F.concat(F.lit(" "), "source"))
    return table(spark, folder, "documents").select("doc_id", X.useful(given).alias("summary"))


# The characters that the regular expressions of the archive's index reserve, in their order.
@query("""SELECT page_id, regexp_replace(url, '([.?+*|{}()"#@&<>~\\[\\]\\\\])', '\\\\\\1', 'g') AS literal FROM pages""")
def f08_literal_escape(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.regexp_replace("url", r'([.?+*|{}()"#@&<>~\[\]\\])', r"\\$1").alias("literal"))


_ASKED = "CASE turn % 4 WHEN 0 THEN w[1] || ' AND ' || w[2] WHEN 1 THEN '\"' || w[1] || ' OR ' || w[2] || '\" OR ' || w[3] WHEN 2 THEN w[1] || ' NOT ' || w[2] ELSE w[1] || ' ' || w[2] END"
_QUERIES = f"q AS (SELECT conv_id, turn, {_ASKED} AS q FROM (SELECT conv_id, turn, {TOKENS} AS w FROM conversations) WHERE len(w) >= 3)"


def _asked(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", X.words("text").alias("w")).where("size(w) >= 3")
    a, b, c, k = F.col("w")[0], F.col("w")[1], F.col("w")[2], F.col("turn") % 4
    text = F.when(k == 0, F.concat(a, F.lit(" AND "), b)).when(k == 1, F.concat(F.lit('"'), a, F.lit(" OR "), b, F.lit('" OR '), c)).when(k == 2, F.concat(a, F.lit(" NOT "), b)).otherwise(F.concat(a, F.lit(" "), b))
    return rows.select("conv_id", "turn", text.alias("q"))


# The words of these queries are lower-case letters and digits, so their form alone says how they read.
@query(f"""WITH {_QUERIES} SELECT conv_id, turn, turn % 4 = 1 AS constrained FROM q""")
def f15_constraints(spark, folder):
    return _asked(spark, folder).select("conv_id", "turn", L.reading(F.col("q"))["constrained"].alias("constrained"))


@query(f"""WITH {_QUERIES} SELECT conv_id, turn, turn % 4 <> 3 AS syntax FROM q""")
def f16_syntax(spark, folder):
    return _asked(spark, folder).select("conv_id", "turn", L.reading(F.col("q"))["syntax"].alias("syntax"))


@query(f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN w[1] || ' + ' || w[2] WHEN 1 THEN '"' || w[1] || ' OR ' || w[2] || '" | ' || w[3] WHEN 2 THEN w[1] || ' -' || w[2] ELSE w[1] || ' ' || w[2] END AS signs
    FROM (SELECT conv_id, turn, {TOKENS} AS w FROM conversations) WHERE len(w) >= 3""")
def f17_signs(spark, folder):
    return _asked(spark, folder).select("conv_id", "turn", L.reading(F.col("q"))["signs"].alias("signs"))


@query(f"SELECT conv_id, turn, list_has_all(w, ['de', 'la']) AS every, list_has_any(w, ['de', 'la', 'the']) AS some FROM (SELECT conv_id, turn, {TOKENS} AS w FROM conversations)")
def f19_match_operator(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", X.words("text").alias("w"))
    every = F.array_contains("w", "de") & F.array_contains("w", "la")
    return rows.select("conv_id", "turn", every.alias("every"), F.arrays_overlap("w", F.array(*map(F.lit, ("de", "la", "the")))).alias("some"))


@query(f"SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') = 'thther.example.org' AS host, regexp_replace({_HOST}, '^www\\.', '') = 'thther.example.org' AND ({_PATH} = '/en' OR starts_with({_PATH}, '/en/')) AS directory FROM pages")
def f26_scope(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.in_scope("url", "host", "thther.example.org").alias("host"), U.in_scope("url", "directory", "thther.example.org", "/en").alias("directory"))


@query(f"""SELECT page_id, regexp_matches({_HOST}, '^(blog|m)\\.') AS mirror, regexp_matches(lower({_PATH} || e), '\\.(css|js|gif|jpe?g|png|ico|svg|woff2?|zip|exe|mp3|avi)$') AS asset
    FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.html' ELSE '.woff2' END AS e FROM pages) WHERE NOT regexp_matches(url, '[?#]')""")
def f28_assets(spark, folder):
    k = F.col("page_id") % 3
    rows = table(spark, folder, "pages").where(~F.col("url").rlike("[?#]"))
    address = F.concat("url", F.when(k == 0, ".JPG").when(k == 1, ".html").otherwise(".woff2"))
    return rows.select("page_id", U.host("url").rlike(r"^(blog|m)\.").alias("mirror"), U.is_asset(address).alias("asset"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\x00-\\x08\\x0E-\\x1F]', '', 'g')) > 0.05 * length(text) AS control, starts_with(text, '%PDF') OR starts_with(text, 'PK') AS magic FROM documents")
def f31_binary(spark, folder):
    control = F.length(F.regexp_replace("text", r"[^\x00-\x08\x0E-\x1F]", ""))
    return table(spark, folder, "documents").select("doc_id", (control > 0.05 * F.length("text")).alias("control"), (F.startswith("text", F.lit("%PDF")) | F.startswith("text", F.lit("PK"))).alias("magic"))


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') AND quality >= 1 AND n_chars >= 300 AND toxic = 0")
def f32_eligible(spark, folder):
    rows = table(spark, folder, "documents").where("lang IN ('en', 'fr') AND n_chars >= 300")
    return rows.join(table(spark, folder, "labels").where("quality >= 1 AND toxic = 0"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'needs grade' WHEN quality + (1 - toxic) >= 2 THEN 'keep' ELSE 'low' END AS grade FROM documents LEFT JOIN labels USING (doc_id)")
def f34_grade_filter(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("quality").isNull(), "needs grade").when(F.col("quality") + 1 - F.col("toxic") >= 2, "keep").otherwise("low").alias("grade"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')")
def j11_conditional_semi(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    needed = table(spark, folder, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    free = orders.where("o_orderstatus <> 'P'")
    return free.unionByName(orders.where("o_orderstatus = 'P'").join(needed, "o_orderkey", "left_semi")).select("o_orderkey")


@query("SELECT doc_id, quality, toxic, r.h = md5(d.text) AS fresh FROM labels JOIN documents d USING (doc_id) JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 9 = 0 THEN text || ' ' ELSE text END) AS h FROM documents) r USING (doc_id)")
def j16_rating_staleness(spark, folder):
    docs = table(spark, folder, "documents")
    rated = table(spark, folder, "labels").join(docs.select("doc_id", F.md5(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).alias("rated")), "doc_id")
    return rated.join(docs.select("doc_id", F.md5("text").alias("now")), "doc_id").select("doc_id", "quality", "toxic", (F.col("rated") == F.col("now")).alias("fresh"))


@query("WITH m AS (SELECT text, min(conv_id) AS owner FROM conversations GROUP BY 1 HAVING count(DISTINCT conv_id) = 1) SELECT conv_id, turn, owner FROM conversations LEFT JOIN m USING (text)")
def j17_membership(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    owners = rows.groupBy("h").agg(F.min("conv_id").alias("owner"), F.max("conv_id").alias("other")).where("owner = other").drop("other")
    return rows.join(owners, "h", "left").select("conv_id", "turn", "owner")


@query("SELECT conv_id, max(length(text)) AS score, arg_max(turn, (length(text), -turn)) AS best FROM conversations WHERE role <> 'system' GROUP BY 1")
def a37_best_slot(spark, folder):
    size = F.length("text").cast("bigint")
    return table(spark, folder, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.max(size).alias("score"), F.max_by("turn", F.struct(size, -F.col("turn"))).alias("best"))


@query("SELECT o_orderstatus AS state, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, min(o_orderdate) AS since FROM orders GROUP BY 1")
def a24_state_totals(spark, folder):
    return table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"), F.min("o_orderdate").alias("since"))


@query("SELECT source, count(DISTINCT lang) AS langs, count(*) AS n, round(max(c) / count(*)::DOUBLE, 6) AS share FROM (SELECT source, lang, count(*) OVER (PARTITION BY source, lang) AS c FROM documents) GROUP BY 1")
def a41_diversity(spark, folder):
    langs = table(spark, folder, "documents").groupBy("source", "lang").agg(F.count("*").alias("c"))
    return langs.groupBy("source").agg(F.count("*").alias("langs"), F.sum("c").alias("n"), F.round(F.max("c") / F.sum("c"), 6).alias("share"))


@query("""WITH d AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS slot, length(text) % 7 - length(text) % 5 AS delta FROM benchmark), n AS (SELECT count(*) AS n FROM d),
    r AS (SELECT k, (('0x' || substr(md5('17:' || k || ':' || slot), 1, 8))::BIGINT % n) AS slot FROM d, n, range(1000) t(k)), m AS (SELECT k, avg(delta) AS mean FROM r JOIN d USING (slot) GROUP BY 1), o AS (SELECT mean, row_number() OVER (ORDER BY mean, k) AS place FROM m)
    SELECT round(max(mean) FILTER (place = 25), 9) AS low, round(max(mean) FILTER (place = 975), 9) AS high FROM o""")
def a33_paired_bootstrap(spark, folder):
    items = table(spark, folder, "benchmark").select("item_id", (F.length("text") % 7 - F.length("text") % 5).alias("delta"))
    pairs = items.withColumn("at", F.row_number().over(Window.orderBy("item_id")).cast("bigint") - 1)  # one row a judged query
    draws = pairs.crossJoin(F.broadcast(items.agg(F.count("*").alias("n")))).select("at", "n", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("k"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("17"), F.col("k").cast("string"), F.col("at").cast("string"))), 1, 8), 16, 10).cast("bigint") % F.col("n")
    means = draws.select("k", drawn.alias("at")).join(pairs.select("at", "delta"), "at").groupBy("k").agg(F.avg("delta").alias("mean"))
    place = means.withColumn("place", F.row_number().over(Window.orderBy("mean", "k")))  # a thousand rows
    return place.agg(F.round(F.max(F.when(F.col("place") == 25, F.col("mean"))), 9).alias("low"), F.round(F.max(F.when(F.col("place") == 975, F.col("mean"))), 9).alias("high"))


@query("SELECT user_id, array_to_string(list(event_type ORDER BY first), '>') AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def u07_ordered_unique(spark, folder):
    first = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(kinds, ">").alias("kinds"))


@query(f"""SELECT host, name || suffix AS alias FROM (SELECT host, unnest([regexp_replace(host, '^www\\.', ''), 'www.' || regexp_replace(host, '^www\\.', '')]) AS name FROM (SELECT DISTINCT {_HOST} AS host FROM pages)),
    (SELECT unnest(['', ':80', ':443', '_80', '_443']) AS suffix)""")
def u08_aliases(spark, folder):
    hosts = table(spark, folder, "pages").select(U.host("url").alias("host")).distinct()
    bare = F.regexp_replace("host", r"^www\.", "")
    names = F.flatten(F.array(*[F.array(*[F.concat(n, F.lit(x)) for x in U.PORT_SUFFIXES]) for n in (bare, F.concat(F.lit("www."), bare))]))
    return hosts.select("host", F.explode(names).alias("alias"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'x:' || url END AS inner_url FROM pages")
def c02_unwrapped(spark, folder):
    even = F.col("page_id") % 2 == 0
    address = F.when(even, F.concat(F.lit("https://replay.example.org/web/20010203040506id_/"), "url")).otherwise(F.concat(F.lit("x:"), "url"))
    return table(spark, folder, "pages").select("page_id", U.unwrapped(address).alias("inner_url"))


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '<[^>\\n]*>|&#?\\w+;', chr(10), 'g'), 'https?://\\S+|www\\.\\S+', chr(10), 'g'), '\\S+@\\S+\\.\\S+', chr(10), 'g')) AS plain FROM documents WHERE NOT contains(text, '[')""")
def c10_plain(spark, folder):
    return table(spark, folder, "documents").where(~F.contains("text", F.lit("["))).select("doc_id", F.sha2(X.plain("text"), 256).alias("plain"))


@query("SELECT o_orderkey, try_strptime(d, '%Y-%m-%d') IS NOT NULL AND regexp_matches(d, '^\\d{4}-\\d{2}-\\d{2}$') AS valid FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-') || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 1 + (o_orderkey % 2)::INT, '0') AS d FROM orders)")
def d02_strict_dates(spark, folder):
    k = F.col("o_orderkey")
    day = F.when(k % 2 == 0, F.substring((k % 33).cast("string"), 1, 1)).otherwise(F.lpad((k % 33).cast("string"), 2, "0"))
    d = F.concat(F.date_format("o_orderdate", "yyyy-"), F.lpad((k % 14).cast("string"), 2, "0"), F.lit("-"), day)
    strict = d.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return table(spark, folder, "orders").select("o_orderkey", (strict & F.when(strict, d).try_cast("date").isNotNull()).alias("valid"))


@query("SELECT event_id, date_trunc('day', ts) AS day, date_trunc('day', ts) + INTERVAL 1 DAY AS next_day, date_trunc('month', ts)::TIMESTAMP AS month, year(ts) AS year FROM events")
def d04_period_starts(spark, folder):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    month = F.date_trunc("month", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return table(spark, folder, "events").select("event_id", day.alias("day"), (day + F.expr("INTERVAL 1 DAY")).alias("next_day"), month.alias("month"), F.year("ts").cast("bigint").alias("year"))


@query("SELECT user_id, list_contains(k, 'error') AS any_error, NOT list_contains(k, 'purchase') AS no_purchase, len(k) AS kinds, list_min(k) AS first FROM (SELECT user_id, list(DISTINCT event_type) AS k FROM events GROUP BY 1)")
def r01_array_tests(spark, folder):
    kinds = table(spark, folder, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return kinds.select("user_id", F.array_contains("k", "error").alias("any_error"), (~F.array_contains("k", "purchase")).alias("no_purchase"), F.size("k").cast("bigint").alias("kinds"), F.array_min("k").alias("first"))


@query("SELECT day, done, ceil((max(total) OVER () - done) * 86400.0 * row_number() OVER (ORDER BY day) / done)::BIGINT AS eta FROM (SELECT day, sum(n) OVER (ORDER BY day)::BIGINT AS done, sum(n) OVER ()::BIGINT AS total FROM (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1))")
def m07_eta(spark, folder):
    days = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))  # one row a day
    rows = days.select("day", F.sum("n").over(Window.orderBy("day")).alias("done"), F.sum("n").over(Window.partitionBy()).alias("total"), F.row_number().over(Window.orderBy("day")).alias("at"))
    return rows.select("day", "done", F.ceil((F.col("total") - F.col("done")) * 86400.0 * F.col("at") / F.col("done")).cast("bigint").alias("eta"))


@query("""WITH s AS (SELECT doc_id AS k, doc_id % 4 AS version, lang AS v FROM documents), c AS (SELECT doc_id AS k, n_chars % 4 AS version, source AS v FROM documents WHERE doc_id % 3 <> 0)
    SELECT k, CASE WHEN c.version > s.version THEN c.version ELSE s.version END AS version, CASE WHEN c.version > s.version THEN c.v ELSE s.v END AS v FROM s LEFT JOIN c USING (k)""")
def z15_no_downgrade(spark, folder):
    docs = table(spark, folder, "documents")
    stored = docs.select(F.col("doc_id").alias("k"), (F.col("doc_id") % 4).alias("version"), F.col("lang").alias("v"))
    changes = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("k"), (F.col("n_chars") % 4).alias("version"), F.col("source").alias("v"))
    return H.upsert(stored, changes, ["k"], "version")


@query("SELECT event_type, CASE WHEN event_type = 'error' AND value > 50 THEN 'attention' WHEN event_type = 'error' THEN 'retry' WHEN event_type = 'purchase' THEN 'done' ELSE 'waiting' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def n14_import_status(spark, folder):
    kind = F.col("event_type")
    status = F.when((kind == "error") & (F.col("value") > 50), "attention").when(kind == "error", "retry").when(kind == "purchase", "done").otherwise("waiting")
    return table(spark, folder, "events").groupBy("event_type", status.alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'error') AS recorded, max(ts) FILTER (event_type = 'error') AS last, coalesce(max(ts) FILTER (event_type = 'error') > max(ts) FILTER (event_type = 'purchase'), bool_or(event_type = 'error')) AS pending FROM events GROUP BY 1""")
def n28_failure_ledger(spark, folder):
    error = F.col("event_type") == "error"
    failed, fixed = F.max(F.when(error, F.col("ts"))), F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    return table(spark, folder, "events").groupBy("user_id").agg(F.count_if(error).alias("recorded"), failed.alias("last"), F.coalesce(failed > fixed, F.bool_or(error)).alias("pending"))
