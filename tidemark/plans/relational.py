"""Joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import facets as A
from tidemark.operators import history as H
from tidemark.plans.registry import query
from tidemark.sources.tables import table


@query("""SELECT o_orderkey, max(l_extendedprice) AS best, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def j01_best_child(spark, folder):
    items = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("best"), F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("line"))
    return table(spark, folder, "orders").select("o_orderkey").join(items, "o_orderkey")


@query("""SELECT c_custkey, coalesce(o.n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def j02_left_join(spark, folder):
    n = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, folder, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT l.l_orderkey, l.l_linenumber, r.l_orderkey IS NOT NULL AS held FROM lineitem l
    LEFT JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') r ON r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber""")
def j03_held_flag(spark, folder):
    items = table(spark, folder, "lineitem")
    held = items.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.lit(True).alias("held"))
    return items.select("l_orderkey", "l_linenumber").join(held, ["l_orderkey", "l_linenumber"], "left").withColumn("held", F.col("held").isNotNull())


@query("""SELECT o_orderkey, u.line AS l_linenumber, u.part AS p_partkey, p_brand FROM (SELECT l_orderkey AS o_orderkey, unnest(list({'line': l_linenumber, 'part': l_partkey})) AS u FROM lineitem GROUP BY 1) JOIN part ON p_partkey = u.part""")
def j04_unnest_join(spark, folder):
    nested = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("p_partkey"))).alias("items"))
    return nested.select("o_orderkey", F.inline("items")).join(table(spark, folder, "part").select("p_partkey", "p_brand"), "p_partkey")


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT'")
def j05_inner_join(spark, folder):
    people = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").join(people, "o_custkey").select("o_orderkey")


@query("""SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic = 1""")
def j06_left_null_or(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return rows.where(F.col("quality").isNull() | (F.col("toxic") == 1)).select("doc_id")


@query("""SELECT n_name, count(*) AS n, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def j07_three_way(spark, folder):
    people = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")).join(people, "c_custkey").join(table(spark, folder, "nation"), "n_nationkey")
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("customers"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def j08_exists(spark, folder):
    big = table(spark, folder, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, folder, "orders").select("o_orderkey").join(big, "o_orderkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j09_not_exists(spark, folder):
    return table(spark, folder, "customer").select("c_custkey").join(table(spark, folder, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def j10_in_not_in(spark, folder):
    items = table(spark, folder, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    rows = table(spark, folder, "part").select("p_partkey").join(items.where("l_returnflag = 'R'").select("p_partkey"), "p_partkey", "left_semi")
    return rows.join(items.where("l_quantity = 50").select("p_partkey"), "p_partkey", "left_anti")


@query("""WITH u AS (SELECT s_nationkey AS k, s_suppkey AS id, s_acctbal AS bal, 0 AS side FROM supplier UNION ALL SELECT c_nationkey, c_custkey, c_acctbal, 1 FROM customer)
    SELECT k, id, bal, side FROM u QUALIFY row_number() OVER (PARTITION BY k, id ORDER BY side) = 1""")
def j12_merge_union(spark, folder):
    near = table(spark, folder, "supplier").selectExpr("s_nationkey AS k", "s_suppkey AS id", "s_acctbal AS bal", "0 AS side")
    far = table(spark, folder, "customer").selectExpr("c_nationkey AS k", "c_custkey AS id", "c_acctbal AS bal", "1 AS side")
    return A.first_of(near.unionByName(far), ["k", "id"], F.asc("side"))


@query("""WITH t AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 20)
    SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS priorities, min(o_orderdate) AS first FROM orders WHERE o_custkey IN (SELECT o_custkey FROM t) GROUP BY 1""")
def j14_two_phase(spark, folder):
    orders = table(spark, folder, "orders")
    top = orders.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(20).select("o_custkey")
    kept = orders.join(F.broadcast(top), "o_custkey", "left_semi")  # twenty rows
    return kept.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("priorities"), F.min("o_orderdate").alias("first"))


@query("""WITH a AS (SELECT doc_id AS k, md5(text) AS h FROM documents WHERE lang <> 'fr'), b AS (SELECT doc_id AS k, CASE WHEN source = 'src3' THEN md5(upper(text)) ELSE md5(text) END AS h FROM documents WHERE lang <> 'es')
    SELECT k, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (k)""")
def j15_before_after(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "k")
    before = docs.where("lang <> 'fr'").select("k", F.md5("text").alias("h"))
    after = docs.where("lang <> 'es'").select("k", F.when(F.col("source") == "src3", F.md5(F.upper("text"))).otherwise(F.md5("text")).alias("h"))
    return H.collisions(before, after, "k", "h")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages), d AS (SELECT DISTINCT path FROM p WHERE path LIKE '/__/%' UNION SELECT '/en' UNION SELECT '/de')
    SELECT page_id, d.path AS scope FROM p JOIN d ON p.path = d.path OR starts_with(p.path, d.path || '/')""")
def j19_prefix_join(spark, folder):
    from tidemark.functions import urls as U

    pages = table(spark, folder, "pages").select("page_id", U.path("url").alias("path"))
    scopes = pages.where(F.col("path").like("/__/%")).select(F.col("path").alias("scope")).union(spark.createDataFrame([("/en",), ("/de",)], "scope string")).distinct()
    parts = F.split("path", "/")
    # Each path meets its own prefixes only: an equi join instead of a comparison of all pairs.
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return pages.select("page_id", F.explode(prefixes).alias("scope")).join(scopes, "scope").select("page_id", "scope")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand >= 'Brand#2' AND p_brand < 'Brand#3'")
def j20_key_range(spark, folder):
    return table(spark, folder, "part").where("p_brand >= 'Brand#2' AND p_brand < 'Brand#3'").select("p_partkey", "p_brand")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def j21_latest_state(spark, folder):
    return H.latest(table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1) AS k FROM pages)
    SELECT * FROM (SELECT page_id, count(*) OVER (PARTITION BY k) - 1 AS others, lag(page_id) OVER (PARTITION BY k ORDER BY page_id) AS before FROM p) WHERE others > 0""")
def j22_other_captures(spark, folder):
    keyed = table(spark, folder, "pages").select("page_id", F.regexp_extract("url", r"([^/?#]+)/?(?:[?#].*)?$", 1).alias("k"))
    own = Window.partitionBy("k")
    return keyed.select("page_id", (F.count("*").over(own) - 1).alias("others"), F.lag("page_id").over(own.orderBy("page_id")).alias("before")).where("others > 0")


@query("""SELECT doc_id, source, owner FROM (SELECT doc_id, source, first_value(doc_id) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS owner FROM documents) WHERE doc_id <> owner""")
def j24_first_owner(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    owners = docs.groupBy("source").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id"))).alias("owner"))
    return docs.join(owners, "source").where("doc_id <> owner").select("doc_id", "source", "owner")


@query("""SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors, coalesce(sum(CASE WHEN event_type = 'purchase' THEN round(value * 100)::BIGINT END), 0)::BIGINT AS cents FROM events GROUP BY 1""")
def a19_conditional_sums(spark, folder):
    cents = F.sum(F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("bigint")))
    return table(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.coalesce(cents, F.lit(0)).alias("cents"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def a20_rollup(spark, folder):
    return table(spark, folder, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT user_id, max(CASE WHEN event_type = 'error' THEN ts END) AS last_error FROM events GROUP BY 1 HAVING max(CASE WHEN event_type = 'error' THEN ts END) <= TIMESTAMP '2024-01-29'")
def a21_having(spark, folder):
    last = F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("last_error")
    return table(spark, folder, "events").groupBy("user_id").agg(last).where("last_error <= TIMESTAMP_NTZ'2024-01-29'")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def a22_count_distinct(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))


@query("SELECT l_orderkey, min(coalesce(nullif(l_linenumber, 1), 3))::INT AS tier FROM lineitem GROUP BY 1")
def a23_array_min(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"))
    return lines.select("l_orderkey", F.array_min(F.transform("lines", lambda x: F.coalesce(F.nullif(x, F.lit(1)), F.lit(3)))).alias("tier"))


@query("SELECT event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def a25_progress_counters(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def a31_nearest_rank(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("SELECT c_mktsegment, n_name, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY CUBE (c_mktsegment, n_name)")
def a32_cube(spark, folder):
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, folder, "customer").join(nations, "c_nationkey").cube("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT user_id FROM s GROUP BY 1 HAVING count(*) = 5), m AS (SELECT event_type, round(avg(n), 6) AS mean FROM s JOIN w USING (user_id) GROUP BY 1)
    SELECT event_type, mean, rank() OVER (ORDER BY mean DESC) AS place FROM m""")
def a34_common_leaderboard(spark, folder):
    scores = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    whole = scores.groupBy("user_id").agg(F.count("*").alias("types")).where("types = 5").select("user_id")
    means = scores.join(whole, "user_id", "left_semi").groupBy("event_type").agg(F.round(F.avg("n"), 6).alias("mean"))
    return means.withColumn("place", F.rank().over(Window.orderBy(F.desc("mean"))).cast("bigint"))  # one row a type


@query("""WITH m AS (SELECT year(o_orderdate) AS y, o_orderpriority AS p, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), b AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS base FROM orders GROUP BY 1)
    SELECT y::INT AS year, p AS priority, round(v / base - 1, 6) AS change FROM m JOIN b USING (p) WHERE v / base - 1 < -0.01""")
def a35_regressions(spark, folder):
    orders = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    base = orders.groupBy("priority").agg(F.avg("o_totalprice").alias("base"))
    rows = orders.groupBy("year", "priority").agg(F.avg("o_totalprice").alias("v")).join(base, "priority").withColumn("change", F.col("v") / F.col("base") - 1)
    return rows.where("change < -0.01").select("year", "priority", F.round("change", 6).alias("change"))


@query("SELECT md5(regexp_replace(text, '\\s+', ' ', 'g')) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE trim(text) <> '' GROUP BY 1")
def a39_distinct_content(spark, folder):
    docs = table(spark, folder, "documents").where(F.trim("text") != "").select("doc_id", F.md5(F.regexp_replace("text", r"\s+", " ")).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT user_id, event_id, row_number() OVER w AS done, CASE WHEN count(*) OVER w30 > 1 THEN CAST(ceil(100.0 * (epoch_us(ts) - min(epoch_us(ts)) OVER w30) / 1000000 / (count(*) OVER w30 - 1)) AS BIGINT) END AS eta
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), w30 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 29 PRECEDING)""")
def a40_sliding_eta(spark, folder):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = w.rowsBetween(-29, 0)
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    eta = F.ceil(F.lit(100.0) * (seconds - F.min(seconds).over(last)) / 1000000 / (F.count("*").over(last) - 1))
    return table(spark, folder, "events").select("user_id", "event_id", F.row_number().over(w).cast("bigint").alias("done"), F.when(F.count("*").over(last) > 1, eta).alias("eta"))


@query("""WITH r AS (SELECT o_orderstatus AS tier, o_custkey AS host, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS turn FROM orders) SELECT tier, turn, host, o_orderkey FROM r ORDER BY tier, turn, host LIMIT 200""")
def w01_round_robin(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("tier"), F.col("o_custkey").alias("host"), "o_orderkey", "o_totalprice")
    turn = F.row_number().over(Window.partitionBy("tier", "host").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("bigint")
    return rows.withColumn("turn", turn).select("tier", "turn", "host", "o_orderkey").orderBy("tier", "turn", "host").limit(200)


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) <= 4")
def w02_group_cap(spark, folder):
    return A.top_of(table(spark, folder, "documents").select("source", "doc_id", "n_chars"), ["source"], 4, F.asc("n_chars"), F.asc("doc_id")).select("source", "doc_id")


@query("SELECT md5(text) AS h, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) = 1")
def w03_first_seen(spark, folder):
    docs = table(spark, folder, "documents").select(F.md5("text").alias("h"), "doc_id", "n_chars")
    return docs.groupBy("h").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id"))).alias("doc_id"))


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS b FROM conversations)
    SELECT conv_id, turn, round(0.3 / (10 + a) + 0.7 / (10 + b), 9) AS blend FROM r""")
def w05_blend(spark, folder):
    own = Window.partitionBy("conv_id")
    a, b = F.row_number().over(own.orderBy("turn")), F.row_number().over(own.orderBy(F.desc(F.length("text")), "turn"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.round(F.lit(0.3) / (a + 10) + F.lit(0.7) / (b + 10), 9).alias("blend"))


@query("""SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after, coalesce(role = lag(role) OVER w, false) AS same FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def w08_neighbours(spark, folder):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, folder, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"), F.coalesce(F.col("role") == F.lag("role").over(w), F.lit(False)).alias("same"))


@query("""WITH s AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events)
    SELECT user_id, bad, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, bad, g""")
def w10_runs(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("bad"))
    return H.islands(rows, ["user_id"], ["ts", "event_id"], "bad").groupBy("user_id", "bad", "run").agg(F.min("ts").alias("first"), F.count("*").alias("n")).drop("run")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus = 'P', o_orderdate, o_orderkey) AS place FROM orders""")
def w11_fifo_with_holds(spark, folder):
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.col("o_orderstatus") == "P", "o_orderdate", "o_orderkey"))
    return table(spark, folder, "orders").select("o_orderkey", place.cast("bigint").alias("place"))


@query("SELECT s_nationkey AS k, 'supplier' AS side FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer")
def u01_union_all(spark, folder):
    return table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("side")).unionByName(table(spark, folder, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("side")))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' UNION SELECT p_partkey FROM part WHERE p_size > 40")
def u03_union_distinct(spark, folder):
    return table(spark, folder, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")).union(table(spark, folder, "part").where("p_size > 40").select("p_partkey")).distinct()


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def u04_difference(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, folder, "lineitem").where("l_quantity > 48").select("l_partkey"))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity < 10")
def u05_intersection(spark, folder):
    items = table(spark, folder, "lineitem")
    return items.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(items.where("l_linestatus = 'F' AND l_quantity < 10").select("l_partkey"))


@query("""SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS subset, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS covers""")
def u06_set_checks(spark, folder):
    a, b = table(spark, folder, "orders").select(F.col("o_custkey").alias("k")).distinct(), table(spark, folder, "customer").select(F.col("c_custkey").alias("k")).distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "k", "full")
    return both.agg((F.count_if(F.col("b").isNull()) == 0).alias("subset"), (F.count_if(F.col("a").isNull()) == 0).alias("covers"))
