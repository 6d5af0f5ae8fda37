"""Ledgers and queues in batch form: budgets, states, retries, streaks, lineage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import facets as A
from tidemark.operators import history as H
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_CENTS = "round(value * 100)::BIGINT"


@query(f"""WITH d AS (SELECT ts::DATE AS day, sum({_CENTS})::BIGINT AS spent FROM events GROUP BY 1)
    SELECT day, spent, greatest(least(1500000 - spent, 40000000 - sum(spent) OVER (PARTITION BY date_trunc('month', day) ORDER BY day)::BIGINT), 0) AS remaining FROM d""")
def z04_day_month_budget(spark, folder):
    days = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("spent"))
    month = F.sum("spent").over(Window.partitionBy(F.trunc("day", "month")).orderBy("day"))
    return days.withColumn("remaining", F.greatest(F.least(F.lit(1500000) - F.col("spent"), F.lit(40000000) - month), F.lit(0)))


@query(f"""SELECT event_id, user_id, sum({_CENTS}) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)::BIGINT AS used, sum({_CENTS}) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 12000 AS admitted FROM events""")
def z09_admitted_reservations(spark, folder):
    own = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    used = F.sum(F.round(F.col("value") * 100).cast("bigint")).over(own)
    return table(spark, folder, "events").select("event_id", "user_id", used.alias("used"), (used <= 12000).alias("admitted"))


@query("""SELECT user_id, session, count(*) AS n, min(ts) AS first FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM
    (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR, true) AS gap FROM events)) GROUP BY 1, 2""")
def z08_sessions(spark, folder):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(own) > F.expr("INTERVAL 6 HOUR"), F.lit(True)).cast("int")
    rows = table(spark, folder, "events").withColumn("gap", gap).withColumn("session", F.sum("gap").over(own))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


@query("""WITH f AS (VALUES ('signup', 'view'), ('view', 'click'), ('view', 'view'), ('click', 'purchase'), ('click', 'view'), ('purchase', 'view')), e AS (SELECT user_id, event_type AS now, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT before, now, count(*) AS n, bool_or(f.col0 IS NOT NULL) AS allowed FROM e LEFT JOIN f ON f.col0 = before AND f.col1 = now WHERE before IS NOT NULL GROUP BY 1, 2""")
def z12_transitions(spark, folder):
    allowed = [("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view")]
    moves = table(spark, folder, "events").select(F.col("event_type").alias("now"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before")).where("before is not null")
    known = spark.createDataFrame(allowed, "before string, now string").withColumn("allowed", F.lit(True))
    return moves.groupBy("before", "now").agg(F.count("*").alias("n")).join(F.broadcast(known), ["before", "now"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


@query("""WITH e AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS fixed FROM events GROUP BY 1), f AS (SELECT user_id, count(*) AS attempts, max(ts) AS last FROM events JOIN e USING (user_id) WHERE event_type = 'error' AND (fixed IS NULL OR ts > fixed) GROUP BY 1)
    SELECT user_id, attempts, attempts >= 3 AS quarantined, CASE WHEN attempts < 3 THEN last + INTERVAL 1 DAY END AS retry_at FROM f""")
def z14_quarantine(spark, folder):
    events = table(spark, folder, "events")
    fixed = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("fixed"))
    open_ = events.where("event_type = 'error'").join(fixed, "user_id", "left").where("fixed is null or ts > fixed").groupBy("user_id").agg(F.count("*").alias("attempts"), F.max("ts").alias("last"))
    return open_.select("user_id", "attempts", (F.col("attempts") >= 3).alias("quarantined"), F.when(F.col("attempts") < 3, F.col("last") + F.expr("INTERVAL 1 DAY")).alias("retry_at"))


@query("""WITH k AS (SELECT user_id, sum(exp(-ln(2) * (epoch(m) - epoch(ts)) / 86400)) AS heat, max(ts) AS last FROM events, (SELECT max(ts) AS m FROM events) GROUP BY 1)
    SELECT user_id, round(heat, 6) AS heat, row_number() OVER (ORDER BY round(heat, 6) DESC, last DESC, user_id) AS place FROM k QUALIFY place <= 100""")
def z11_cache_keeps(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "ts", F.col("ts").cast("timestamp").cast("double").alias("t"))
    now = rows.agg(F.max("t")).first()[0]
    heat = F.round(F.sum(F.exp(-F.log(F.lit(2.0)) * (F.lit(now) - F.col("t")) / 86400)), 6)
    kept = rows.groupBy("user_id").agg(heat.alias("heat"), F.max("ts").alias("last"))
    return A.ranked(kept, F.desc("heat"), F.desc("last"), F.asc("user_id"), window=100).select("user_id", "heat", F.col("rank").alias("place"))


@query("SELECT ts::DATE AS day, count(*) AS n, count(*) - lag(count(*)) OVER (ORDER BY ts::DATE) AS change FROM events GROUP BY 1")
def n22_count_change(spark, folder):
    days = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("day")))  # one row a day


@query("""WITH s AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events)
    SELECT user_id, max(n) AS streak, sum(n)::BIGINT AS failures FROM (SELECT user_id, g, count(*) AS n FROM s WHERE bad GROUP BY 1, 2) GROUP BY 1""")
def n19_failure_streaks(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("bad"))
    runs = H.islands(rows, ["user_id"], ["ts", "event_id"], "bad").where("bad").groupBy("user_id", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("streak"), F.sum("n").alias("failures"))


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS waiting, count(*) FILTER (o_orderstatus = 'P') AS retrying, min(o_orderdate) FILTER (o_orderstatus = 'P') AS next_retry, max(o_orderdate) FILTER (o_orderstatus = 'F') AS latest FROM orders")
def n08_publication_summary(spark, folder):
    s = F.col("o_orderstatus")
    return table(spark, folder, "orders").agg(F.count_if(s == "O").alias("waiting"), F.count_if(s == "P").alias("retrying"), F.min(F.when(s == "P", F.col("o_orderdate"))).alias("next_retry"), F.max(F.when(s == "F", F.col("o_orderdate"))).alias("latest"))


@query("SELECT o_custkey, count(*) AS failures, CASE least(count(*), 3) WHEN 1 THEN 300 WHEN 2 THEN 3600 ELSE 86400 END AS delay, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def n07_retry_ladder(spark, folder):
    rows = table(spark, folder, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("failures"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))
    return rows.withColumn("delay", F.element_at(F.array(F.lit(300), F.lit(3600), F.lit(86400)), F.least("failures", F.lit(3)).cast("int")))


@query("SELECT source, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS token FROM documents GROUP BY 1")
def n06_set_token(spark, folder):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sha2(ids, 256).alias("token"))


@query("SELECT p_partkey FROM part WHERE p_size > 45 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def n05_bulk_reject(spark, folder):
    active = table(spark, folder, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, folder, "part").where("p_size > 45").select("p_partkey").join(active, "p_partkey", "left_anti")


@query("""(SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS "at" FROM orders ORDER BY o_orderdate DESC, id LIMIT 8) UNION ALL (SELECT 'event', event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 8) UNION ALL (SELECT 'ship', l_orderkey * 10 + l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, 2 LIMIT 8)""")
def n29_activity(spark, folder):
    parts = [table(spark, folder, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")),
             table(spark, folder, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at")),
             table(spark, folder, "lineitem").select(F.lit("ship").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("at"))]
    top = [p.orderBy(F.desc("at"), "id").limit(8) for p in parts]
    return top[0].unionByName(top[1]).unionByName(top[2])


@query("""WITH RECURSIVE p AS (SELECT a.o_orderkey AS k, b.o_orderkey AS parent FROM orders a LEFT JOIN orders b ON a.o_orderkey % 11 <> 0 AND b.o_orderkey = (a.o_orderkey * 31 + 17) % 15013),
    w AS (SELECT k, parent, 0 AS depth FROM p UNION ALL SELECT w.k, p.parent, depth + 1 FROM w JOIN p ON w.parent = p.k WHERE depth < 101)
    SELECT k, CASE WHEN bool_or(parent IS NULL) AND max(depth) <= 100 THEN max(depth) END::BIGINT AS depth FROM w GROUP BY 1""")
def n10_lineage_depth(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"))
    parent = F.when(F.col("k") % 11 != 0, (F.col("k") * 31 + 17) % 15013)
    return H.lineage(orders.withColumn("parent", parent), "k", "parent", 100)


@query("""SELECT o_orderkey, o_totalprice, sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)::BIGINT AS running FROM orders QUALIFY running <= 100000000""")
def o11_running_budget(spark, folder):
    running = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, folder, "orders").withColumn("running", running).where("running <= 100000000").select("o_orderkey", "o_totalprice", "running")


@query("SELECT user_id, round(value, 2) AS value, ts, event_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) = 1")
def z03_dedup_in_window(spark, folder):
    rows = table(spark, folder, "events").where("event_type = 'purchase'").withColumn("day", F.to_date("ts"))
    return A.first_of(rows, ["user_id", "day"], F.asc("ts"), F.asc("event_id")).select("user_id", F.round("value", 2).alias("value"), "ts", "event_id")
