"""Streaming queries, run over all events that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.plans.registry import query
from tidemark.streaming import events as S
from tidemark.streaming import slices as L


def _local(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.col(column).cast("timestamp_ntz"))


#: A window is told once the watermark, a week behind the latest event, has passed its end; only open windows are kept as state.
_CLOSED = "(SELECT max(ts) - INTERVAL 7 DAY AS mark FROM events)"


@query(f"SELECT start, event_type, n FROM (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2), {_CLOSED} WHERE start + INTERVAL 1 DAY <= mark")
def z05_tumbling_windows(spark, folder):
    return _local(S.drained(S.windowed_counts(S.event_stream(spark, folder), "1 day"), "append"), "start")


@query(f"SELECT start, event_type, n FROM (SELECT date_trunc('day', ts) - to_days(d::INT) AS start, event_type, count(*) AS n FROM events, range(7) t(d) GROUP BY 1, 2), {_CLOSED} WHERE start + INTERVAL 7 DAY <= mark")
def z07_sliding_windows(spark, folder):
    return _local(S.drained(S.windowed_counts(S.event_stream(spark, folder), "7 days", "1 day"), "append"), "start")


@query(f"""SELECT user_id, start, n FROM (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS gap FROM events)) GROUP BY user_id, s), {_CLOSED}
    WHERE last + INTERVAL 4 HOUR <= mark""")
def z10_session_windows(spark, folder):
    return _local(S.drained(S.sessions(S.event_stream(spark, folder), "4 hours"), "append"), "start")


@query("SELECT DISTINCT user_id, event_type FROM events")
def z03_stream_dedup(spark, folder):
    return S.drained(S.first_seen(S.event_stream(spark, folder), ["user_id", "event_type"], "60 days"), "append")


@query("SELECT user_id, sum(round(value * 100)::BIGINT)::BIGINT AS cents, count(*) AS n FROM events GROUP BY 1")
def z09_stream_balances(spark, folder):
    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        return batch if before is None else H.latest(before.unionByName(batch), ["user_id"], "n")

    return S.drained(S.balances(S.event_stream(spark, folder)), "update", merge)


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def z02_stream_upsert(spark, folder):
    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = H.latest(batch, ["user_id"], "ts", "event_id")
        return rows if before is None else H.latest(before.unionByName(rows), ["user_id"], "ts", "event_id")

    return _local(S.drained(S.event_stream(spark, folder).select("user_id", "ts", "event_id"), "append", merge), "ts")


# Clicks are done at once; errors fail once and views of even users twice. What fails is tried again an hour later, at most three times, once the watermark (an hour behind the last event) has passed.
_FAILS = "CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'view' AND user_id % 2 = 0 THEN 5 ELSE 0 END"


@query(f"""WITH e AS (SELECT user_id % 16 AS lane, event_id AS work, date_trunc('millisecond', ts) AS ts, {_FAILS} AS fails FROM events), m AS (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 1 HOUR AS mark FROM events),
    t AS (SELECT lane, work, fails, k AS attempt FROM (SELECT *, unnest(range(1, least(fails + 1, 3) + 1)) AS k FROM e), m WHERE k = 1 OR ts + to_hours((k - 1)::INT) <= mark)
    SELECT lane, work, attempt::INT AS attempt, CASE WHEN attempt > fails THEN 'done' WHEN attempt < 3 THEN 'failed' ELSE 'dropped' END AS outcome FROM t""")
def z13_resumed_slices(spark, folder):
    """The events as work of 16 lanes, in slices."""
    fails = F.when(F.col("event_type") == "error", 1).when((F.col("event_type") == "view") & (F.col("user_id") % 2 == 0), 5).otherwise(0)
    stream = S.event_stream(spark, folder).select((F.col("user_id") % 16).alias("lane"), F.col("event_id").alias("work"), F.date_trunc("millisecond", "ts").alias("ts"), fails.alias("fails"))
    return L.worked(stream, "lane").select("lane", "work", "attempt", "outcome")


@query("""SELECT event_type AS grp, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS amount FROM (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1) WHERE event_type <> 'signup' GROUP BY 1""")
def v02_running_totals(spark, folder):
    """Users by their last event, as the events come in; a signup deletes."""
    group = F.when(F.col("event_type") != "signup", F.col("event_type"))
    stream = S.event_stream(spark, folder).select("user_id", F.col("event_id").alias("seq"), group.alias("grp"), F.round(F.col("value") * 100).cast("long").alias("amount"))
    return L.totals(spark, L.deltas(stream, "user_id"))
