"""Planning captures over the link graph of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators import passages as P
from tidemark.operators import planner as C
from tidemark.plans.registry import query
from tidemark.sources.tables import table

# A link names a directory; a directory lists the pages below it, whatever their host. A page without its end tag was cut off and is tried again.
_GRAPH = """p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+(/[a-z]+)/', 1) AS below, regexp_matches(html, '</html>\\s*$') AS whole FROM pages),
    e AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, '<a href="(/[^"#]*)"', 1)) AS target FROM pages UNION SELECT DISTINCT below, url FROM p WHERE below <> ''),
    r AS (SELECT url, CASE WHEN whole THEN 'ok' ELSE 'busy' END AS outcome FROM p UNION SELECT DISTINCT below, 'ok' FROM p WHERE below <> ''),
    s AS (SELECT DISTINCT CASE WHEN url LIKE 'https:%' THEN 'https' ELSE 'http' END AS site, url FROM p WHERE page_id % 50 = 0),
    t AS (SELECT DISTINCT u.url, CASE WHEN regexp_matches(u.url, '^https?://(spam|blog)[.-]') THEN 'excluded' WHEN outcome = 'ok' THEN 'captured' WHEN outcome = 'busy' THEN 'retry' ELSE 'unavailable' END AS state
          FROM (SELECT url FROM p UNION SELECT target FROM e) u LEFT JOIN r ON r.url = u.url)"""
_REACH = f"WITH RECURSIVE {_GRAPH}, f AS (SELECT site, url FROM s UNION SELECT f.site, e.target FROM f JOIN t ON t.url = f.url AND t.state = 'captured' JOIN e ON e.url = f.url)"


def _inputs(spark, folder):
    pages = table(spark, folder, "pages")
    below = F.regexp_extract("url", r"^https?://[^/]+(/[a-z]+)/", 1)
    rows = pages.select("page_id", "url", below.alias("below"), F.col("html").rlike(r"</html>\s*$").alias("whole"))
    roots = P.links(pages, "page_id", "url", "html").join(rows.select("page_id", "url"), "page_id").select("url", U.path("target").alias("target"))
    listed = rows.where("below <> ''")
    edges = roots.union(listed.select("below", "url"))
    outcome = F.when(F.col("whole"), "ok").otherwise("busy")
    records = rows.select("url", outcome.alias("outcome"), F.lit(1).alias("attempts")).union(listed.select("below", F.lit("ok"), F.lit(1)).distinct())
    seeds = rows.where("page_id % 50 = 0").select(U.scheme("url").alias("site"), "url")
    return seeds, edges, records, rows.select("url").where(F.col("url").rlike(r"^https?://(spam|blog)[.-]"))


@query(f"{_REACH} SELECT f.site, f.url, t.state FROM f JOIN t ON t.url = f.url")
def t36_capture_plan(spark, folder):
    return C.plan(*_inputs(spark, folder)).select("site", "url", "state")


@query(f"""{_REACH} SELECT site, count(*) AS found, count(*) FILTER (state <> 'retry') AS checked, 0::BIGINT AS pending, count(*) FILTER (state = 'captured') AS captured,
    count(*) FILTER (state = 'unavailable') AS unavailable, count(*) FILTER (state = 'retry') AS retry, count(*) FILTER (state = 'excluded') AS excluded FROM f JOIN t ON t.url = f.url GROUP BY 1""")
def t36_capture_progress(spark, folder):
    """A plan in two slices, the second continuing the first, counted by state."""
    seeds, edges, records, excluded = _inputs(spark, folder)
    first = C.plan(seeds, edges, records, excluded, rounds=2)
    return C.progress(C.plan(seeds, edges, records, excluded, known=first))
