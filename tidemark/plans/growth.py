"""Link-graph growth over captured pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import growth as G
from tidemark.operators import passages as P
from tidemark.plans.registry import query
from tidemark.sources.tables import table

# Three pages are a candidate, graded by their paragraphs; every fifth page was scanned before.
READS, BYTES = 50, 60_000
_RUN = f"""p AS (SELECT page_id, page_id // 3 AS candidate, strlen(html) AS bytes, len(regexp_extract_all(html, '<p>')) // 3 AS grade, page_id % 5 <> 0 AS fresh, page_id || '.html' AS path FROM pages),
    n AS (SELECT candidate, max(grade) AS grade, sum(bytes) AS total, coalesce(list(bytes ORDER BY path) FILTER (fresh), []) AS own FROM p GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY grade DESC, candidate) AS i FROM n WHERE grade >= {G.GRADE}),
    r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS candidate, 0::BIGINT AS taken, 0::BIGINT AS reads, 0::HUGEINT AS size
          UNION ALL SELECT o.i, o.candidate, t, reads + t, size + coalesce(list_sum(own[1:t]), 0) FROM (SELECT r.reads, r.size, o.*, CASE WHEN r.reads >= {READS} OR r.size >= {BYTES} OR o.total + r.size > {BYTES} THEN 0 ELSE least(len(own), {READS} - r.reads) END AS t FROM r JOIN o ON o.i = r.i + 1) o),
    f AS (SELECT p.*, row_number() OVER (PARTITION BY candidate ORDER BY path) AS place FROM p WHERE fresh),
    g AS (SELECT f.page_id, f.path, f.bytes, f.grade FROM f JOIN r ON r.candidate = f.candidate WHERE place <= taken)"""


def _inputs(spark, folder):
    pages = table(spark, folder, "pages")
    paths = pages.select("page_id", "url", "html", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"))
    captures = paths.select(
        F.floor(F.col("page_id") / 3).alias("candidate"), "page_id", "path", "url", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"),
        F.floor(F.regexp_count("html", F.lit("<p>")) / 3).alias("grade"))
    return paths, captures, captures.where("page_id % 5 = 0").select("sha256", "path")


@query(f"WITH RECURSIVE {_RUN} SELECT page_id, bytes, grade FROM g")
def n11_read_sources(spark, folder):
    _, captures, scans = _inputs(spark, folder)
    return G.reads(captures, scans, READS, BYTES).select("page_id", "bytes", "grade")


@query(f"""WITH RECURSIVE {_RUN} SELECT 'http://other' || (page_id % 4) || '.example.org/p' || (page_id % 9) AS target, path, 'first' AS anchor, grade FROM g WHERE page_id % 4 <> 1""")
def n11_grown_links(spark, folder):
    """Links to another site, twice on each page, beside an asset; those of every fourth page are known."""
    paths, captures, scans = _inputs(spark, folder)
    k = F.col("page_id")
    other = F.concat(F.lit("http://other"), (k % 4).cast("string"), F.lit(".example.org/p"), (k % 9).cast("string"))
    html = F.concat("html", F.lit('<a href="'), other, F.lit('">first</a> <a href="'), other, F.lit('#x">second</a> <a href="http://cdn.example.org/a.css">style</a>'))
    links = P.links(paths.select("page_id", "url", html.alias("html")), "page_id", "url", "html").withColumn("path", F.concat(k.cast("string"), F.lit(".html")))
    known = paths.where("page_id % 4 = 1").select(other.alias("target"), "path")
    return G.grown(G.reads(captures, scans, READS, BYTES), links, known).select("target", "path", "anchor", "grade")
