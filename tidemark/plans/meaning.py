"""Passages by distance of sentences, and the files that pages need."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import assets as A
from tidemark.operators import semantic as S
from tidemark.plans.registry import query
from tidemark.sources.tables import table

# Counts of letters stand for a model's vectors.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query(rf"""WITH d AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS s, generate_subscripts(list_filter(string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), 1) AS i FROM documents),
    c AS (SELECT *, lower(concat_ws(' ', lag(s) OVER w, s, lead(s) OVER w)) AS t FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    v AS (SELECT doc_id, i, s, list_transform(string_split('{LETTERS}', ''), lambda x: (length(t) - length(replace(t, x, '')))::DOUBLE) AS v FROM c),
    p AS (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM v),
    z AS (SELECT *, CASE WHEN u IS NULL THEN NULL WHEN sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)) = 0 THEN 1 ELSE round(1 - list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))), 9) END AS g FROM p),
    b AS (SELECT *, coalesce((g > round(quantile_cont(g, {S.PERCENTILE}) OVER (PARTITION BY doc_id), 9))::INT, 0) AS b FROM z), n AS (SELECT *, (sum(b) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS chunk FROM b)
    SELECT doc_id, chunk, count(*) AS sentences, sha256(string_agg(s, ' ' ORDER BY i)) AS body_sha256 FROM n GROUP BY 1, 2""")
def t24_semantic_chunks(spark, folder):
    rows = S.sentences(table(spark, folder, "documents"), "doc_id", "text")
    low = F.lower("context")
    counts = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in LETTERS])
    found = S.chunks(rows.withColumn("v", counts), "doc_id", "v")
    return found.select("doc_id", "chunk", "sentences", F.sha2("body", 256).alias("body_sha256"))


_NEEDED = ["/a.png", "/b1.png", "/b2.png", "/css/s.css", "/bg.gif", "/o.swf", "/doc.PDF", "/x?dl=1&y=2", "/st/in.png", "/st/at.png", "/poster.jpg"]


@query("WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) || '://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS origin FROM pages) SELECT page_id, origin || unnest([" + ", ".join(f"'{x}'" for x in _NEEDED) + "]) AS asset FROM p UNION ALL SELECT page_id, 'http://cdn.example.org/' || page_id || '.js' FROM p")
def t31_page_assets(spark, folder):
    """Pages with one file of each kind, some named twice, and links that are none."""
    k = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit("""<!-- <img src="/no1.png"> --><script src=http://cdn.example.org/"""), k, F.lit(""".js>var x='<img src="/no2.png">';</script><IMG alt="a > b" SRC='/a.png' srcset="/b1.png 1x,\n /b2.png 2x"><img src="/a.png#t">
        <link rel="Stylesheet alternate" href=/css/s.css><link rel="next" href="/no3"><body background="/bg.gif"><object data="/o.swf"></object><a href="/doc.PDF">d</a><a download href="/x?dl=1&amp;y=2">d</a><a href="/no4">n</a>
        <style>p{background:url( '/st/in.png' )} q{x:url(data:image/png;base64,AA)}</style><div style="background:url(/st/at.png)"></div><video poster="/poster.jpg"></video><img src="data:image/png;base64,AA">"""))
    pages = table(spark, folder, "pages")
    return A.assets(pages.select("page_id", "url", F.concat("html", extra).alias("html")), "page_id", "url", "html")
