"""Readable views of captured pages, scripts, table chunks and packed fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import fragments as G
from tidemark.operators import pageview as V
from tidemark.operators import passages as P
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_LINE_TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"


@query()
def t06_page_markdown(spark, folder):
    """Every page in Markdown; tests compare with a plain walk of its tree."""
    return V.markdown(V.page_blocks(table(spark, folder, "pages"), "page_id", "html"), "page_id")


@query("""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor FROM pages) SELECT page_id, count(*) AS links, sum(length(anchor))::BIGINT AS linked FROM p GROUP BY 1""")
def t06_linked_items(spark, folder):
    """Links that the page view keeps as items of lists, with the length of their anchors."""
    rows = V.page_blocks(table(spark, folder, "pages"), "page_id", "html").where("kind = 'item' AND text RLIKE '^\\\\[.*\\\\]\\\\(.*\\\\)$'")
    return rows.groupBy("page_id").agg(F.count("*").alias("links"), F.sum(F.length(F.regexp_extract("text", r"^\[(.*)\]\(", 1))).alias("linked"))


# A script that writes another one: its string holds a closing tag.
@query("""SELECT page_id, 1::BIGINT AS isolated, sha256(regexp_replace(html, '<script>var t=.*?track\\(\\d+\\);</script>', '<script></script>')) AS html_sha256 FROM pages""")
def t07_isolated_scripts(spark, folder):
    written = F.regexp_replace("html", r"track\((\d+)\);", r"/* it's $1 */ write('<script src=\"x\"></scr' + \"ipt></script>\"); track($1);")
    rows = V.isolated_pages(table(spark, folder, "pages").select("page_id", written.alias("html")), "page_id", "html")
    return rows.select("page_id", "isolated", F.sha2("html", 256).alias("html_sha256"))


# A page with one table of parts for each brand; the first and third column of every fifth row are one cell with the next one.
@query(f"""WITH RECURSIVE p AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k,
        '| ' || p_partkey || ' | ' || CASE WHEN p_partkey % 5 = 0 THEN p_name || ' | ' ELSE p_name || ' | ' || p_type END || ' | ' || p_size || ' |' AS line FROM part),
    t AS (SELECT p_brand, k, {_LINE_TOKENS.format("line")} AS n FROM p), h AS (SELECT {_LINE_TOKENS.format("'| key | name | type | size |'")} AS cost),
    c AS (SELECT p_brand, k, 0::BIGINT AS chunk, n + cost AS used FROM t, h WHERE k = 1
          UNION ALL SELECT t.p_brand, t.k, CASE WHEN used + n <= 480 THEN chunk ELSE chunk + 1 END, CASE WHEN used + n <= 480 THEN used + n ELSE n + cost END FROM c JOIN t ON t.p_brand = c.p_brand AND t.k = c.k + 1, h)
    SELECT p_brand, chunk, min(k)::BIGINT AS first, max(k)::BIGINT AS last, max(used)::BIGINT AS tokens FROM c GROUP BY 1, 2""")
def t20_table_chunks(spark, folder):
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    wide = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("<td colspan=2>"), "p_name", F.lit("</td>"))).otherwise(F.concat(cell("p_name"), cell("p_type")))
    row = F.concat(F.lit("<tr>"), cell("p_partkey"), wide, cell("p_size"), F.lit("</tr>"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda r: r["row"])
    page = F.concat(F.lit("<table><tr><th>key<th>name<th>type<th>size</tr>"), F.array_join(rows, ""), F.lit("</table>"))
    pages = table(spark, folder, "part").groupBy("p_brand").agg(page.alias("html"))
    return G.table_chunks(V.page_blocks(pages, "p_brand", "html"), "p_brand").select("p_brand", "chunk", "first", "last", "tokens")


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS k, len(string_split(text, chr(10))) AS of FROM documents),
    b AS (SELECT doc_id, k, CASE WHEN k < of THEN body || chr(10) ELSE body END AS body FROM s),
    l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k, sum(length(body)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS "end", length(body) AS size,
            len(regexp_extract_all(body, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n, CASE WHEN regexp_full_match(body, '[\p{Lu}\p{N}\s]+') THEN 'heading' ELSE 'prose' END AS kind FROM b WHERE body <> ''),
    c AS (SELECT doc_id, k, 0::BIGINT AS passage, n AS used, kind, "end" - size AS start, "end" FROM l WHERE k = 1
          UNION ALL SELECT l.doc_id, l.k, CASE WHEN m THEN passage ELSE passage + 1 END, CASE WHEN m THEN used + n ELSE n END, l.kind, CASE WHEN m THEN c.start ELSE l."end" - size END, l."end"
          FROM (SELECT c.*, (used + x.n <= 480 AND (c.kind = 'heading' OR x.kind = 'prose')) AS m FROM c JOIN l x ON x.doc_id = c.doc_id AND x.k = c.k + 1) c JOIN l ON l.doc_id = c.doc_id AND l.k = c.k + 1)
    SELECT doc_id, passage, min(start)::BIGINT AS start, max("end")::BIGINT AS "end", max(used)::BIGINT AS tokens, arg_max(kind, k) AS kind FROM c GROUP BY 1, 2""")
def t21_packed_fragments(spark, folder):
    return G.packed(G.lines(table(spark, folder, "documents"), "doc_id", "text"), "doc_id").select("doc_id", "passage", "start", "end", "tokens", "kind")


@query("""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents),
    c AS (SELECT doc_id, 0 AS plan, s AS start, least(s + 480, n) AS "end" FROM (SELECT doc_id, n, unnest(range(0, greatest(CAST(ceil((n - 48) / 432.0) AS BIGINT), 1))) * 432 AS s FROM w WHERE n > 0)
          UNION ALL SELECT doc_id, 1, s, least(s + 100, n) FROM (SELECT doc_id, n, unnest(range(0, greatest(CAST(ceil(n / 100.0) AS BIGINT), 1))) * 100 AS s FROM w WHERE n > 0))
    SELECT doc_id, plan, start, "end" FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.start <= c.start AND o."end" >= c."end" AND (o.start < c.start OR o."end" > c."end" OR o.plan < c.plan))""")
def t21_outermost(spark, folder):
    """Passages of two plans for each document; those inside another go."""
    docs = table(spark, folder, "documents")
    both = [P.chunks(docs, "doc_id", "text", size, overlap).select("doc_id", F.lit(plan).alias("plan"), F.lit(plan).alias("passage"), "start", "end") for plan, (size, overlap) in enumerate(((480, 48), (100, 0)))]
    return G.outermost(both[0].unionByName(both[1]), "doc_id").select("doc_id", "plan", "start", "end")
