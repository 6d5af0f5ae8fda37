"""Sources of mixed encodings, feeds, tree objects and messages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.plans.registry import query
from tidemark.sources import feeds as Fe
from tidemark.sources import regions as R
from tidemark.sources import trees as Tr
from tidemark.sources.tables import table
from tidemark.storage import cut, shared_folder

# A Japanese sentence as text and in Shift_JIS, and a shifted run with a vendor's character.
_KANA, _SJIS = "これはテストのぶんしょうです。", "82b182ea82cd83658358836782cc82d482f182b582e582a482c582b78142"
_RUN, _READ = "1b2442467c4b5c2d2121266c743b1b2842", "日本①ー"


@query(f"""WITH d AS (SELECT doc_id, text, regexp_matches(text, '[^\\x00-\\x7F]') AS high FROM documents) SELECT doc_id, sha256(text || '<br>' || text || '<br>{_KANA}') AS text_sha256,
    CASE WHEN high THEN 'utf-8,cp1252,shift_jis' ELSE 'shift_jis' END AS encodings, 0::BIGINT AS damaged FROM d""")
def t03_decoded_regions(spark, folder):
    """A page whose first node is UTF-8, the second Western, and the third Japanese."""
    content = F.concat(F.encode("text", "UTF-8"), F.encode(F.lit("<br>"), "UTF-8"), F.encode("text", "ISO-8859-1"), F.encode(F.lit("<br>"), "UTF-8"), F.unhex(F.lit(_SJIS)))
    files = table(spark, folder, "documents").select("doc_id", content.alias("content"))
    return R.joined(R.decoded_regions(files, "doc_id", "content"), "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "encodings", "damaged")


@query("""WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS n, length(regexp_extract(text, '^(?:[\\x00-\\x7F]*\\n)?')) AS plain FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]'))
    SELECT doc_id, 0 AS region, 0::BIGINT AS start, n + 4 + plain AS "end", 'utf-8' AS encoding FROM d UNION ALL SELECT doc_id, 1, n + 4 + plain, n + 8 + length(text), 'cp1252' FROM d""")
def t03_region_offsets(spark, folder):
    """The exact bytes of the UTF-8 and the Western region of such pages."""
    rows = table(spark, folder, "documents").where(F.col("text").rlike(r"[^\x00-\x7F]"))
    content = F.concat(F.encode("text", "UTF-8"), F.encode(F.lit("<br>"), "UTF-8"), F.encode("text", "ISO-8859-1"), F.encode(F.lit("<br>"), "UTF-8"))
    return R.decoded_regions(rows.select("doc_id", content.alias("content")), "doc_id", "content").select("doc_id", "region", "start", "end", "encoding")


@query(f"""SELECT doc_id, sha256(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') || '{_READ}' || ' caf' || chr(233) || ' ' || '{_READ}') AS text_sha256, 0::BIGINT AS damaged, CASE WHEN regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') = '' THEN 3 ELSE 4 END::BIGINT AS runs FROM documents""")
def t04_shifted_runs(spark, folder):
    """ASCII text with shifted runs that hold a vendor's character and an escaped one, and a Western letter outside of them."""
    run = F.unhex(F.lit(_RUN))
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    content = F.concat(F.encode(plain, "UTF-8"), run, F.encode(F.lit(" café "), "ISO-8859-1"), run)
    files = table(spark, folder, "documents").select("doc_id", content.alias("content"))
    rows = R.decoded_regions(files, "doc_id", "content", escapes=True)
    runs = rows.groupBy("doc_id").agg(F.count("*").alias("runs"))
    return R.joined(rows, "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "damaged").join(runs, "doc_id")


# Feeds of at most 50 documents of a source, RSS and Atom in turn; every seventh is cut off.
_FEED = "d AS (SELECT doc_id, source, doc_id // 50 AS part, text FROM documents)"


def _feeds(spark, folder):
    safe = lambda c: F.replace(F.replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    k = F.col("doc_id").cast("string")
    rss = F.concat(F.lit("<item><title>Entry "), k, F.lit("</title><guid>urn:"), k, F.lit("</guid><pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate><description>"), safe("text"), F.lit("</description></item>"))
    atom = F.concat(F.lit("<entry><title>Entry "), k, F.lit('</title><link rel="self" href="x"/><link href="urn:'), k, F.lit('"/><updated>2024-01-01T00:00:00Z</updated><content>'), safe("text"), F.lit("</content></entry>"))
    rows = table(spark, folder, "documents").select("doc_id", "source", F.floor(F.col("doc_id") / 50).alias("part"), rss.alias("rss"), atom.alias("atom"))
    own = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", c))), lambda x: x[c]), "")
    feeds = rows.groupBy("source", "part").agg(own("rss").alias("rss"), own("atom").alias("atom"))
    whole = F.when(F.col("part") % 2 == 0, F.concat(F.lit('<?xml version="1.0"?><rss><channel><title>'), "source", F.lit("</title>"), "rss", F.lit("</channel></rss>"))).otherwise(
        F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>'), "source", F.lit("</title>"), "atom", F.lit("</feed>")))
    cut_off = F.col("part") % 7 == 3
    return feeds.select(F.concat_ws("/", "source", "part").alias("feed"), F.when(cut_off, F.substring(whole, 1, F.length(whole) - 20)).otherwise(whole).alias("xml"))


@query(rf"""WITH {_FEED} SELECT source || '/' || part AS feed, CASE WHEN part % 2 = 0 THEN 'rss' ELSE 'atom' END AS format, source AS feed_title,
    (row_number() OVER (PARTITION BY source, part ORDER BY doc_id) - 1)::BIGINT AS entry, 'Entry ' || doc_id AS title, 'urn:' || doc_id AS link, TIMESTAMP '2024-01-01' AS published,
    sha256(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS summary_sha256 FROM d WHERE part % 7 <> 3""")
def t09_feed_entries(spark, folder):
    rows = Fe.entries(_feeds(spark, folder), "feed", "xml").where("NOT broken")
    return rows.select("feed", "format", "feed_title", "entry", "title", "link", "published", F.sha2("summary", 256).alias("summary_sha256"))


@query(f"WITH {_FEED} SELECT DISTINCT source || '/' || part AS feed FROM d WHERE part % 7 = 3")
def t09_broken_feeds(spark, folder):
    return Fe.entries(_feeds(spark, folder), "feed", "xml").where("broken").select("feed")


# A tree for each host, with 16 trees below it and a file for each page.
_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"


def _trees(spark, folder):
    pages = table(spark, folder, "pages").select(U.host("url").alias("host"), (F.col("page_id") % 16).cast("string").alias("part"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.sha1("html").alias("oid"))
    whole = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", F.hex(c).alias("e")))), lambda x: x["e"]), "")
    parts = pages.groupBy("host", "part").agg(F.unhex(whole(Tr.entry("100644", F.col("name"), F.col("oid")))).alias("content"))
    parts = parts.select("host", "part", "content", Tr.tree_oid(F.col("content")).alias("tree"))
    roots = parts.select("host", F.col("part").alias("name"), Tr.entry(Tr.TREE_MODE, F.col("part"), F.col("tree")).alias("e")).groupBy("host").agg(F.unhex(whole("e")).alias("content"))
    roots = cut(roots.select("host", "content", Tr.tree_oid(F.col("content")).alias("tree")))
    at = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    parts.select("tree", "content").union(roots.select("tree", "content")).distinct().write.parquet(at)
    return roots.select("host", F.col("tree").alias("root")), at


@query("SELECT name, mode, oid, count(*) AS n FROM (SELECT page_id || '.html' AS name, '100644' AS mode, sha1(html) AS oid FROM pages) GROUP BY ALL")
def n03_tree_entries(spark, folder):
    """Files of all tree objects; the filter on the mode is pushed into the reader."""
    return Tr.tree_entries(spark, _trees(spark, folder)[1], "mode = '100644'").groupBy("name", "mode", "oid").agg(F.count("*").alias("n"))


@query(f"SELECT {_HOST} AS host, (page_id % 16) || '/' || page_id || '.html' AS path, sha1(html) AS oid FROM pages")
def s03_tree_listing(spark, folder):
    roots, at = _trees(spark, folder)
    return Tr.listing(Tr.tree_entries(spark, at), roots).join(roots, "root").select("host", "path", "oid")


@query(f"""WITH p AS (SELECT {_HOST} AS host, (page_id % 16) || '/' || page_id || '.html' AS path, sha1(html) AS oid FROM pages)
    SELECT host, path, oid, count(*) OVER (PARTITION BY host) <= 10 AS complete FROM p QUALIFY row_number() OVER (PARTITION BY host ORDER BY path) <= 10""")
def s04_bounded_listing(spark, folder):
    """At most ten files of a host, and whether these are all."""
    roots, at = _trees(spark, folder)
    return Tr.listing(Tr.tree_entries(spark, at), roots, most=10).join(roots, "root").select("host", "path", "oid", "complete")
