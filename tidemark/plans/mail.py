"""Messages of newsgroups and mailing lists, their search view and bounded pieces, strict JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.plans.registry import query
from tidemark.sources import tables as T
from tidemark.sources.tables import table


# Every second message ends its lines as mails do, every sixth has no subject.
@query(r"""SELECT 'news/' || doc_id AS path, 'user' || (doc_id % 7) || '@example.org' AS author, 'alt.' || source AS groups, CASE WHEN doc_id % 6 <> 1 THEN 'Post: ' || doc_id END AS subject,
    'Mon, 01 Jan 2024 00:00:00 +0000' AS sent, sha256(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')) AS body_sha256 FROM documents""")
def s09_newsgroup_messages(spark, folder):
    k = F.col("doc_id").cast("string")
    line = lambda *parts: F.concat(*parts, F.when(F.col("doc_id") % 2 == 1, "\r\n").otherwise("\n"))
    head = F.concat(
        line(F.lit("Path: not-kept")), line(F.lit("From: user"), (F.col("doc_id") % 7).cast("string"), F.lit("@example.org")), line(F.lit("Newsgroups: alt."), F.coalesce("source", F.lit(""))),
        F.when(F.col("doc_id") % 6 == 1, "").otherwise(line(F.lit("Subject: Post: "), k)), line(F.lit("Date: Mon, 01 Jan 2024 00:00:00 +0000")))
    files = table(spark, folder, "documents").select(F.concat(F.lit("news/"), k).alias("path"), F.encode(F.concat(head, line(F.lit("")), F.coalesce("text", F.lit(""))), "UTF-8").alias("content"))
    return T.messages(files).select("path", "author", "groups", "subject", "sent", F.sha2("body", 256).alias("body_sha256"))


# Every fifth message has no subject; odd turns have a postDate in place of a date.
@query("""SELECT 'list/' || conv_id || '/' || turn AS path, role AS author, CASE WHEN turn % 5 <> 4 THEN 'Talk ' || conv_id END AS subject, 1000000000 + conv_id * 100 + turn AS sent, sha256(coalesce(text, '')) AS body_sha256 FROM conversations""")
def s10_mailing_list_messages(spark, folder):
    when = (F.lit(1000000000).cast("long") + F.col("conv_id") * 100 + F.col("turn")).cast("string")
    data = F.struct(
        F.coalesce("text", F.lit("")).alias("messageBody"), F.when(F.col("turn") % 5 != 4, F.concat(F.lit("Talk "), F.col("conv_id").cast("string"))).alias("subject"), F.col("role").alias("from"),
        F.when(F.col("turn") % 2 == 0, when).alias("date"), F.when(F.col("turn") % 2 == 1, when).alias("postDate"), F.lit(3).alias("other"))
    rows = table(spark, folder, "conversations").select(F.concat_ws("/", F.lit("list"), "conv_id", "turn").alias("path"), F.to_json(F.struct(data.alias("ygData"))).alias("content"))
    return T.mails(rows).select("path", "author", "subject", F.unix_timestamp("sent").alias("sent"), F.sha2("body", 256).alias("body_sha256"))


# Odd documents are mails. A promotion follows the text directly on its last line's end.
@query("""WITH d AS (SELECT doc_id, doc_id % 2 = 1 AS mail, coalesce(text, '') AS t FROM documents) SELECT doc_id, CASE WHEN mail THEN 2 ELSE 0 END AS promoted,
    sha256('# Text ' || doc_id || chr(10) || 'see this ' || t || CASE WHEN mail THEN chr(10) || 'bye' ELSE '<br>> e-mails exchanged daily<BR />bye' END || chr(10) || CASE WHEN mail THEN '' ELSE 'Your use of Yahoo! Groups is subject' END) AS view_sha256 FROM d""")
def t16_search_views(spark, folder):
    k, mail = F.col("doc_id").cast("string"), F.col("doc_id") % 2 == 1
    whole = F.concat(
        F.lit("**Page URL:** http://example.org/"), k, F.lit("\n<h1>Text "), k, F.lit("</h1>\nsee [this](http://example.org/a) "), F.coalesce("text", F.lit("")),
        F.lit("<br>> e-mails exchanged daily<BR />bye\nYour use of Yahoo! Groups is subject"))
    rows = table(spark, folder, "documents").select("doc_id", mail.alias("mail"), whole.alias("text"))
    return rows.select("doc_id", F.when(F.col("mail"), X.promotions("text")).otherwise(0).alias("promoted"), F.sha2(X.search_view("text", F.col("mail")), 256).alias("view_sha256"))


_CUT = "CASE WHEN length(substr(text, {0} + 1, 1201)) <= 1200 THEN length(substr(text, {0} + 1, 1200)) WHEN regexp_matches(substr(text, {0} + 601, 600), '[ \\n]') THEN 600 + length(regexp_extract(substr(text, {0} + 601, 600), '^(?s:.*)[ \\n]')) ELSE 1200 END"


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, text, 0 AS piece, 0 AS start, {_CUT.format('0')} AS n FROM documents WHERE text <> ''
    UNION ALL SELECT doc_id, text, piece + 1, start + n, {_CUT.format('(start + n)')} FROM r WHERE start + n < length(text)) SELECT doc_id, piece, n AS n_chars, sha256(substr(text, start + 1, n)) AS piece_sha256 FROM r""")
def t38_bounded_pieces(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(X.pieces("text", 1200)).alias("piece", "body"))
    return rows.select("doc_id", "piece", F.length("body").alias("n_chars"), F.sha2("body", 256).alias("piece_sha256"))


@query("SELECT doc_id, doc_id % 6 IN (0, 5) AS sound, CASE WHEN doc_id % 6 IN (0, 5) THEN sha256(text) END AS text_sha256 FROM documents")
def x02_strict_json(spark, folder):
    """Requests of documents; some repeat a key, at the top or deeper, go on after the value, or are cut off."""
    text = F.to_json(F.struct("text"), {"ignoreNullFields": "false"})
    inner = F.regexp_replace(text, r"^\{|\}$", "")
    way = F.col("doc_id") % 6
    raw = (
        F.when(way == 0, text).when(way == 1, F.concat(F.lit("{"), inner, F.lit(',"\\u0074ext":1}'))).when(way == 2, F.concat(F.lit("{"), inner, F.lit(',"a":[{"b":{"c":1,"c":1}}]}')))
        .when(way == 3, F.concat(text, F.lit("] , ["))).when(way == 4, F.concat(F.lit("{"), inner)).otherwise(F.concat(F.lit("{"), inner, F.lit(',"a":{"text":1},"b":[{"text":2}]}'))))
    rows = table(spark, folder, "documents").select("doc_id", X.strict_json(raw).alias("value"))
    return rows.select("doc_id", F.col("value").isNotNull().alias("sound"), F.sha2(F.try_variant_get("value", "$.text", "string"), 256).alias("text_sha256"))
