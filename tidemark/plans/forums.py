"""Discussions and boards that captures prove, made from conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators import discussions as D
from tidemark.plans.registry import query
from tidemark.sources.tables import table

# Every seventh page names its topic in a quote only, every eleventh lacks a mark of its platform.
_PLAIN = "conv_id % 7 <> 3 AND conv_id % 11 <> 5"
_KEY = "sha256('[\"' || platform || '\",\"' || origin || '\",\"' || forum || '\",\"' || topic || '\"]') AS discussion"


def _body():
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "post"))), lambda x: x["post"]), "\n")


def _topic_pages(spark, folder):
    """A page for each conversation, in the layout of one of three platforms."""
    k, kind = F.col("conv_id"), F.col("conv_id") % 3
    topic, odd, bare = (k + 1).cast("string"), k % 7 == 3, k % 11 == 5
    said = X.escaped(F.coalesce("text", F.lit("")))
    post = (
        F.when(kind == 0, F.concat(F.lit('<td class="postbody">'), said, F.lit("</td>"), F.when(bare, "").otherwise('<td class="row1 postdetails">now</td>')))
        .when(kind == 1, F.concat(F.lit('<div id="post_message_1">'), said, F.lit("</div>"), F.when(bare, "").otherwise('<a id="postcount1">1</a>')))
        .otherwise(F.concat(F.when(bare, "").otherwise('<a href="pop_profile.asp?id=3">profile</a> Posted - now '), said)))
    link = F.concat(
        F.lit('<a href="'), F.when(kind == 0, F.concat(F.lit("viewtopic.php?start=15&amp;t="), topic)).when(kind == 1, F.concat(F.lit("./printthread.php?t="), topic)).otherwise(F.concat(F.lit("/snitz/topic.asp?TOPIC_ID="), topic)), F.lit('">here</a>'))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", post.alias("post")).groupBy("conv_id").agg(_body().alias("posts"))
    url = F.when(kind == 0, F.concat(F.lit("http://forum.example.org/talk/viewtopic.php?t="), topic)).when(kind == 1, F.concat(F.lit("https://www.example.com/showthread.php?t="), topic)).otherwise(F.concat(F.lit("http://old.example.net:8080/snitz/topic.asp?TOPIC_ID="), topic))
    quoted = F.when(odd, F.concat(F.lit("<blockquote>"), link, F.lit("</blockquote>"))).otherwise(link)
    return rows.select("conv_id", url.alias("url"), F.concat(F.lit("<html><body>"), quoted, F.lit("<table><tr>"), "posts", F.lit("</tr></table></body></html>")).alias("html"))


@query(f"""WITH c AS (SELECT DISTINCT conv_id, conv_id % 3 AS kind, (conv_id + 1)::VARCHAR AS topic FROM conversations WHERE {_PLAIN}),
    p AS (SELECT conv_id, CASE kind WHEN 0 THEN 'phpbb' WHEN 1 THEN 'vbulletin' ELSE 'snitz' END AS platform, CASE kind WHEN 0 THEN 'http://forum.example.org' WHEN 1 THEN 'https://www.example.com' ELSE 'http://old.example.net:8080' END AS origin,
          CASE kind WHEN 0 THEN '/talk' WHEN 1 THEN '/' ELSE '/snitz' END AS forum, topic FROM c) SELECT *, {_KEY} FROM p""")
def t25_topic_pages(spark, folder):
    return D.topic_pages(_topic_pages(spark, folder), "conv_id", "url", "html")


def _messages(spark, folder):
    """A page for each turn of a conversation, and the feed of each conversation; every thirteenth feed has another title."""
    talk = table(spark, folder, "conversations").select("conv_id", "turn", "text", (F.col("conv_id") * 1000 + F.col("turn") + 1).cast("string").alias("message"), F.concat(F.lit("b"), (F.col("conv_id") % 4).cast("string")).alias("board"))
    url = F.concat(F.lit("http://boards.example.net/eq/board/message?board.id="), "board", F.lit("&message.id="), "message")
    own = F.concat(F.lit('<a href="/eq/board/print?board.id='), "board", F.lit("&amp;message.id="), "message", F.lit('">print</a>'))
    cells = F.concat(F.lit('<td class="msg_user_cell">x</td><td class="msg_text_cell">'), X.escaped(F.coalesce("text", F.lit(""))), F.lit("</td>"), F.when(F.col("conv_id") % 11 == 5, "").otherwise('<td class="msg_date_cell">now</td>'))
    quoted = F.when(F.col("conv_id") % 7 == 3, F.concat(F.lit("<pre>"), own, F.lit("</pre>"))).otherwise(own)
    pages = talk.select("conv_id", "turn", url.alias("url"), F.concat(quoted, cells).alias("html"))
    name = F.concat(F.lit("Talk "), F.col("conv_id").cast("string"))
    post = F.concat(F.lit("<item><title>"), F.when(F.col("turn") == 0, name).otherwise(F.concat(F.lit("Re: "), name)), F.lit("</title><link>"), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit("#M"), "message", F.lit("</link></item>"))
    feeds = talk.select("conv_id", "board", "turn", "message", F.replace(url, F.lit("&"), F.lit("&amp;")).alias("link"), post.alias("post")).groupBy("conv_id", "board").agg(_body().alias("items"), F.max_by("message", "turn").alias("asked"), F.max_by("link", "turn").alias("link"))
    xml = F.concat(F.lit("<rss><channel><title>Re: "), F.when(F.col("conv_id") % 13 == 6, "Other").otherwise(name), F.lit("</title><link>"), "link", F.lit("</link>"), "items", F.lit("</channel></rss>"))
    return pages, feeds.select("conv_id", F.concat(F.lit("http://boards.example.net/rss/message?board.id="), "board", F.lit("&message.id="), "asked").alias("url"), xml.alias("xml"))


_FEEDS = "c AS (SELECT conv_id, turn, (conv_id * 1000 + turn + 1)::VARCHAR AS message, '/eq/b' || (conv_id % 4) AS forum FROM conversations), w AS (SELECT conv_id, min(turn) AS least, count(*) AS n FROM c GROUP BY 1)"
_MEMBERS = f"m AS (SELECT c.*, 'http://boards.example.net' AS origin, (conv_id * 1000 + 1)::VARCHAR AS topic FROM c JOIN w USING (conv_id) WHERE least = 0 AND n <= {D.MOST_ITEMS} AND conv_id % 13 <> 6)"


@query(f"WITH {_FEEDS}, {_MEMBERS} SELECT origin, forum, message, topic FROM m")
def t25_feed_members(spark, folder):
    return D.feed_members(_messages(spark, folder)[1], "url", "xml")


@query(f"WITH {_FEEDS}, {_MEMBERS}, p AS (SELECT 'lithium' AS platform, origin, forum, topic, conv_id, turn FROM m WHERE {_PLAIN}) SELECT conv_id || '/' || turn AS page, platform, origin, forum, topic, {_KEY} FROM p")
def t25_message_pages(spark, folder):
    pages, feeds = _messages(spark, folder)
    return D.message_pages(pages.withColumn("page", F.concat_ws("/", "conv_id", "turn")), "page", "url", "html", D.feed_members(feeds, "url", "xml"))


# A board for each source, with a forum for 20 documents; its index was captured once for 50 forums and leaves out every third forum.
HOSTS = r"^(www\.)?pub\d+\.boards\.example\.org$"


def _boards(spark, folder):
    docs = table(spark, folder, "documents").where("source IS NOT NULL").select("doc_id", "source", F.floor(F.col("doc_id") / 20).alias("k"))
    forum = F.concat(F.lit("http://pub"), (F.col("k") % 5).cast("string"), F.lit(".boards.example.org/f"), "source", F.lit("forum"), F.col("k").cast("string"))
    board = F.concat(F.lit("http://pub1.boards.example.org/b"), "source")
    back = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Back to [the board]("), board, F.lit("/index.html)."))).otherwise("No way back.")
    pages = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("capture"), F.concat(forum, F.lit(".html?page="), F.col("doc_id").cast("string")).alias("url"), back.alias("text"))
    listed = docs.select("source", "k", F.floor(F.col("k") / 50).alias("part"), board.alias("board"), forum.alias("forum")).distinct()
    line = F.when(F.col("k") % 3 == 0, F.concat(F.lit("other http://pub1.boards.example.org/fzz"), F.col("k").cast("string"))).otherwise(F.concat(F.lit("[forum]("), "forum", F.lit(")")))
    index = listed.select("source", "part", "board", line.alias("line")).groupBy("source", "part", "board").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))
    return pages.union(index.select(F.concat_ws("/", F.lit("i"), "source", "part"), F.concat("board", F.when(F.col("part") % 2 == 0, "/index.html").otherwise("")), "text"))


_BOARDS = "d AS (SELECT doc_id, source, doc_id // 20 AS k FROM documents WHERE source IS NOT NULL), i AS (SELECT DISTINCT source, k // 50 AS part FROM d)"


@query(f"WITH {_BOARDS} SELECT 'd' || doc_id AS capture, 'b' || source AS board FROM d WHERE k % 3 <> 0 UNION ALL SELECT 'i/' || source || '/' || part, 'b' || source FROM i")
def f10_board_captures(spark, folder):
    captures = _boards(spark, folder)
    return D.board_captures(captures, "capture", "url", D.forum_links(captures, "url", "text", HOSTS), HOSTS)


@query(f"WITH {_BOARDS} SELECT 'b' || source AS a, 'f' || source || 'forum' || k AS b FROM d WHERE k % 3 <> 0 GROUP BY source, k HAVING bool_or(doc_id % 4 = 0)")
def f10_reciprocal_forums(spark, folder):
    """Boards and forums that link to each other; boards sort before forums."""
    rows = _boards(spark, folder).select(F.coalesce(D.board_name(F.col("url")), D.forum_name(F.col("url"))).alias("source"), F.explode(F.regexp_extract_all("text", F.lit(r"""https?://[^\s<>"')]+"""), F.lit(0))).alias("link"))
    links = rows.where(U.host("link").rlike(HOSTS)).select("source", F.coalesce(D.board_name(F.col("link")), D.forum_name(F.col("link"))).alias("target"))
    return D.reciprocal(links, "source", "target")
