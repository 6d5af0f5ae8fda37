"""Captures that belong to one discussion or one board, as far as pages and links prove it.

An address alone proves nothing. A page of a topic must be laid out as its platform's pages
are and name its own topic in a link outside of quotes; a feed proves which messages are of
one topic; a board's index proves its forums by the links it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls as U

# A platform's page paths, the paths that also name a topic in links, the parameter and the marks of its pages.
PLATFORMS = {
    "phpbb": (r"/viewtopic\.php$", r"/viewtopic\.php$", "t", [r"""class=["'][^"']*\bpostbody\b""", r"""class=["'][^"']*\bpostdetails\b|<a\b[^>]*\bname=["']p"""]),
    "vbulletin": (r"/showthread\.php$", r"/(show|print)thread\.php$", "t", [r"""\bid=["']post_message_""", r"""\bid=["']postcount"""]),
    "snitz": (r"/(topic|pop_printer_friendly)\.asp$", r"/(topic|pop_printer_friendly)\.asp$", "TOPIC_ID", [r"pop_profile\.asp", r"Posted\s+-\s"]),
}
LITHIUM_MARKS = [rf"""class=["'][^"']*\b{name}\b""" for name in ("msg_text_cell", "msg_user_cell", "msg_date_cell")]
NUMBER = r"^[1-9][0-9]{0,19}$"
REPLY = r"^(?i:re\s*:\s*)+"
MOST_ITEMS = 500

_NO_QUOTES = r"(?is)<(blockquote|pre|code)\b.*?</\1\s*>"
_HREF = r"""(?i)<(?:a|link)\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


def _parameter(url: Column, name: str) -> Column:
    return F.url_decode(F.regexp_extract(U.query(url), rf"(?:^|&){name.replace('.', '[.]')}=([^&]*)", 1))


def topic_of(url: Column, links: bool = False) -> Column:
    """Platform, origin, directory and topic that an address names, as a struct, or null; with links, also addresses that only name a topic."""
    found = F.lit(None)
    for name, (page, link, parameter, _) in PLATFORMS.items():
        value = _parameter(url, parameter)
        fits = U.path(url).rlike(link if links else page) & value.rlike(NUMBER) & ~U.has_repeated_key(url)
        folder = F.regexp_extract(U.path(url), r"^(.*)/", 1)
        own = F.struct(F.lit(name).alias("platform"), U.origin(url).alias("origin"), F.when(folder == "", "/").otherwise(folder).alias("forum"), value.alias("topic"))
        found = F.coalesce(F.when(fits & U.origin(url).isNotNull(), own), found)
    return found


def message_of(url: Column) -> Column:
    """Origin, forum and message that an address of a message board names, as a struct, or null."""
    community = F.regexp_extract(U.path(url), r"^(/.*)/board/(?:message|print)$", 1)
    board, message = _parameter(url, "board.id"), _parameter(url, "message.id")
    fits = (community != "") & board.rlike(r"^[A-Za-z0-9_.-]{1,128}$") & message.rlike(NUMBER) & ~U.has_repeated_key(url)
    return F.when(fits & U.origin(url).isNotNull(), F.struct(U.origin(url).alias("origin"), F.concat_ws("/", community, board).alias("forum"), message.alias("message")))


def _names_itself(url: Column, html: Column, own: Column, route) -> Column:
    hrefs = F.regexp_extract_all(F.regexp_replace(html, _NO_QUOTES, " "), F.lit(_HREF), F.lit(1))
    return F.exists(hrefs, lambda h: F.coalesce(route(U.resolved(url, h)) == own, F.lit(False)))


def _all_marks(html: Column, marks: list[str]) -> Column:
    return F.lit(True) if not marks else html.rlike(f"(?is){marks[0]}") & _all_marks(html, marks[1:])


def _keyed(rows: DataFrame) -> DataFrame:
    """A topic's key is the digest of its four names, so that hosts or forums with equal numbers stay apart."""
    return rows.withColumn("discussion", F.sha2(F.to_json(F.array("platform", "origin", "forum", "topic")), 256))


def topic_pages(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Rows (key, platform, origin, forum, topic, discussion) of pages that prove their topic. One pass, without a shuffle.

    Null addresses, null and empty pages, numbers with leading zeros and parameters that
    repeat prove nothing; a page has at most one row.
    """
    rows = pages.select(key, F.col(url).alias("__url"), F.col(html).alias("__html"), topic_of(F.col(url)).alias("__t")).where("__t IS NOT NULL")
    laid_out = F.lit(False)
    for name, (_, _, _, marks) in PLATFORMS.items():
        laid_out = laid_out | ((F.col("__t.platform") == name) & _all_marks(F.col("__html"), marks))
    proven = rows.where(laid_out & _names_itself(F.col("__url"), F.col("__html"), F.col("__t"), lambda u: topic_of(u, links=True)))
    return _keyed(proven.select(key, "__t.*"))


_FEED = "channel struct<title:string,link:string,item:array<struct<title:string,link:string>>>, broken string"


def feed_members(feeds: DataFrame, url: str, xml: str) -> DataFrame:
    """Rows (origin, forum, message, topic): the messages that exactly one topic's feeds name.

    A feed counts only as a whole: its address and its channel must name the same message,
    its first item starts the topic, its items are of one forum, apart, not older than the
    first and at most 500. Broken feeds prove nothing. A message that feeds of two topics
    name is of neither.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "ignoreNamespace": "true"}
    rows = feeds.where(U.path(url) == "/rss/message").where(~F.col(xml).rlike(r"(?i)<!\s*(DOCTYPE|ENTITY)\b") & ~U.has_repeated_key(url))
    rows = rows.select(F.col(url).alias("u"), F.from_xml(F.col(xml), _FEED, options).alias("f")).where("f.broken IS NULL AND size(f.channel.item) > 0").where(F.size("f.channel.item") <= MOST_ITEMS)
    items = F.transform("f.channel.item", lambda e: F.struct(message_of(e["link"]).alias("m"), F.regexp_extract(e["link"], "#(.*)$", 1).alias("part")))
    rows = rows.select("u", F.col("f.channel.title").alias("title"), message_of(F.col("f.channel.link")).alias("c"), F.col("f.channel.item")[0]["title"].alias("first_title"), items.alias("items"))
    rows = rows.withColumn("first", F.col("items")[0]["m"])
    number = lambda m: m["message"].cast("decimal(20,0)")
    same = lambda m: F.coalesce((m["origin"] == F.col("c.origin")) & (m["forum"] == F.col("c.forum")), F.lit(False))
    sound = F.forall("items", lambda e: same(e["m"]) & (e["part"] == F.concat(F.lit("M"), e["m"]["message"])) & (number(e["m"]) >= number(F.col("first"))))
    apart = F.size(F.array_distinct(F.transform("items", lambda e: e["m"]))) == F.size("items")
    asked = (U.origin("u") == F.col("c.origin")) & (_parameter(F.col("u"), "message.id") == F.col("c.message")) & F.endswith(F.col("c.forum"), F.concat(F.lit("/"), _parameter(F.col("u"), "board.id")))
    titled = (F.trim("first_title") != "") & ~F.trim("first_title").rlike(REPLY) & (F.trim(F.regexp_replace("title", REPLY, "")) == F.trim("first_title"))
    members = rows.where(asked & titled & sound & apart).select(F.explode(F.array_distinct(F.concat(F.array("c"), F.transform("items", lambda e: e["m"])))).alias("m"), F.col("first.message").alias("topic"))
    return members.groupBy("m.origin", "m.forum", "m.message").agg(F.min("topic").alias("topic"), F.max("topic").alias("__other")).where("topic = __other").drop("__other")


def message_pages(pages: DataFrame, key: str, url: str, html: str, members: DataFrame) -> DataFrame:
    """Rows like those of ``topic_pages`` for pages of single messages, whose topics feeds prove."""
    rows = pages.select(key, F.col(url).alias("__url"), F.col(html).alias("__html"), message_of(F.col(url)).alias("__m")).where("__m IS NOT NULL")
    rows = rows.where(_all_marks(F.col("__html"), LITHIUM_MARKS) & _names_itself(F.col("__url"), F.col("__html"), F.col("__m"), message_of))
    rows = rows.select(key, "__m.*").join(members, ["origin", "forum", "message"])
    return _keyed(rows.select(key, F.lit("lithium").alias("platform"), "origin", "forum", "topic"))


def reciprocal(links: DataFrame, source: str, target: str) -> DataFrame:
    """Rows (a, b), a < b, of places that link to each other; one shuffle by the unordered pair in place of a join of the links with themselves."""
    pairs = links.where(F.col(source) != F.col(target)).select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b"), (F.col(source) < F.col(target)).alias("up"))
    return pairs.groupBy("a", "b").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down")).where("up AND down").select("a", "b")


# Names of a board's index and of a forum's page, on any of a service's hosts.
BOARD_PATH, FORUM_PATH = r"^/(b[a-z0-9_-]{1,100})(?:/(?:index\.html?)?)?$", r"^/(f[a-z0-9_-]{1,200})(?:[.?/]|$)"


def board_name(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(U.path(url), f"(?i){BOARD_PATH}", 1)), F.lit(""))


def forum_name(url: Column) -> Column:
    return F.nullif(F.regexp_extract(U.path(url), f"(?i){FORUM_PATH}", 1), F.lit(""))


def forum_links(captures: DataFrame, url: str, text: str, hosts: str) -> DataFrame:
    """Distinct (board, forum) that indexes of boards link, on hosts that match the pattern.

    A forum's name must go on from that of its board (``bNAME``, ``fNAMEforum1``), so a link
    to another board's forum is no evidence, and such a name without a link is none either.
    """
    rows = captures.where(U.host(url).rlike(hosts)).select(board_name(F.col(url)).alias("board"), F.regexp_extract_all(text, F.lit(r"""https?://[^\s<>"')]+"""), F.lit(0)).alias("found")).where("board IS NOT NULL")
    rows = rows.select("board", F.explode(F.array_distinct("found")).alias("link")).where(U.host("link").rlike(hosts)).select("board", forum_name(F.col("link")).alias("forum"))
    goes_on = F.startswith(F.lower("forum"), F.concat(F.lit("f"), F.substr("board", F.lit(2)))) & (F.length("forum") > F.length("board"))
    return rows.where(goes_on).distinct()


def board_captures(captures: DataFrame, key: str, url: str, evidence: DataFrame, hosts: str) -> DataFrame:
    """Rows (key, board): a board's own indexes and all captures of the forums it is shown to have."""
    rows = captures.where(U.host(url).rlike(hosts)).select(key, board_name(F.col(url)).alias("board"), forum_name(F.col(url)).alias("forum"))
    return rows.where("board IS NOT NULL").select(key, "board").union(rows.select(key, "forum").join(evidence, "forum").select(key, "board"))
