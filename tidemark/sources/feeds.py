"""Entries of RSS, RDF and Atom feeds, by Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEM = "array<struct<title:string,link:string,guid:string,pubDate:string,date:string,description:string,encoded:string>>"
_ENTRY = "array<struct<title:string,link:array<struct<_href:string,_rel:string>>,id:string,published:string,updated:string,summary:string,content:string>>"
#: A feed's root is any of rss, RDF and feed; which children it has tells the format.
SCHEMA = f"title string, channel struct<title:string,item:{_ITEM}>, item {_ITEM}, entry {_ENTRY}, broken string"

# Time zones that mails name.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def moment(text: Column) -> Column:
    """A feed's date, in the form of mails or of ISO 8601; null where it is neither."""
    zone = F.upper(F.regexp_extract(text, r"\s([A-Za-z]+)\s*$", 1))
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), zone)
    time = F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""), r"\s[A-Za-z]+\s*$", "")
    mail = F.try_to_timestamp(F.when(offset.isNotNull(), F.concat(time, F.lit(" "), offset)).otherwise(time), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(mail, text.try_cast("timestamp"))


def plain(markup: Column) -> Column:
    """Text of a summary: without tags and with white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", " "), r"\s+", " "))


def entries(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """Rows (key, format, feed_title, entry, title, link, identity, published, summary, broken), in the feed's order.

    A feed that is no well-formed XML has one row, with ``broken``; one without entries, or
    a null one, has one with a null entry. A link that is missing is the identity's.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "ignoreNamespace": "true"}
    rows = feeds.select(key, F.from_xml(F.col(xml), SCHEMA, options).alias("f"))
    of_item = lambda e: F.struct(
        e["title"].alias("title"), F.coalesce(e["link"], e["guid"]).alias("link"), F.coalesce(e["guid"], e["link"]).alias("identity"),
        F.coalesce(e["pubDate"], e["date"]).alias("published"), F.coalesce(e["encoded"], e["description"]).alias("summary"))
    own = lambda e: F.coalesce(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")[0], e["link"][0])["_href"]
    of_entry = lambda e: F.struct(
        e["title"].alias("title"), F.coalesce(own(e), e["id"]).alias("link"), F.coalesce(e["id"], own(e)).alias("identity"),
        F.coalesce(e["published"], e["updated"]).alias("published"), F.coalesce(e["content"], e["summary"]).alias("summary"))
    found = F.coalesce(F.transform("f.channel.item", of_item), F.transform("f.item", of_item), F.transform("f.entry", of_entry))
    kind = F.when(F.col("f.entry").isNotNull(), "atom").when(F.col("f.item").isNotNull(), "rdf").when(F.col("f.channel").isNotNull(), "rss")
    broken = F.coalesce(F.col("f.broken").isNotNull(), F.lit(False))
    found = F.when(~broken, found)
    rows = rows.select(key, F.when(~broken, kind).alias("format"), F.coalesce("f.channel.title", "f.title").alias("feed_title"), broken.alias("broken"), F.posexplode_outer(found).alias("entry", "e"))
    return rows.select(
        key, "format", "feed_title", F.col("entry").cast("long").alias("entry"), "e.title", "e.link", "e.identity", moment(F.col("e.published")).alias("published"), plain(F.col("e.summary")).alias("summary"), "broken")
