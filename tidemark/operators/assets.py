"""Files that a page needs to be shown: pictures, scripts, styles, objects and downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls as U

# Which attribute of which elements names a file, relations of links that do, and endings of downloads.
SRC, SRCSET = ["img", "script", "embed", "source", "audio", "video", "input", "iframe"], ["img", "source"]
RELATIONS = ["stylesheet", "icon", "shortcut", "preload"]
DOWNLOADS = r"(?i)\.(zip|rar|7z|gz|tgz|exe|msi|pdf|doc|mp3|wav|avi|mpg|txt)$"

# Possessive and without loops over single characters, so that text after a tag that never ends costs one pass.
_TAG = r"""<([A-Za-z][A-Za-z0-9]*+)([^"'<>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'<>]*+){0,500}+)>"""
_CSS = r"""(?i)url\(\s*["']?([^"')]+?)["']?\s*\)"""


def attribute(attributes: Column, name: str) -> Column:
    """An attribute's value in quotes or without them; null where it is missing or empty."""
    pattern = rf"""(?i)(?:^|[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.nullif(F.concat(*[F.regexp_extract(attributes, pattern, k) for k in (1, 2, 3)]), F.lit(""))


def assets(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Distinct rows (key, asset) of http addresses, resolved by the page or its base element.

    Comments are no mark-up; addresses inside scripts are not read. Null and empty pages have
    none, and neither has a tag that never ends or holds over 500 quoted values.
    """
    plain = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?is)(<script\b[^>]*>).*?</script\s*>", "$1</script>")
    rows = pages.select(key, F.col(url).alias("__url"), F.explode(F.array(plain)).alias("__html"))
    base = F.nullif(F.regexp_extract("__html", r"""(?i)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", 1), F.lit(""))
    rows = rows.select(key, F.coalesce(U.resolved("__url", base), "__url").alias("__base"), "__html")
    styles = F.array_join(F.regexp_extract_all("__html", F.lit(r"(?is)<style\b[^>]*>(.*?)</style\s*>"), F.lit(1)), "\n")
    in_styles = rows.select(key, "__base", F.explode(F.regexp_extract_all(styles, F.lit(_CSS), F.lit(1))).alias("__link"))
    tags = rows.select(key, "__base", F.explode(F.regexp_extract_all("__html", F.lit(_TAG), F.lit(0))).alias("__t"))
    tags = tags.select(key, "__base", F.lower(F.regexp_extract("__t", r"^<([A-Za-z0-9]+)", 1)).alias("__n"), F.regexp_extract("__t", r"(?s)^<[A-Za-z0-9]+(.*)>$", 1).alias("__a"))
    name, own = F.col("__n"), F.col("__a")
    one = lambda when, value: F.when(when & value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    href = attribute(own, "href")
    sets = F.transform(F.split(F.coalesce(attribute(own, "srcset"), F.lit("")), ","), lambda x: F.split_part(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(" "), F.lit(1)))
    related = F.arrays_overlap(F.split(F.lower(F.coalesce(attribute(own, "rel"), F.lit(""))), r"\s+"), F.array(*map(F.lit, RELATIONS)))
    download = own.rlike(r"(?i)(^|[\s\"'])download(\s|=|/|$)") | F.coalesce(href, F.lit("")).rlike(DOWNLOADS)
    found = F.concat(
        one(name.isin(SRC), attribute(own, "src")), F.when(name.isin(SRCSET), F.filter(sets, lambda x: x != "")).otherwise(none), one((name == "link") & related, href),
        one(name == "object", attribute(own, "data")), one((name == "a") & download, href), one(F.lit(True), attribute(own, "background")), one(F.lit(True), attribute(own, "poster")),
        F.regexp_extract_all(F.coalesce(attribute(own, "style"), F.lit("")), F.lit(_CSS), F.lit(1)))
    links = tags.select(key, "__base", F.explode(found).alias("__link")).union(in_styles)
    return links.select(key, F.regexp_replace(U.resolved("__base", F.col("__link")), "#.*$", "").alias("asset")).where("asset IS NOT NULL").distinct()
