"""URL expressions: parts, canonical form, scopes, archive paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import _col

SCHEME_HOST = r"^(?i:(https?))://(?:[^/@?#]*@)?([^/:?#]+)(?::(\d+))?"


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), SCHEME_HOST, 1))


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), SCHEME_HOST, 2))


def port(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), SCHEME_HOST, 3)


def path(url: Column | str) -> Column:
    p = F.regexp_extract(_col(url), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[^?#]*\?([^#]*)", 1)


def bare_host(url: Column | str) -> Column:
    """The host without a leading ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def unwrapped(url: Column | str) -> Column:
    """The address inside a replay address of an archive, else the address."""
    u = _col(url)
    inner = F.regexp_extract(u, r"/web/\d{14}(?:[a-z]+_)?/(https?://.+)$", 1)
    return F.when(inner != "", inner).otherwise(u)


def canonical(url: Column | str) -> Column:
    """Lower-case scheme and host, no default port, no fragment; null where unsafe or not http."""
    u = unwrapped(url)
    p = port(u)
    default = (p == "") | ((scheme(u) == "http") & (p == "80")) | ((scheme(u) == "https") & (p == "443"))
    q = query(u)
    built = F.concat(scheme(u), F.lit("://"), host(u), F.when(default, "").otherwise(F.concat(F.lit(":"), p)), path(u), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when(is_safe(u), built)


def is_safe(url: Column | str) -> Column:
    """http(s), a host with a dot, no credentials, control characters, spaces or backslashes."""
    u = _col(url)
    return (scheme(u) != "") & F.contains(host(u), F.lit(".")) & ~u.rlike(r"[\x00-\x20\\]") & ~u.rlike(r"^[a-zA-Z]+://[^/?#]*@")


def page_key(url: Column | str, fallback: Column) -> Column:
    """Identity of a page over its captures, else ``record:`` and the row's own key."""
    return F.coalesce(F.concat(F.lit("page:"), canonical(url)), F.concat(F.lit("record:"), fallback.cast("string")))


def in_scope(url: Column | str, kind: str, at_host: str, at_path: str = "/") -> Column:
    """Whether an address falls under a host, a directory or a page; ``www.`` and default ports do not matter."""
    same = (bare_host(url) == at_host.removeprefix("www.")) & port(url).isin("", "80", "443")
    if kind == "host":
        return same
    p, at = path(url), at_path.rstrip("/")
    if kind == "directory":
        return same & ((p == at) | F.startswith(p, F.lit(at + "/")))
    return same & (p == at_path)


# How archives write a host's default ports.
PORT_SUFFIXES = ("", ":80", ":443", "_80", "_443")


def aliases(at_host: str) -> list[str]:
    """The spellings of a host: with and without ``www.``, by each way to write a default port."""
    names = (at_host.removeprefix("www."), "www." + at_host.removeprefix("www."))
    return [name + suffix for name in names for suffix in PORT_SUFFIXES]


def is_advert(url: Column | str) -> Column:
    return host(url).rlike(r"^(ad|ads|adserver|banner|banners)\d*\.")


def is_asset(url: Column | str) -> Column:
    return F.lower(path(url)).rlike(r"\.(css|js|gif|jpe?g|png|ico|svg|woff2?|zip|exe|mp3|avi)$")


def without_index(url: Column | str) -> Column:
    return F.regexp_replace(_col(url), r"/index\.html$", "")


def archive_path(url: Column | str, captured: Column) -> Column:
    """``websites/<host>/<time>/<path>`` of a capture; an address that ends in a slash is its index page."""
    p = F.regexp_replace(path(url), "/{2,}", "/")
    p = F.when(F.endswith(p, F.lit("/")), F.concat(p, F.lit("index.html"))).otherwise(p)
    q = query(url)
    return F.concat(F.lit("websites/"), host(url), F.lit("/"), captured, p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def parameters(url: Column | str) -> Column:
    """Decoded query parameters; a key that repeats keeps its last value."""
    pairs = F.filter(F.split(query(url), "&"), lambda x: x != "")
    entries = F.transform(pairs, lambda x: F.struct(F.url_decode(F.split_part(x, F.lit("="), F.lit(1))).alias("key"), F.url_decode(F.split_part(x, F.lit("="), F.lit(2))).alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def origin(url: Column | str) -> Column:
    """Scheme, host and port as they are given; null where the address is not http."""
    return F.nullif(F.lower(F.regexp_extract(_col(url), r"^(?i:https?)://[^/?#@]+", 0)), F.lit(""))


def resolved(base: Column | str, link: Column) -> Column:
    """The address that a link of a page names: absolute, of the host, a query of the page, or beside the page. Steps upward are not followed."""
    at = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    beside = F.concat(origin(base), F.regexp_extract(path(base), "^(.*/)", 1), F.regexp_replace(at, r"^(\./)+", ""))
    return (
        F.when(at.rlike(r"^(?i)https?://"), at).when(F.startswith(at, F.lit("//")), F.concat(scheme(base), F.lit(":"), at))
        .when(F.startswith(at, F.lit("/")), F.concat(origin(base), at)).when(F.startswith(at, F.lit("?")), F.concat(origin(base), path(base), at))
        .when(at.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#|$|\.\./)"), None).otherwise(beside)
    )


def has_repeated_key(url: Column | str) -> Column:
    """Whether a query names a parameter twice, so that its value is in doubt."""
    keys = F.transform(F.filter(F.split(query(url), "&"), lambda x: x != ""), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    return F.size(keys) > F.size(F.array_distinct(keys))
