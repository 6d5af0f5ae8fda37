"""Text expressions: words, phrases, shortening, markup stripping. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[0-9a-z]+"
# Common English function words.
STOPWORDS = "a an and are as at be but by for from had has have he her his i in is it its of on or she that the their there they this to was we were which who will with you your".split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def content_words(text: Column | str) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(STOPWORDS))


def collapsed(text: Column | str) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def spaced(tokens: Column) -> Column:
    """Tokens between single spaces, so that a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def has_phrase(tokens: Column, phrase: list[str]) -> Column:
    return F.contains(spaced(tokens), F.lit(f" {' '.join(phrase)} "))


def ngrams(tokens: Column, n: int) -> Column:
    """Adjacent n-grams, joined by a space. Shifted slices are zipped, so tokens are not computed again for each place."""
    size = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), size)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(tokens, F.lit(k), size), lambda a, b: F.concat_ws(" ", a, b))
    return out


def shortened(text: Column | str, most: int) -> Column:
    """The first ``most`` white-space tokens."""
    parts = F.split(collapsed(text), " ")
    return F.array_join(F.slice(parts, 1, most), " ")


def plain(text: Column | str) -> Column:
    """Light markup, links, tags, entities, addresses and mail addresses as line breaks."""
    out = _col(text)
    for pattern, into in (
        (r"(?m)^\[[^\]\n]+\]:.*$", "\n"), (r"!?\[([^\]\n]*)\]\([^)\n]*\)", "$1"), (r"<[^>\n]*>|&#?\w+;", "\n"),
        (r"https?://\S+|www\.\S+", "\n"), (r"\S+@\S+\.\S+", "\n"),
    ):
        out = F.regexp_replace(out, pattern, into)
    return out


def useful(text: Column | str) -> Column:
    """A summary, or null where it says nothing."""
    c = F.trim(_col(text))
    return F.when(F.lower(c).isin("", "none", "null", "n/a", "unknown", "no summary"), None).otherwise(c)


def marked(text: Column, term: str, open_tag: str = "<em>", close_tag: str = "</em>") -> Column:
    """All literal, case-insensitive places of a term between tags, in escaped text."""
    quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in term)
    safe = escaped(text)
    return F.regexp_replace(safe, f"(?i)({quoted})", f"{open_tag}$1{close_tag}")


def escaped(text: Column | str) -> Column:
    out = _col(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def excerpt(text: Column, term: str, width: int = 240) -> Column:
    """A stretch of the text around the first place of a term, or its beginning."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(F.lit(1), at - (width - len(term)) // 2)
    return F.substring(text, start, F.lit(width)) if isinstance(start, Column) else text


# Lines that mailing services added to messages, and the lines of an archive's own header.
PROMOTIONS = ["ONElist is THE place", "e-mails exchanged daily", "ONElist has nearly", r"Looking to expand your world\?", "Yahoo! Groups Links", "Your use of Yahoo! Groups is subject"]
PAGE_HEADER = r"(?m)^\*\*(?:Alternate )?Page URL:\*\*[^\n]*\n"
_PROMOTED = rf"(?im)^[^\n]*(?:{'|'.join(PROMOTIONS)})[^\n]*(?:\n|\z)"


def search_view(text: Column | str, mail: Column) -> Column:
    """A text without its archive header and link targets, headings as ``#``; in mails also without promotion lines. Null stays null.

    Only the line that promotes goes, as it may follow a long quoted conversation directly.
    """
    out = F.regexp_replace(_col(text), PAGE_HEADER, "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<h1>(.*?)</h1>", "# $1"), r"!?\[([^\]\n]*)\]\([^)\n]*\)", "$1")
    return F.when(mail, F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?>", "\n"), _PROMOTED, "")).otherwise(out)


def promotions(text: Column | str) -> Column:
    """How many lines of a mail promote its service."""
    return F.size(F.regexp_extract_all(F.regexp_replace(_col(text), r"(?i)<br\s*/?>", "\n"), F.lit(_PROMOTED), F.lit(0)))


def pieces(text: Column | str, most: int) -> Column:
    """A text in order, whole, as pieces of at most so many characters, each cut after the last space or line end of its second half, if there is one.

    Null has none, and neither has an empty text. One pattern finds every cut.
    """
    half = most // 2
    return F.coalesce(F.regexp_extract_all(_col(text), F.lit(rf"(?s).{{1,{most}}}\z|.{{{half},{most - 1}}}[ \n]|.{{{most}}}"), F.lit(0)), F.array().cast("array<string>"))


def strict_json(text: Column | str) -> Column:
    """A JSON value as a variant; null if it is malformed, repeats a key at any depth, or is followed by anything.

    The parser refuses repeated keys but reads no further than one value. What follows the
    value can close an array or an object, never both, so both must hold it whole.
    """
    c = _col(text)
    inside, named = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"value":'), c, F.lit("}")))
    return F.when(named.isNotNull(), F.try_variant_get(inside, "$[0]", "variant"))
