"""Captured documents to passages: links, sections, token-budgeted chunks, embedding requests."""

from __future__ import annotations

import bisect
import html
import re
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.batches import slices

# Token budget of a passage, tokens of overlap, most links and context of a page.
BUDGET, OVERLAP, MOST_LINKS, CONTEXT = 480, 48, 3000, 600

_LINK = re.compile(r"""<(a|area|frame|iframe|base)\b([^>]*)>|<[^>]*>|([^<]+)""", re.I)
_HREF = re.compile(r"""\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _page_links(url: str, source: str):
    base, before, out = url, "", []
    for m in _LINK.finditer(source):
        if m[3]:
            before = (before + " " + " ".join(html.unescape(m[3]).split()))[-CONTEXT:]
            if out and out[-1][1] is None:
                out[-1][1] = " ".join(html.unescape(m[3]).split())
        elif m[1] and (h := _HREF.search(m[2])):
            try:
                target = urljoin(base, html.unescape(h[1] or h[2] or h[3] or "").strip())
            except ValueError:
                continue
            if m[1].lower() == "base":
                base = target
            elif len(out) < MOST_LINKS:
                out.append([target, None, before.strip()])
    return [(t.split("#")[0], a or "", c) for t, a, c in out if t.lower().startswith(("http://", "https://"))]


def links(pages: DataFrame, key: str, url: str, source: str) -> DataFrame:
    """Rows (key, place, target, anchor, context): a page's links, resolved, in order."""
    names = [key, "place", "target", "anchor", "context"]

    def run(batches):
        for batch in slices(batches, source):
            rows = [(k, n, *x) for k, u, s in zip(*(c.to_pylist() for c in batch.columns)) for n, x in enumerate(_page_links(u or "", s or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names)

    return pages.select(F.col(key).cast("long"), url, source).mapInArrow(run, f"`{key}` long, place long, target string, anchor string, context string")


def words_with_places(text: Column) -> Column:
    """White-space tokens of a text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def chunks(rows: DataFrame, key: str, text: str, budget: int = BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """Rows (key, passage, start, end, body): windows of tokens that overlap; start and end count tokens."""
    tokens = rows.select(key, F.explode(F.array(words_with_places(F.col(text)))).alias("w"))
    step = budget - overlap
    last = F.greatest(F.ceil((F.size("w") - overlap) / F.lit(float(step))), F.lit(1)).cast("int")
    starts = F.when(F.size("w") > 0, F.transform(F.sequence(F.lit(0), last - 1), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    flat = tokens.select(key, "w", F.posexplode(starts).alias("passage", "start"))
    end = F.least(F.col("start") + budget, F.size("w"))
    return flat.select(key, F.col("passage").cast("bigint").alias("passage"), F.col("start").cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.array_join(F.slice("w", F.col("start") + 1, budget), " ").alias("body"))


# Words longer than this cost a token for each of their UTF-8 bytes.
LONG_WORD = 100
_PIECE = re.compile(r"(?P<gap>\s+)|\w+|[^\w\s]")
_LINE_END = re.compile(r"\r\n?|\n")
#: Where a text may be cut, from worst to best.
ANYWHERE, WORD, LINE, PARAGRAPH = range(4)


def boundaries(text: str) -> list[tuple[int, int, int]]:
    """(tokens before, offset, kind) of each place where a text may be cut, in order; the last is its end.

    White space is a cut after its end, of the kind it has: with a blank line, with a line
    end or behind a sentence's mark, or plain. The start of a token that no white space
    precedes is a cut of the kind ANYWHERE.
    """
    out, tokens = [], 0
    for m in _PIECE.finditer(text):
        if m.lastgroup:
            lines = len(_LINE_END.findall(m[0]))
            ended = lines == 1 or text[m.start() - 1 : m.start()] in (".", "!", "?")
            out.append((tokens, m.end(), PARAGRAPH if lines > 1 else LINE if ended else WORD))
        elif len(m[0]) > LONG_WORD:
            for at, c in enumerate(m[0], m.start()):
                out.append((tokens, at, ANYWHERE))
                tokens += len(c.encode("utf-8", "replace"))
        else:
            out.append((tokens, m.start(), ANYWHERE))
            tokens += 1
    return [*out, (tokens, len(text), PARAGRAPH)]


def token_starts(text: str) -> np.ndarray:
    """Where each token of a text starts: words and marks, an overlong word byte by byte."""
    cuts = boundaries(text)
    return np.repeat([c[1] for c in cuts[:-1]], [b[0] - a[0] for a, b in zip(cuts, cuts[1:])]).astype(np.int64)


def spans(text: str, budget: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the passages of a text, in code points; together they cover all of it.

    A passage ends at the best cut in the second half of its budget, the last of its kind.
    The next one starts ``overlap`` tokens before that, at white space where there is some.
    """
    cuts, out, start, used = boundaries(text), [], 0, 0
    total = cuts[-1][0]
    while start < len(text):
        if total - used <= budget:
            return [*out, (start, len(text), total - used)]
        low, high = (bisect.bisect_left(cuts, (used + n,)) for n in (-(-budget // 2), budget + 1))
        done, end, _ = max(cuts[min(low, high - 1) : high], key=lambda c: (c[2], c[1]))
        out.append((start, end, done - used))
        again = [c for c in cuts[bisect.bisect_left(cuts, (done - overlap,)) : bisect.bisect_left(cuts, (done, end))] if c[1] > start]
        used, start, _ = next((c for c in again if c[2] > ANYWHERE), again[0] if again else (done, end, ANYWHERE))
    return out


def source_passages(rows: DataFrame, key: str, text: str, prefix: str = "", budget: int = BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """Rows (key, passage, start, end, tokens, body): boundary-aware passages with exact source offsets.

    The prefix's tokens come off the budget. Null and empty texts have no passage.
    """
    left = budget - len(token_starts(prefix))
    if left < 8 or not 0 <= overlap < left // 2:
        raise ValueError("the budget is too small for the prefix and the overlap")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())

    def run(batches):
        for batch in slices(batches, text):
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            found = [(k, n, a, b, c, t[a:b]) for k, t in pairs for n, (a, b, c) in enumerate(spans(t or "", left, overlap))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*found), types)], [key, "passage", "start", "end", "tokens", "body"])

    return rows.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"`{key}` long, passage long, start long, end long, tokens long, body string")


def stitched(passages: DataFrame, key: str) -> DataFrame:
    """Rows (key, text): overlapping passages of a source put together again by their offsets."""
    before = F.coalesce(F.lag("end").over(Window.partitionBy(key).orderBy("passage")), F.lit(0))
    fresh = passages.select(key, "passage", F.substring("body", (before - F.col("start") + 1).cast("int"), F.length("body")).alias("part"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("passage", "part"))), lambda x: x["part"])
    return fresh.groupBy(key).agg(F.array_join(parts, "").alias("text"))


def evidence(passages: DataFrame, key: str, place: str, semantic: str, lexical: str) -> DataFrame:
    """Rows (key, semantic_place, lexical_place, fallback_place): a document's best passages.

    Scores that are null or 0 are no evidence; the first passage stands in where there is none. Ties go to the first.
    """
    def best(score):
        order = F.when(F.col(score) > 0, F.struct(F.col(score), -F.col(place)))
        return F.max_by(place, order)

    rows = passages.groupBy(key).agg(best(semantic).alias("semantic_place"), best(lexical).alias("lexical_place"), F.min(place).alias("first"))
    none = F.col("semantic_place").isNull() & F.col("lexical_place").isNull()
    return rows.withColumn("fallback_place", F.when(none, F.col("first"))).drop("first")


def plan_faults(passages: DataFrame, key: str, budget: int = BUDGET) -> DataFrame:
    """Passages that break an invariant: gaps, starts that do not rise, or too many tokens."""
    own = Window.partitionBy(key).orderBy("passage")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("start") > F.coalesce(before, F.lit(0))
    still = F.coalesce(F.col("start") <= F.lag("start").over(own), F.lit(False))
    return passages.withColumn("fault", F.when(gap, "gap").when(still, "order").when(F.col("end") - F.col("start") > budget, "budget")).where("fault is not null")


def requests(passages: DataFrame, key: str, title: Column) -> tuple[DataFrame, DataFrame]:
    """(distinct embedding requests, places that use them), so that equal passages are embedded once."""
    asked = passages.withColumn("request", F.concat(F.lit("title: "), title, F.lit(" | text: "), F.col("body")))
    asked = asked.withColumn("request_sha256", F.sha2("request", 256))
    return asked.select("request_sha256", "request").dropDuplicates(["request_sha256"]), asked.select(key, "passage", "request_sha256")
