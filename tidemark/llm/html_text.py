"""Main text of web pages: a host suffix array beside the page's structure.

A page is cut into blocks; its elements say which blocks are chrome (menus, headers,
adverts, forms, comments and the like) and which stand in the page's article. Pages are
then dealt to groups of bounded size. A group concatenates the token streams of its pages'
visible blocks and sorts their suffixes to the depth that matters; it tells its distinct
stretches by host, with the pages that hold them. These are summed over all groups, so a
stretch is repeated when several distinct pages of its host hold it, wherever they are.
Covered stretches are removed as boilerplate, inside articles too, and unique runs kept.
The structure guards this: a marked article that repeats as a whole is kept, and marked
chrome goes even where it is unique.

Most stretches are unique, and few of them travel. Each stretch holds the runs of ANCHOR
words inside it; the one with the least digest stands for it, on every page alike. These
anchors are counted first, under short digests, which may count too many but never too
few; only stretches over a repeated anchor are then counted under full digests. Digests are
packed by ranges of their value; a range holds one entry of a stretch for each group.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytescan import U64, Words, binary, mix
from tidemark.llm.shared import partitions, text_bytes

#: Tokens of a repeated stretch and of an anchor, and the distinct pages of a host that must hold a stretch.
RUN, ANCHOR, PAGES = 8, 5, 3
#: Bytes of html and pages that are parsed at once; bytes behind a group of pages, a range of digests and a task.
LOT_BYTES, LOT_PAGES = 8 << 20, 4096
GROUP_BYTES, RANGE_BYTES, TASK_BYTES = 8 << 20, 8 << 20, 64 << 20
#: Bits of an anchor's short digest beyond those that number the bytes of the table.
SPARE_BITS = 8
#: Stands between the texts of pages; no text holds it, as it counts as white space.
SEPARATOR = "\x1f"

# Element names of the HTML standard and the words that sites use in class, id and role.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template iframe textarea title svg math canvas object audio video select option datalist".split())
_CHROME = set("nav footer aside form button head menu dialog label fieldset legend output progress".split()) | _RAW
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_WORDS = set("""nav navbar navigation menu menubar breadcrumb breadcrumbs masthead banner topbar footer sidebar widget widgets
    ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert
    popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments commentlist
    reply replies respond disqus related recommended recommendations pagination pager skip toolbar copyright disclaimer legal form hidden""".split())
_OUTER = set("header top bottom side".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_COMMENTS = set("comment comments commentlist reply replies respond".split())
_BODY = set("article main post entry story content".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']|"[^"]*"|'[^']*')*+)>|([^>]*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![^\s"'])(hidden)(?![^\s])""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
CHROME, OPEN, WEAK, MAIN, ARTICLE = range(5)


def _standing(name: str, attributes: str, inside: int) -> int:
    """What an element makes of its content: one of CHROME to ARTICLE; inside is where it stands."""
    if name in _CHROME or name == "header" and inside < MAIN:
        return CHROME
    words: set[str] = set()  # whole names of classes and ids, and their parts
    parts: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key = (m[1] or m[5]).lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            words.update(value.split())
            parts.update(_SPLIT.split(value))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return CHROME
        elif key == "role":
            if value in _ROLES:
                return CHROME
            words.update(("article", "main") if value in ("article", "main") else ())
        elif key == "itemprop" and value == "articlebody":
            words.add("article")
    if name == "article":
        return CHROME if words & _COMMENTS else max(inside, ARTICLE)
    if name == "main":
        return max(inside, MAIN)
    # Inside a marked part only whole names tell of chrome, as in <div class="share-price">; outside of one, parts do, unless the element is named as a body.
    if inside < MAIN and not words & _BODY:
        words = words | parts
    if name not in ("html", "body") and (words & _WORDS or inside < MAIN and words & _OUTER):
        return CHROME
    return max(inside, WEAK) if words & _BODY and name not in ("html", "body") else inside


def blocks(source: str) -> list[tuple[int, str]]:
    """(standing, text) of the page's blocks in order, with white space as one space; no empty ones."""
    out: list[tuple[int, list[str]]] = []
    stack: list[tuple[str, int]] = []
    level, fresh, at = OPEN, True, 0

    def put(piece: str) -> None:
        nonlocal fresh
        if not piece:
            return
        if fresh or not out or out[-1][0] != level:
            out.append((level, []))
            fresh = False
        out[-1][1].append(piece)

    while True:
        tag = _TAG.search(source, at)
        if level != CHROME:
            put(source[at : tag.start() if tag else len(source)])
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if name not in _INLINE:
            fresh = True
        if tag[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    level = stack[-1][1] if stack else OPEN
                    break
            continue
        attributes = tag[3] if tag[3] is not None else tag[4]
        if name in _VOID:
            continue
        if name in _RAW:
            if not (attributes or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if name == "body":
            stack, level = [], OPEN
        level = level if level == CHROME else _standing(name, attributes or "", level)
        stack.append((name, level))
    texts = ((k, " ".join(html.unescape("".join(p)).split())) for k, p in out)
    return [(k, t) for k, t in texts if t]


def ranked(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of all streams: its stream, the tokens left in it, and the rank of its suffix to the depth of RUN.

    ids are equal for equal tokens. Suffixes are ranked by doubling prefixes; equal ranks are equal stretches.
    """
    page = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
    _, rank = np.unique(ids, return_inverse=True)
    depth = 1
    while depth < RUN:
        step = min(depth, RUN - depth)
        follow = np.full(len(rank), -1, np.int64)
        follow[:-step] = rank[step:]
        pair = rank * (int(rank.max(initial=0)) + 2) + np.where(left > step, follow, -1) + 1
        _, rank = np.unique(pair, return_inverse=True)
        depth += step
    return page, left, rank


def tallied(page: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one row of each distinct keys, how many distinct pages have them)."""
    if not len(page):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((page, *keys))
    new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))
    new_page = new.copy()
    new_page[1:] |= page[order][1:] != page[order][:-1]
    return order[new], np.add.reduceat(new_page.astype(np.int64), np.flatnonzero(new))


def covered(sizes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each stream, which tokens stand in a stretch that begins at one of first."""
    edge = np.zeros(int(sizes.sum()) + RUN + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + RUN, -1)
    return np.split(np.cumsum(edge)[: int(sizes.sum())] > 0, np.cumsum(sizes)[:-1]) if len(sizes) else []


def repeated(streams: list[list[str]]) -> list[np.ndarray]:
    """For each token stream of one host, which tokens stand in a stretch of RUN tokens that PAGES or more streams hold."""
    names: dict[str, int] = {}
    sizes = np.array([len(s) for s in streams], np.int64)
    page, left, rank = ranked(np.fromiter((names.setdefault(t, len(names)) for s in streams for t in s), np.int64, int(sizes.sum())), sizes)
    first = np.flatnonzero(left >= RUN)
    one, n = tallied(page[first], rank[first])
    found = first[np.isin(rank[first], rank[first][one[n >= PAGES]])]
    return covered(sizes, found)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by planes of equal bytes, as those of high places are alike and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(planes: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(planes, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def main_text(page: list[tuple[int, str]], gone: np.ndarray) -> str:
    """What is left of a page's blocks: gone says which words stand in a repeated stretch.

    The top standing above OPEN is the page's marked part. If no stretch of RUN own words
    is left of it, the part as a whole repeats (a copy, perhaps with small edits), and it
    is kept whole. Beside it, an unmarked block shorter than a stretch goes, as repeats
    cannot tell about it. Everything else is what the repeats leave.
    """
    words = [w for _, t in page for w in t.split(" ")]
    sizes = [t.count(" ") + 1 for _, t in page]
    standing = np.repeat([k for k, _ in page], sizes)
    keep = ~gone
    best = max((k for k, _ in page), default=OPEN)
    if best > OPEN:
        marked = standing == best
        own = keep[marked]
        if not (len(own) >= RUN and np.convolve(own, np.ones(RUN, int), "valid").max() == RUN):
            keep = keep | marked
        keep = keep & ((standing > OPEN) | (np.repeat(sizes, sizes) >= RUN))
    return " ".join(w for w, k in zip(words, keep) if k)


def _lots(batches, columns: tuple[str, ...], source: str) -> Iterator[list[list]]:
    """The named columns of consecutive rows, at most LOT_PAGES or little over LOT_BYTES of source."""
    for batch in batches:
        rows = batch.select(columns)
        at, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch[source]), 0).to_pylist()
        for k, n in enumerate(lengths):
            if k > at and (size > LOT_BYTES or k - at >= LOT_PAGES):
                yield [c.to_pylist() for c in rows.slice(at, k - at).columns]
                at, size = k, 0
            size += n
        if len(lengths) > at:
            yield [c.to_pylist() for c in rows.slice(at).columns]


class Group:
    """The parsed pages of a group, their words, and digests of runs of words within a page and its host."""

    def __init__(self, rows: pa.Table):
        self.ids, self.urls, self.hosts, self.standings = (sum(rows[c].to_pylist(), []) for c in ("ids", "urls", "hosts", "standings"))
        bodies = [pa.decompress(b, n, codec="zstd").to_pybytes() for b, n in zip(rows["body"].to_pylist(), rows["size"].to_pylist())]
        self.texts = [t for b in bodies for t in b.split(SEPARATOR.encode())]
        offsets = np.append(0, np.cumsum([len(t) for t in self.texts])).astype(np.int64)
        self.words = Words(np.frombuffer(b"".join(self.texts), np.uint8), offsets)
        self.page = self.words.row_of_word()
        self.host = mix(np.array(self.hosts, np.int64).view(U64))[self.page]

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words of the runs of n, their digests within the host)."""
        first, h = self.words.windows(n)
        return first, mix(h ^ self.host[first])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words of the stretches, for each the place of its anchor, digests of the runs of ANCHOR by first word)."""
        at, h = self.runs(ANCHOR)
        digest = np.full(len(self.page) + RUN, ~U64(0))
        digest[at] = h
        first = self.words.windows(RUN)[0]
        near = np.stack([digest[first + k] for k in range(RUN - ANCHOR + 1)])
        return first, first + near.argmin(0), digest


def _told(group: int, part: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.Table:
    """Rows (range, group, keys, pages): digests in order, with the pages up to PAGES that hold them."""
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = [*cuts[1:], len(key)]
    return pa.table({
        "range": pa.array(part[cuts], pa.int32()), "group": pa.array(np.full(len(cuts), group), pa.int32()),
        "keys": binary([_planes(np.diff(key[i:j], prepend=U64(0))) for i, j in zip(cuts, ends)]),
        "pages": binary([np.minimum(n[i:j], PAGES).astype(np.uint8).tobytes() for i, j in zip(cuts, ends)]),
    })


TOLD = "range int, group int, keys binary, pages binary"


def _tell_anchors(bits: int, ranges: int):
    def tell(rows: pa.Table) -> pa.Table:
        group = Group(rows)
        _, place, digest = group.anchors()
        place = np.unique(place)
        key = digest[place] >> U64(64 - bits)
        one, n = tallied(group.page[place], key)
        key = key[one]
        return _told(rows["group"][0].as_py(), ((key >> U64(bits - 24)) * U64(ranges) >> U64(24)).astype(np.int64), key, n)

    return tell


def _known(found: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, U64), *(np.cumsum(_numbers(k, U64), dtype=U64) for k in found["keys"].to_pylist())]))


def _within(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _tell_stretches(bits: int, ranges: int):
    """The stretches over anchors that are known to repeat."""

    def tell(rows: pa.Table, found: pa.Table) -> pa.Table:
        known, group = _known(found), Group(rows)
        first, place, digest = group.anchors()
        first = first[_within(known, digest[place] >> U64(64 - bits))]
        page, _, rank = ranked(group.words.digests(), group.words.count)
        one, n = tallied(page[first], group.host[first], rank[first])
        at, h = group.runs(RUN)
        key = h[np.searchsorted(at, first[one])]
        order = np.argsort(key)
        key = key[order]
        return _told(rows["group"][0].as_py() if len(rows) else 0, ((key >> U64(40)) * U64(ranges) >> U64(24)).astype(np.int64), key, n[order])

    return tell


def _settled(told: pa.Table) -> pa.Table:
    """Rows (group, keys): for each group, its digests that PAGES or more pages of all groups hold."""
    keys = [np.cumsum(_numbers(k, U64), dtype=U64) for k in told["keys"].to_pylist()]
    key, n = np.concatenate(keys), np.frombuffer(b"".join(told["pages"].to_pylist()), np.uint8).astype(np.int64)
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    good = np.zeros(len(key), bool)
    good[order] = np.repeat(np.add.reduceat(n[order], start) >= PAGES, np.diff(np.append(start, len(key))))
    ends = np.cumsum([len(k) for k in keys])
    replies = [(g, key[i:j][good[i:j]]) for g, i, j in zip(told["group"].to_pylist(), np.append(0, ends[:-1]), ends) if good[i:j].any()]
    return pa.table({"group": pa.array([g for g, _ in replies], pa.int32()), "keys": binary([_planes(np.diff(k, prepend=U64(0))) for _, k in replies])})


def _left(rows: pa.Table, found: pa.Table) -> pa.Table:
    """Main texts of a group's pages."""
    group, known = Group(rows), _known(found)
    first, h = group.runs(RUN)
    gone = covered(group.words.count, first[_within(known, h)])
    texts = [t.decode("utf-8", "surrogatepass") for t in group.texts]
    out = [main_text([*zip(s, t.split("\n"))] if t else [], g) for s, t, g in zip(group.standings, texts, gone)]
    return pa.table({
        "id": pa.array(group.ids, pa.int64()), "url": pa.array(group.urls, pa.string()),
        "text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64()),
    })


PARSED = "group int, ids array<long>, urls array<string>, hosts array<long>, standings array<binary>, size long, body binary"


def _parsed(batches):
    """The pages of a lot by group: texts with one line a block, compressed together, and one byte a block for its standing."""
    for group, key, url, host, source in _lots(batches, ("group", "id", "url", "host", "html"), "html"):
        pages = [blocks(s or "") for s in source]
        order = np.argsort(np.array(group), kind="stable")
        own = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(np.array(group)[order])) + 1)]
        bodies = [SEPARATOR.join("\n".join(t for _, t in pages[k]) for k in at).encode("utf-8", "surrogatepass") for at in own]
        yield pa.RecordBatch.from_pydict({
            "group": pa.array([group[at[0]] for at in own], pa.int32()), "ids": pa.array([[key[k] for k in at] for at in own], pa.list_(pa.int64())),
            "urls": pa.array([[url[k] for k in at] for at in own], pa.list_(pa.string())), "hosts": pa.array([[host[k] for k in at] for at in own], pa.list_(pa.int64())),
            "standings": pa.array([[bytes(s for s, _ in pages[k]) for k in at] for at in own], pa.list_(pa.binary())),
            "size": pa.array([len(b) for b in bodies], pa.int64()), "body": binary([pa.compress(b, codec="zstd", asbytes=True) for b in bodies]),
        })


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars) for every row of pages.

    Null html is empty, and an empty page has empty text. Every page is what the host's
    suffix arrays leave of it, but a marked part that repeats as a whole. A url without a host, or a
    null one, counts as the host ''. Null and repeated ids are carried, repeated rows each
    come out, an empty table gives no rows, other columns are ignored; pages are read
    whole. Character references are decoded and blocks joined by one space.
    """
    spark = pages.sparkSession
    host = F.lower(F.coalesce(F.regexp_extract(url_column, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), F.xxhash64(host).alias("host"), F.col(html_column).alias("html"))
    size, least = text_bytes(rows, "html"), partitions(spark)
    groups, ranges = max(4 * least, -(-size // GROUP_BYTES)), max(least, -(-size // RANGE_BYTES))
    tasks, bits = max(least, -(-size // TASK_BYTES)), min(64, max(32, size.bit_length() + SPARE_BITS))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("id", "url", "html"), F.lit(groups)).cast("int"))
    parsed = rows.mapInArrow(_parsed, PARSED).repartition(tasks, "group")
    shape = "group int, keys binary"
    anchors = parsed.groupBy("group").applyInArrow(_tell_anchors(bits, ranges), TOLD).groupBy("range").applyInArrow(_settled, shape)
    told = parsed.groupBy("group").cogroup(anchors.groupBy("group")).applyInArrow(_tell_stretches(bits, ranges), TOLD)
    found = told.groupBy("range").applyInArrow(_settled, shape)
    out = parsed.groupBy("group").cogroup(found.groupBy("group")).applyInArrow(_left, "id long, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_column)
