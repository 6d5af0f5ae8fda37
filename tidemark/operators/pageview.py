"""The readable view of captured pages: blocks of a page in order, with layout tables flattened and data tables kept, and their Markdown."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.batches import slices
from tidemark.functions.markup import BLOCK, RAW, Tree, isolated

# Weekday names, words of login forms, and parts of addresses that deliver advertising.
_DAYS = {name: k for k, names in enumerate(("su sun sunday", "mo mon monday", "tu tue tuesday", "we wed wednesday", "th thu thursday", "fr fri friday", "sa sat saturday")) for name in names.split()}
_MONTHS = re.compile(r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b|\d{4}|[<>«»\s]", re.I)
_LOGIN = re.compile(r"please|log\s*in|username|user\s*name|password|remember|register|forgot(?:ten)?|your|\W", re.I)
_DELIVERY = re.compile(r"^(?:https?:)?//.*[./_-](?:ads?|adserver|serve|banner|placement|syndication)(?:[./_?=&-]|$)", re.I)
_GUARDED = {"pre", "code", "blockquote", "article", "main"}

#: Inline elements and their marks.
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`", "tt": "`"}
_HEADINGS = {f"h{k}": k for k in range(1, 7)}
_CELL = pa.struct([("text", pa.string()), ("columns", pa.int32()), ("rows", pa.int32()), ("head", pa.bool_())])
_SHAPE = [
    ("block", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("quote", pa.int32()), ("marker", pa.string()), ("text", pa.string()),
    ("place", pa.int32()), ("cells", pa.list_(_CELL)),
]
BLOCKS = "block int, kind string, level int, quote int, marker string, text string, place int, cells array<struct<text:string,columns:int,rows:int,head:boolean>>"


def is_layout(tree: Tree, table: int, owner: list[int], inked: list[int]) -> bool:
    """Whether a table only arranges a page: it says so, holds tables or a background, or no row of it has two filled cells. Captions and header cells speak against it."""
    if (tree.attribute(table, "role") or "").lower() in ("presentation", "none"):
        return True
    own = [k for k in range(table + 1, tree.end[table]) if owner[k] == table]
    if any(tree.tag[k] in ("th", "caption", "thead", "tfoot") for k in own):
        return False
    cells = [k for k in own if tree.tag[k] == "td"]
    if tree.within(table, {"table"}) or any(tree.attribute(k, "background") is not None for k in [table, *cells]):
        return True
    filled: dict[int, int] = {}
    for k in cells:
        filled[tree.parent[k]] = filled.get(tree.parent[k], 0) + (inked[tree.end[k]] > inked[k])
    return max(filled.values(), default=0) <= 1


def scaffolding(tree: Tree, owner: list[int]) -> dict[int, str]:
    """Generated parts of a page, with why: calendars, login controls, advertising panels. What was written by people vetoes."""
    out: dict[int, str] = {}

    def guarded(node: int) -> bool:
        return bool(tree.within(node, _GUARDED)) or any(tree.tag[k] in _GUARDED for k in tree.above(node))

    for k, tag in enumerate(tree.tag):
        if tag == "table":
            values = [tree.words(c).lower() for c in tree.within(k, {"td", "th"}) if owner[c] == k]
            numbers = sum(v.isdecimal() and len(v) <= 2 for v in values)
            rest = " ".join(v for v in values if v not in _DAYS and not (v.isdecimal() and len(v) <= 2))
            if numbers >= 14 and len({_DAYS[v] for v in values if v in _DAYS}) == 7 and not _MONTHS.sub("", rest) and not guarded(k):
                out[k] = "calendar"
        if tag == "input" and (tree.attribute(k, "type") or "").lower() == "password":
            for up in tree.above(k):
                if tree.tag[up] not in ("div", "td", "table", "form"):
                    continue
                text = tree.words(up)
                if len(text) > 180 or guarded(up) or tree.within(up, {"textarea"}):
                    break
                if not _LOGIN.sub("", text) and any(re.search("user|login", tree.attribute(i, "name") or "", re.I) for i in tree.within(up, {"input"})):
                    out[up] = "login"
                    break
        if tag in ("table", "div") and any(_DELIVERY.search(tree.attribute(s, "src") or "") for s in tree.within(k, {"script"})):
            text, links = tree.words(k).replace(" ", ""), tree.within(k, {"a"})
            linked = sum(len(tree.words(a).replace(" ", "")) for a in links)
            long = any(len(tree.words(p)) > 40 for p in tree.within(k, {"p", "li"}))
            if len(links) >= 3 and tree.within(k, {"img"}) and linked >= 0.9 * len(text) and len(text) < 1000 and not long and not tree.within(k, {"th", "caption"}) and not guarded(k):
                out[k] = "advertising"
    return out


@dataclass
class Writer:
    """Collects inline pieces into blocks. Inline marks that are open where a block ends are closed there and opened again in the next."""

    blocks: list[tuple] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    marks: list[list] = field(default_factory=list)  # [mark, address of a link, place in pieces]
    kind: str = "prose"
    level: int = 0
    quote: int = 0
    marker: str = ""

    def open(self, mark: str, address: str | None = None) -> None:
        self.marks.append([mark, address, len(self.pieces)])

    def close(self) -> None:
        self._wrap(self.marks.pop())

    def _wrap(self, frame: list) -> None:
        mark, address, at = frame
        inner = "".join(self.pieces[at:])
        text = inner.strip()
        if text and (address or mark not in (m for m, a, _ in self.marks if not a)):
            shown = f"[{text}]({address})" if address else mark + text + mark
            self.pieces[at:] = [inner[: len(inner) - len(inner.lstrip())], shown, inner[len(inner.rstrip()) :]]

    def lines(self) -> list[str]:
        """The pieces so far as lines, and none left; open marks begin anew."""
        held = self.marks
        for k in range(len(held) - 1, -1, -1):
            self.marks = held[:k]
            self._wrap(held[k])
        self.marks = [[m, a, 0] for m, a, _ in held]
        text, self.pieces = "".join(self.pieces), []
        return [x for x in (" ".join(line.split()) for line in text.split("\0")) if x] if self.kind != "code" else [text.replace("\0", "\n").strip("\n")] if text.strip() else []

    def flush(self) -> None:
        if lines := self.lines():
            self.blocks.append((self.kind, self.level, self.quote, self.marker, "\n".join(lines) if self.kind == "code" else "  \n".join(lines), None, None))
            self.marker = ""


def blocks(source: str) -> tuple[list[tuple], list[str]]:
    """((kind, level, quote depth, marker, text, row's place, cells) of a page's blocks, what was left out and why).

    Kinds are prose, heading, item, code, rule and row; a row is one of a data table. Text
    is kept as it is, with white space as one space but in code.
    """
    raw, scripts = isolated(source, None)
    tree, out = Tree(raw), Writer()
    owner, inked = tree.owners("table"), tree.inked()
    data = {k for k, tag in enumerate(tree.tag) if tag == "table" and not is_layout(tree, k, owner, inked)}
    gone = scaffolding(tree, owner)
    notes = ["script"] * scripts + ["noframes"] * tree.tag.count("noframes") + [gone[k] for k in sorted(gone)]
    ends: list[tuple[int, str, tuple]] = []  # (where an element ends, its tag, what to set then)
    table, rows, cells = 0, 0, None
    items: dict[int, int] = {}  # of each list so far
    k = 1
    while k <= len(tree.tag):
        while ends and ends[-1][0] <= k:
            _, tag, before = ends.pop()
            if tag in _MARKS or tag == "a":
                out.close()
            elif tag in ("td", "th") and cells is not None:
                node = before[0]
                span = [max(1, min(1000, int(v))) if (v := tree.attribute(node, name) or "").isdecimal() else 1 for name in ("colspan", "rowspan")]
                cells.append({"text": " ".join(out.lines()), "columns": span[0], "rows": span[1], "head": tag == "th"})
            elif tag == "tr" and cells is not None:
                if cells:
                    out.blocks.append(("row", table, out.quote, "", "", rows, cells))
                    rows += 1
                cells = None
            elif cells is not None:
                out.pieces.append(" ")
            else:
                out.flush()
                if before:
                    out.kind, out.level, out.quote, out.marker, table, rows = before
        if k == len(tree.tag):
            break
        tag, end = tree.tag[k], tree.end[k]
        if k in gone:
            k = end
            continue
        state = (out.kind, out.level, out.quote, out.marker, table, rows)
        if tag == "#":
            out.pieces.append(tree.data[k])
        elif tag == "img":
            if src := tree.attribute(k, "src"):
                out.pieces.append(f"![{' '.join((tree.attribute(k, 'alt') or '').split())}]({src})")
        elif tag == "br":
            out.pieces.append("\0" if cells is None else " ")
        elif tag in _MARKS or tag == "a":
            out.open(_MARKS.get(tag, ""), tree.attribute(k, "href") if tag == "a" else None)
            ends.append((end, tag, ()))
        elif table and tag in ("tr", "td", "th", "caption") and owner[k] == table and table in data:
            if tag == "tr":
                out.flush()
                cells = []
                ends.append((end, tag, ()))
            elif tag == "caption" or cells is None:
                out.flush()
                ends.append((end, "div", ()))
            else:
                out.lines()
                ends.append((end, tag, (k,)))
        elif tag == "hr" and cells is None:
            out.flush()
            out.blocks.append(("rule", 0, out.quote, "", "", None, None))
        elif cells is not None and tag in BLOCK:
            out.pieces.append(" ")
            ends.append((end, tag if tag not in ("td", "th", "tr") else "div", ()))
        elif tag in BLOCK or tag == "break":
            out.flush()
            if tag in _HEADINGS:
                out.kind, out.level = "heading", _HEADINGS[tag]
            elif tag == "blockquote":
                out.quote += 1
            elif tag == "pre":
                out.kind = "code"
            elif tag in ("ul", "ol", "menu"):
                out.kind, out.level = "item", (out.level if out.kind == "item" else 0) + 1
            elif tag == "li":
                up = tree.parent[k]
                items[up] = items.get(up, 0) + 1
                out.kind, out.level, out.marker = "item", max(1, out.level if out.kind == "item" else 1), f"{items[up]}." if tree.tag[up] == "ol" else "-"
            elif tag == "table" and k in data:
                table, rows = k, 0
            ends.append((end, "div", state))
        k = end if tag in RAW else k + 1
    out.flush()
    return out.blocks, notes


def page_blocks(pages: DataFrame, key: str, source: str) -> DataFrame:
    """Rows (key, notes, block, kind, level, quote, marker, text, place, cells): the blocks of every page, in order.

    ``level`` is that of a heading, the depth of an item, or the number of a data table in its page's mark-up.
    A page without blocks, also a null one, has one row with a null block.
    """
    shape = pa.schema([("notes", pa.list_(pa.string())), *_SHAPE])

    def run(batches):
        for batch in slices(batches, source):
            keys, rows = [], []
            for n, own in enumerate(batch[source].to_pylist()):
                found, notes = blocks(own or "")
                rows += [(notes, b, *x) for b, x in enumerate(found)] or [(notes, *[None] * len(_SHAPE))]
                keys += [n] * (len(found) or 1)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), shape)] if rows else [pa.array([], f.type) for f in shape]
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(keys, pa.int64())), *columns], [key, *shape.names])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, source).mapInArrow(run, f"`{key}` {kind}, notes array<string>, {BLOCKS}")


def isolated_pages(pages: DataFrame, key: str, source: str) -> DataFrame:
    """Rows (key, html, isolated): every page with its scripts emptied, and how many there were; null is an empty page."""

    def run(batches):
        for batch in slices(batches, source):
            html, n = zip(*(isolated(own or "", None) for own in batch[source].to_pylist()))
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(html, pa.string()), pa.array(n, pa.int64())], [key, "html", "isolated"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, source).mapInArrow(run, f"`{key}` {kind}, html string, isolated long")


def cell_line(cells: Column) -> Column:
    """A table row in Markdown; a cell over several columns leaves the others empty."""
    wide = F.flatten(F.transform(cells, lambda c: F.concat(F.array(F.replace(c["text"], F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), c["columns"] - 1))))
    return F.concat(F.lit("| "), F.array_join(wide, " | "), F.lit(" |"))


def markdown(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, markdown, blocks, notes) of ``page_blocks``: blocks apart by an empty line, rows of a table and items of a list not."""
    indent = F.repeat(F.lit("    "), F.greatest(F.col("level") - 1, F.lit(0)))
    dashes = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.aggregate("cells", F.lit(0), lambda s, c: s + c["columns"])), " | "), F.lit(" |"))
    line = cell_line(F.col("cells"))
    shown = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text"))
        .when(F.col("kind") == "item", F.concat(indent, F.when(F.col("marker") == "", F.lit("    ")).otherwise(F.concat("marker", F.lit(" "))), "text"))
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .when(F.col("kind") == "rule", F.lit("---"))
        .when(F.col("kind") == "row", F.when(F.col("place") == 0, F.concat(line, F.lit("\n"), dashes)).otherwise(line))
        .otherwise(F.col("text"))
    )
    marks = F.repeat(F.lit("> "), F.col("quote"))
    shown = F.concat(marks, F.replace(shown, F.lit("\n"), F.concat(F.lit("\n"), marks)))
    tight = (F.col("kind") == "row") & (F.col("place") > 0) | (F.col("kind") == "item") & (F.col("marker") != "")
    parts = F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", shown.alias("shown"), tight.alias("tight"), "kind"))))
    joined = F.aggregate(parts, F.struct(F.lit("").alias("text"), F.lit("").alias("kind")), lambda s, p: F.struct(
        F.concat(s["text"], F.when(s["kind"] == "", "").when(p["tight"] & (s["kind"] == p["kind"]), "\n").otherwise("\n\n"), p["shown"]).alias("text"), p["kind"].alias("kind")))
    return rows.groupBy(key).agg(joined["text"].alias("markdown"), F.count("block").alias("blocks"), F.any_value("notes").alias("notes"))
