"""Small pieces of sources put together within a token budget: lines, table rows, and passages inside others."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.passages import BUDGET, spans, token_starts

#: Words and marks, alike in Spark and SQL.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Tokens that a table's repeated header may have.
HEADER = 80


def tokens(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, line, start, end, tokens, kind, context): the lines of a text with their exact places; a line holds its end.

    A line of capitals and digits without a sentence's end is a heading.
    """
    parts = rows.select(key, F.posexplode(F.split(text, "(?<=\n)")).alias("line", "body")).where("body <> ''")
    end = F.sum(F.length("body")).over(Window.partitionBy(key).orderBy("line")).cast("long")
    heading = F.col("body").rlike(r"^[\p{Lu}\p{N}\s]+$")
    return parts.select(
        key, F.col("line").cast("long").alias("line"), (end - F.length("body")).alias("start"), end.alias("end"), tokens("body").alias("tokens"),
        F.when(heading, "heading").otherwise("prose").alias("kind"), F.lit("").alias("context"),
    )


def packed(passages: DataFrame, key: str, budget: int = BUDGET) -> DataFrame:
    """Rows (key, passage, start, end, tokens, kind, context): neighbours put together, in order, while the budget holds.

    Neighbours touch and have one context. Prose goes with prose, and a heading with what
    follows it, whose kind the two then have; other kinds stay as they are. A passage over
    the budget stays whole. Rows of one key stay with one task, as they are one source.
    """
    names = ["passage", "start", "end", "tokens", "kind", "context"]

    def run(table: pa.Table) -> pa.Table:
        out: list[list] = []
        for start, end, n, kind, context in sorted(zip(*(table[c].to_pylist() for c in names[1:])), key=lambda r: r[:2]):
            last = out[-1] if out else None
            if last and last[1] == start and last[4] == context and last[2] + n <= budget and (last[3] == "heading" or last[3] == kind == "prose"):
                last[1:4] = end, last[2] + n, kind
            else:
                out.append([start, end, n, kind, context])
        rows = [[k, *r] for k, r in enumerate(out)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        own = table[key].take(pa.array([0] * len(rows), pa.int64()))
        return pa.Table.from_arrays([own, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [key, *names])

    kind = passages.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, passage long, start long, end long, tokens long, kind string, context string"
    return passages.select(key, *[F.col(c).cast("long") if c in ("start", "end", "tokens") else F.col(c) for c in names[1:]]).groupBy(key).applyInArrow(run, shape)


def outermost(passages: DataFrame, *by: str) -> DataFrame:
    """The passages that lie in no other of theirs by the given columns; of equal ones the first stays.

    Sorted by start, and the longest first, a passage lies in another exactly where one
    before it reaches as far: one sort and a running maximum.
    """
    own = Window.partitionBy(*by).orderBy("start", F.desc("end"), "passage")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    return passages.withColumn("__reach", reach).where(F.col("__reach").isNull() | (F.col("__reach") < F.col("end"))).drop("__reach")


def grid(rows: list[list[dict]]) -> Iterator[list[str]]:
    """The rows of a table with every cell in its columns; a cell over several rows or columns shows once, and '' elsewhere."""
    held: dict[int, int] = {}  # rows that a column is still taken for
    for cells in rows:
        line: list[str] = []

        def skip() -> None:
            while held.get(len(line), 0):
                held[len(line)] -= 1
                line.append("")

        for cell in cells:
            skip()
            for k in range(cell["columns"]):
                if cell["rows"] > 1:
                    held[len(line)] = cell["rows"] - 1
                line.append("" if k else cell["text"])
        skip()
        yield line


def _line(cells: list[str]) -> str:
    return "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"


def _pack_rows(rows: list[list[dict]], budget: int) -> list[tuple]:
    """(first row, last row, header, body, tokens) of a table's chunks."""
    shown = [_line(r) for r in grid(rows)]
    heads = next((k for k, r in enumerate(rows) if not all(c["head"] for c in r)), len(rows))
    header = "\n".join(shown[:heads]) if 0 < heads < len(rows) else ""
    cost = len(token_starts(header))
    if cost > HEADER:
        header = header[: int(token_starts(header)[HEADER])].rstrip()
        cost = HEADER
    out: list[list] = []
    for k in range(heads if header else 0, len(rows)):
        n = len(token_starts(shown[k]))
        if n + cost > budget:
            out += [[k, k, header, shown[k][a:b], m + cost, True] for a, b, m in spans(shown[k], budget - cost, 0)]
        elif out and not out[-1][5] and out[-1][4] + n <= budget:
            out[-1][1], out[-1][3], out[-1][4] = k, f"{out[-1][3]}\n{shown[k]}", out[-1][4] + n
        else:
            out.append([k, k, header, shown[k], n + cost, False])
    return [tuple(r[:5]) for r in out]


def table_chunks(rows: DataFrame, key: str, budget: int = BUDGET) -> DataFrame:
    """Rows (key, table, chunk, first, last, header, body, tokens) of the rows of data tables of ``page_blocks``.

    A chunk holds whole rows, as many as fit with the header, which each chunk repeats; a
    row that does not fit alone is cut into several. The header is the leading rows of
    header cells, cut off after HEADER tokens; they are not rows of chunks themselves,
    unless the table has no other. No chunk is over the budget.
    """
    if budget < HEADER + 16:
        raise ValueError("the budget is too small for a header")

    def run(table: pa.Table) -> pa.Table:
        order = sorted(zip(table["place"].to_pylist(), table["cells"].to_pylist()), key=lambda r: r[0])
        found = _pack_rows([cells for _, cells in order], budget)
        first, last, header, body, n = zip(*found)
        own = [table[c].take(pa.array([0] * len(found), pa.int64())) for c in (key, "level")]
        numbers = [pa.array(range(len(found)), pa.int64()), *(pa.array(c, pa.int64()) for c in (first, last))]
        return pa.Table.from_arrays([*own, *numbers, pa.array(header), pa.array(body), pa.array(n, pa.int64())], [key, "table", "chunk", "first", "last", "header", "body", "tokens"])

    kind = rows.schema[key].dataType.simpleString()
    own = rows.where("kind = 'row'").select(key, "level", "place", "cells")
    return own.groupBy(key, "level").applyInArrow(run, f"`{key}` {kind}, table int, chunk long, first long, last long, header string, body string, tokens long")
